"""RFC 3339 times as nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?([Zz]|[+-]\d{2}:\d{2})$"


def parse(c: Column) -> Column:
    """Nanoseconds since 1970; '-' is 0; other texts raise an error."""
    at = lambda i: F.regexp_extract(c, _FORM, i)
    zone = F.when(F.upper(at(8)) == "Z", "+00:00").otherwise(at(8))
    whole = F.try_to_timestamp(F.concat(at(1), F.lit("-"), at(2), F.lit("-"), at(3), F.lit("T"), at(4), F.lit(":"), at(5), F.lit(":"), at(6), zone), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    nanos = F.rpad(at(7), 9, "0").cast("long")
    good = c.rlike(_FORM) & (F.length(c) <= 64) & whole.isNotNull()
    return F.when(c == "-", F.lit(0)).when(good, F.unix_seconds(whole) * 1_000_000_000 + F.coalesce(nanos, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("InvalidTime: "), c)).cast("long"))


def show(nanos: Column, millis: bool = True) -> Column:
    """UTC text to milliseconds or seconds, rounded down also before 1970."""
    s = F.floor(nanos / F.lit(1_000_000_000)).cast("long")
    text = F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss")
    ms = F.lpad(F.floor(F.pmod(nanos, F.lit(1_000_000_000)) / 1_000_000).cast("string"), 3, "0")
    return F.concat(text, F.lit("."), ms, F.lit("Z")) if millis else F.concat(text, F.lit("Z"))


def duration(nanos: Column) -> Column:
    """ISO 8601 text of whole seconds."""
    s = F.abs(nanos).cast("long").cast("decimal(20,0)")
    s = F.floor(s / 1_000_000_000).cast("long")
    sign = F.when(nanos < 0, "-").otherwise("")
    d, h, m, x = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    part = lambda v, u: F.when(v > 0, F.concat(v.cast("long").cast("string"), F.lit(u))).otherwise("")
    clock = F.concat(part(h, "H"), part(m, "M"), part(x, "S"))
    text = F.concat(sign, F.lit("P"), part(d, "D"), F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(""))
    return F.when(s == 0, "PT0S").otherwise(text)
