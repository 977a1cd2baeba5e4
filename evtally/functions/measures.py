"""Vocabularies and the pure arithmetic of accounting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and their order.
MEASURES = ("wire-bytes", "payload-bytes", "port-occupancy-nanos", "capacity-nanos", "control-messages", "frame-count")
UNITS = ("octets", "octets", "nanoseconds", "nanoseconds", "messages", "frames")
CATEGORIES = ("useful-delivered-work", "retransmission", "duplication", "reroute-overhead", "idle-reservation", "failed-transfer", "stranded-capacity", "control-overhead", "unknown-unattributed")
BASES = ("resource-direct", "flow-direct", "path-direct", "reservation-direct", "scope-declared", "unattributed")
ROLES = ("contribution", "total")
PROVENANCES = ("real", "synthetic", "replay", "unsupported")
USEFUL = {"useful-delivered-work": "useful", "control-overhead": "necessary-overhead", "failed-transfer": "failed", "unknown-unattributed": "unknown"}
AXES = ("category", "scope", "generation", "source", "time", "provenance", "resource", "flow")
U64 = 2**64 - 1


def ordinal(c: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), c)


def usefulness(category: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in USEFUL.items():
        out = out.when(category == k, v)
    return out.otherwise(F.lit("avoidable"))


def unit(measure: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, UNITS)), ordinal(measure, MEASURES).cast("int"))


def checked(total: Column) -> Column:
    """An exact unsigned 64-bit total, or an error."""
    return F.when(total > F.lit(str(U64)).cast("decimal(20,0)"), F.raise_error(F.lit("ArithmeticOverflow"))).otherwise(total).cast("decimal(20,0)")


def coverage(known: Column, unknown: Column) -> Column:
    return F.when(unknown == 0, "known").when(known == 0, "unknown").otherwise("partial")


def bucket(end: Column, start: int, width: int) -> Column:
    """Start of the period-aligned bucket that holds a window's end."""
    if width <= 0:
        raise ValueError("InvalidArgument: a time axis needs a window")
    return F.lit(start) + F.floor((end - F.lit(start)) / F.lit(width)).cast("long") * F.lit(width)


def gcd(a: Column, b: Column) -> Column:
    """Euclid in at most 93 steps, which 64-bit numbers need."""
    zero = F.struct(a.cast("decimal(20,0)").alias("x"), b.cast("decimal(20,0)").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).cast("decimal(20,0)").alias("x"), F.when(s["y"] == 0, s["y"]).otherwise(s["x"] % s["y"]).cast("decimal(20,0)").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), zero, step, lambda s: s["x"])


def permille(useful: Column, all_: Column) -> Column:
    """Half up; 0 where the product would leave 64 bits."""
    wide = useful.cast("decimal(30,0)") * 1000
    return F.when(wide > F.lit(str(U64)).cast("decimal(30,0)"), F.lit(0)).otherwise(F.expr("1") * F.floor((wide + F.floor(all_ / 2)) / all_)).cast("long")


def clamp(delta: Column) -> Column:
    return F.when(delta.isNotNull(), F.least(F.greatest(delta, F.lit(-(2**63)).cast("decimal(21,0)")), F.lit(2**63 - 1).cast("decimal(21,0)"))).cast("long")


def freshness(observed: Column, received: Column, as_of: int, policy) -> Column:
    """fresh, stale, expired, future or anomaly of times in nanoseconds."""
    late = F.greatest(observed, received) > F.lit(as_of + policy.skew)
    age = F.greatest(F.lit(0), F.lit(as_of) - observed)
    return F.when(observed > received, "anomaly").when(late, "future").when(age <= policy.fresh_ttl, "fresh").when(age <= policy.stale_ttl, "stale").otherwise("expired")


def surfaces(classes: Column) -> Column:
    """Label of an array of provenance classes."""
    return F.when(F.size(classes) == 0, "NONE").otherwise(F.upper(F.array_join(F.array_sort(F.array_distinct(classes)), "+")))
