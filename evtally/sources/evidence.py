"""Evidence documents: JSON lines of observations, or one envelope that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, times

OBSERVATION = (
    "id string, origin string, source string, incarnation string, epoch decimal(20,0), sequence decimal(20,0), generation string, observed_at long, received_at long, "
    "measure string, role string, category string, resource string, flow string, path string, reservation string, amount decimal(20,0), window_start long, window_end long, "
    "metadata array<struct<key:string,value:string>>, integrity string"
)
_TIMES = ("observed_at", "received_at", "window_start", "window_end")
_RAW = ", ".join(" ".join([n, "string" if n in _TIMES else t]) for n, t in (x.split(" ", 1) for x in OBSERVATION.split(", "))) + ", kind string"
_REQUIRED = ("id", "source", "incarnation", "epoch", "sequence", "generation", "observed_at", "received_at", "category", "amount", "window_start", "window_end")


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Observations of a document; any malformed line fails the read when it is reached.

    A line with unknown or repeated keys, without a required field or with a wrong type raises an error.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    keys = F.json_object_keys("value")
    rows = lines.select(F.when(F.array_contains(keys, "observations"), F.from_json(F.get_json_object("value", "$.observations"), "array<string>")).otherwise(F.array("value")).alias("rows"))
    raw = rows.select(F.explode("rows").alias("raw"))
    allowed = F.array(*[F.lit(x.split(" ")[0]) for x in _RAW.split(", ")])
    names = F.json_object_keys("raw")
    j = F.from_json("raw", _RAW, {"mode": "FAILFAST"})
    bad = F.when(names.isNull(), "SchemaViolation").when(F.size(F.array_except(names, allowed)) > 0, "UnknownField").when(F.size(names) != F.size(F.array_distinct(names)), "DuplicateKey")
    for c in _REQUIRED:
        bad = bad.when(F.get_json_object("raw", f"$.{c}").isNull(), f"MissingField {c}")
    checked = raw.select(F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.lit(": "), F.col("raw"))).cast("string")).otherwise(F.col("raw")).alias("raw")).select(j.alias("j")).select("j.*")
    none = lambda c: F.when(F.col(c) != "-", F.col(c))
    out = {c: times.parse(F.col(c)) for c in _TIMES} | {c: none(c) for c in ("resource", "flow", "path", "reservation")}
    out |= {"origin": F.coalesce(none("origin"), F.col("id")), "measure": F.coalesce("measure", "kind"), "role": F.coalesce("role", F.lit("contribution"))}
    out["id"] = F.when(ids.is_id(F.col("id")), F.col("id")).otherwise(F.raise_error(F.lit("MalformedIdentity")))
    return checked.withColumns(out).drop("kind")


def write_evidence(obs: DataFrame, path: str) -> None:
    """JSON lines that read_evidence reads back, times to the nanosecond."""
    frac = lambda c: F.concat(times.show(F.col(c), False).substr(F.lit(1), F.lit(19)), F.lit("."), F.lpad(F.pmod(F.col(c), F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("Z"))
    cols = [frac(c).alias(c) if c in _TIMES else F.col(c) for c in obs.columns]
    obs.select(F.to_json(F.struct(*cols)).alias("value")).write.mode("overwrite").text(path)
