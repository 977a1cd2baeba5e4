"""Serving: query, rollup, aggregation, reconciliation, explanation, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as m

ORDER = ("scope", "generation", "measure", "category", "basis", "resource", "flow", "path", "reservation")
# The columns of an export, in the order of its header.
CSV_COLUMNS = ("scope", "generation", "measure", "unit", "category", "usefulness", "basis", "resource", "flow", "path", "reservation", "coverage", "known_total", "known_contributions", "unknown_contributions")
# The order of results as they are published.
ORDERS = {
    "claims": ("generation", "scope", "measure", "category", "basis", "resource", "flow", "path", "reservation"),
    "unknowns": ("scope", "generation", "measure", "reason"),
    "rejected": ("reason", "source", "id", "detail"),
    "conflicts": ("cell", "window_start"),
    "conservation": ("scope", "generation", "measure"),
    "buckets": ("category", "scope", "generation", "source", "resource", "flow", "provenance", "bucket_start"),
}
BUCKETS = 100_000


def _ranked(c: str):
    ranks = {"measure": m.MEASURES, "category": m.CATEGORIES, "basis": m.BASES, "provenance": m.PROVENANCES}
    return m.ordinal(F.col(c), ranks[c]) if c in ranks else F.col(c).asc_nulls_first()


def ordered(name: str, result: DataFrame) -> DataFrame:
    """A result table in its published order; vocabularies go by their place, subjects that are null first."""
    return result.orderBy(*[_ranked(c) for c in ORDERS[name] if c in result.columns])


def rows(claim: DataFrame, up: DataFrame | None = None, conflict: DataFrame | None = None, *, category=None, measure=None, generation=None, scope=None, descendants=False, limit: int = 100_000) -> tuple[DataFrame, dict]:
    """Cells in report order with the filters applied, and how many of them the limit leaves."""
    x = claim
    for c, v in (("category", category), ("measure", measure), ("generation", generation)):
        x = x.filter(F.col(c) == v) if v is not None else x
    if scope is not None and descendants:
        x = x.join(up.filter(F.col("anc") == scope).select(F.col("leaf").alias("scope")), "scope", "left_semi")
    elif scope is not None:
        x = x.filter(F.col("scope") == scope)
    clash = F.lit(False)
    if conflict is not None:
        x = x.join(conflict.select(F.col("cell").alias("clash")).distinct(), F.col("cell") == F.col("clash"), "left")
        clash = F.col("clash").isNotNull()
    x = x.withColumn("has_conflict", clash).withColumn("unknown_contributions", F.lit(0).cast("long"))  # a cell holds what was counted
    x = x.withColumn("coverage", m.coverage(F.col("known_contributions"), F.col("unknown_contributions")))
    n = x.count()
    kept = x.orderBy(*[_ranked(c) for c in ORDER]).limit(limit) if n > limit else x.orderBy(*[_ranked(c) for c in ORDER])
    return kept, {"truncated": n > limit, "total_available": n, "returned": min(n, limit)}


def rollup(claim: DataFrame, up: DataFrame) -> DataFrame:
    """Totals of each scope and all scopes above it by (scope, generation, measure, category); up is the scopes' closure."""
    x = claim.join(up, claim["scope"] == up["leaf"]).select("anc", "generation", "measure", "category", "known_total", "known_contributions")
    g = x.groupBy(F.col("anc").alias("scope"), "generation", "measure", "category")
    return g.agg(m.checked(F.sum("known_total")).alias("known_total"), F.sum("known_contributions").alias("known_contributions")).withColumn("basis", F.lit("scope-declared"))


def aggregate(contrib: DataFrame, axis: str, start: int = 0, width: int = 0) -> DataFrame:
    """Buckets under the full composite key; the axis sets the label, and time adds the bucket."""
    key = ["category", "scope", "generation", "source", "resource", "flow", "provenance"]
    at = m.bucket(F.col("window_end"), start, width) if axis == "time" else F.lit(None).cast("long")
    label = at.cast("string") if axis == "time" else F.coalesce(F.col(axis), F.lit("0" * 32))
    x = contrib.withColumn("bucket_start", at).withColumn("label", label)
    g = x.groupBy("label", "bucket_start", *key, "measure").agg(m.checked(F.sum("amount")).alias("known_total"), F.count("*").alias("known_contributions"), F.countDistinct("cell").alias("claim_count"))
    return g


def aggregate_axis(contrib: DataFrame, axis: str, start: int = 0, width: int = 0) -> DataFrame:
    """Totals by one axis alone and measure."""
    label = m.bucket(F.col("window_end"), start, width).cast("string") if axis == "time" else F.coalesce(F.col(axis), F.lit("0" * 32))
    return contrib.groupBy(label.alias("label"), "measure").agg(m.checked(F.sum("amount")).alias("known_total"), F.count("*").alias("known_contributions"))


def buckets(contrib: DataFrame, unknown: DataFrame, axis: str, start: int = 0, width: int = 0, *, generation=None, measure=None, scope=None, limit: int = BUCKETS) -> tuple[DataFrame, dict]:
    """Buckets of contributions and of what is unknown, in key order, and how many of them the limit leaves.

    A bucket has a cell for each measure (at most six), its kinds of unknowns, and its proof surfaces.
    A cell counts each of its reasons once, however many unknowns, told apart by their evidence, give it.
    Unknowns stand in the bucket of their scope and generation under unknown-unattributed and no
    other subject. The filters apply to both before anything is grouped.
    """
    if axis not in m.AXES:
        raise ValueError("InvalidArgument: axis")
    nil = F.lit("0" * 32)
    at = m.bucket(F.col("window_end"), start, width) if axis == "time" else F.lit(0).cast("long")
    for c, v in (("generation", generation), ("measure", measure), ("scope", scope)):
        if v is not None:
            contrib, unknown = contrib.filter(F.col(c) == v), unknown.filter(F.col(c) == v)
    key = ORDERS["buckets"]
    subject = {c: F.coalesce(F.col(c), nil) for c in ("source", "resource", "flow")}
    known = contrib.select(*[subject.get(c, F.col(c)).alias(c) for c in key[:-1]], at.alias("bucket_start"), "measure", F.col("amount").alias("a"), F.lit(1).alias("k"), F.lit(None).cast("string").alias("reason"))
    none = {"category": F.lit("unknown-unattributed"), "provenance": F.lit("real"), "bucket_start": F.lit(0).cast("long")} | dict.fromkeys(subject, nil)
    lost = unknown.select(*[none.get(c, F.col(c)).alias(c) for c in key], "measure", F.lit(None).cast("decimal(20,0)").alias("a"), F.lit(0).alias("k"), "reason")
    g = known.unionByName(lost).groupBy(*key, "measure").agg(
        m.checked(F.coalesce(F.sum("a"), F.lit(0))).alias("known_total"), F.sum("k").cast("long").alias("known_contributions"),
        F.size(F.collect_set("reason")).cast("long").alias("unknown_contributions"), F.array_sort(F.collect_set("reason")).alias("reasons"),
    )
    cell = F.struct(m.ordinal(F.col("measure"), m.MEASURES).alias("place"), "measure", "known_total", "known_contributions", "unknown_contributions", m.coverage(F.col("known_contributions"), F.col("unknown_contributions")).alias("coverage"), "reasons")
    out = g.groupBy(*key).agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.sum("known_contributions").alias("claim_count"), F.sum("known_contributions").alias("evidence_count"))
    out = out.withColumn("proof_surfaces", m.surfaces(F.when(F.col("evidence_count") > 0, F.array("provenance")).otherwise(F.array().cast("array<string>"))))
    limit, n = min(limit, BUCKETS), out.count()
    out = ordered("buckets", out)
    return out.limit(limit) if n > limit else out, {"truncated": n > limit, "total_available": n, "returned": min(n, limit)}


def reconcile(domains: DataFrame, scope: str | None = None) -> DataFrame:
    x = domains if scope is None else domains.filter(F.col("scope") == scope)
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("consistent", "residual", "excess", "unverifiable")}
    return x.agg(F.count("*").alias("domains"), *n.values()).withColumn("fully_consistent", F.col("domains") == F.col("consistent"))


def explain(claim: DataFrame, rejected: DataFrame, cell: str, limit: int | None = None) -> DataFrame:
    """(step, item, detail): the claim, its evidence, and the rejects of its generation and measure; empty if there is none.

    All rejects are given unless a limit, an entry budget, is set; what it cuts is told by a row
    'truncated' of the rejects available and returned.
    """
    c = claim.filter(F.col("cell") == cell)
    fact = F.explode(F.array(F.struct(F.lit("basis").alias("step"), F.col("basis").alias("item"), F.col("scope").alias("detail")), F.struct(F.lit("total").alias("step"), F.col("known_total").cast("string").alias("item"), F.col("known_contributions").cast("string").alias("detail"))))
    out = c.select(fact.alias("e")).select("e.*").unionByName(c.select(F.lit("counted").alias("step"), F.explode("evidence").alias("item"), F.lit("").alias("detail")))
    near = rejected.join(c.select("generation", "measure"), ["generation", "measure"], "left_semi")
    if limit is not None:
        cut = near.agg(F.count("*").alias("n")).filter(F.col("n") > limit)
        out = out.unionByName(cut.select(F.lit("truncated").alias("step"), F.col("n").cast("string").alias("item"), F.lit(str(limit)).alias("detail")))
        near = near.orderBy("reason", "source", "id").limit(limit)
    return out.unionByName(near.select(F.lit("excluded").alias("step"), F.col("id").alias("item"), F.col("reason").alias("detail")))


def _published(row: DataFrame, evidence: bool = False) -> DataFrame:
    """The columns of an export; a scope or subject that is null or nil is '-'."""
    shown = lambda c: F.when(F.col(c) != "0" * 32, F.col(c)).otherwise("-")
    x = row.withColumns({c: shown(c) for c in ("scope", "resource", "flow", "path", "reservation")})
    x = x.withColumns({"unit": m.unit(F.col("measure")), "usefulness": m.usefulness(F.col("category"))})
    return x.select(*CSV_COLUMNS, *["evidence"] * evidence)


def export_columns(row: DataFrame) -> DataFrame:
    """The columns of an export as text."""
    return _published(row).select(*[F.col(c).cast("string").alias(c) for c in CSV_COLUMNS])


def payload_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of the one file of an export, read as a stream in the JVM."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (own,) = [x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")]
    stream = fs.open(own)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def export(row: DataFrame, path: str, form: str = "jsonl", evidence: bool = False) -> str:
    """One ordered file, and its SHA-256: csv with a header and CR LF, jsonl with keys in alphabetical order, or canonical-json.

    Counts are numbers in JSON; with evidence, each JSON row has the ids of its column evidence.
    """
    if form == "csv":
        out = export_columns(row).coalesce(1).write.mode("overwrite").option("lineSep", "\r\n")
        out.csv(path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        return payload_digest(row.sparkSession, path)
    if form not in ("jsonl", "canonical-json"):
        raise ValueError("InvalidArgument: format")
    x = _published(row, evidence)
    line = x.select(F.to_json(F.struct(*sorted(x.columns))).alias("value"))
    if form == "canonical-json":  # a line a row, so no task holds all of them
        comma = F.when(F.monotonically_increasing_id() > 0, ",").otherwise("")
        one = lambda text: row.sparkSession.range(0, 1, 1, 1).select(F.lit(text).alias("value"))
        line = one('{"rows":[').union(line.coalesce(1).select(F.concat(comma, "value").alias("value"))).union(one('],"schema":"export/1"}'))
    line.coalesce(1).write.mode("overwrite").text(path)
    return payload_digest(row.sparkSession, path)
