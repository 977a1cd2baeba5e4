"""Folds of contributions: claims, conservation and efficiency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as m
from ..policy import Policy
from ..topology import local
from .attribution import identity
from .disputes import KEY

EVIDENCE_CAP = 20_000


def cells(contrib: DataFrame) -> DataFrame:
    """One row a cell: exact total, contributions, sources, provenance, stale. Partial sums, no lists of records."""
    g = contrib.groupBy(*KEY).agg(
        m.checked(F.sum("amount")).alias("known_total"), F.count("*").alias("known_contributions"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.collect_set("provenance")).alias("provenance"), F.bool_or("stale").alias("stale_included"),
    )
    return g.withColumn("cell", identity())


def known(contrib: DataFrame) -> DataFrame:
    """The exact total of each cell, and nothing else of it."""
    return contrib.groupBy(*KEY).agg(m.checked(F.sum("amount")).alias("known_total"))


def evidence(contrib: DataFrame, cap: int = EVIDENCE_CAP) -> DataFrame:
    """(cell, evidence): the ids of the first records of each cell in order of window and id, at most cap.

    Records beyond the cap leave before the shuffle, by a partial rank, so no task gathers all of a hot cell.
    """
    w = Window.partitionBy("cell").orderBy("window_start", "window_end", "id")
    x = contrib.select("cell", "window_start", "window_end", "id").withColumn("at", F.row_number().over(w)).filter(F.col("at") <= cap)
    return x.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("at", "id")))["id"].alias("evidence"))


def claims(contrib: DataFrame) -> DataFrame:
    """The cells with their evidence."""
    return cells(contrib).join(evidence(contrib), "cell", "left")


def unknowns(rejected: DataFrame, disputed: DataFrame) -> DataFrame:
    """(scope, generation, measure, reason, evidence_count): one for each kind of reject, of no scope, and one a disputed total."""
    a = rejected.select(F.lit("0" * 32).alias("scope"), "generation", "measure", "reason", F.lit(1).cast("long").alias("evidence_count"))
    b = disputed.select("scope", "generation", "measure", F.lit("conflicting-evidence").alias("reason"), F.col("k").alias("evidence_count"))
    return a.unionByName(b).distinct()


def conservation(contrib: DataFrame, unknown: DataFrame, total: DataFrame, policy: Policy) -> DataFrame:
    """One row a (scope, generation, measure): attributed against independently observed totals."""
    none, zero = F.lit(None).cast("decimal(20,0)"), F.lit(0).cast("long")
    key = ["scope", "generation", "measure"]
    rows = contrib.select(*key, F.col("amount").alias("a"), F.lit(1).cast("long").alias("n"), zero.alias("u"), none.alias("o"))
    rows = rows.unionByName(unknown.select(*key, none.alias("a"), zero.alias("n"), F.col("evidence_count").alias("u"), none.alias("o")))
    rows = rows.unionByName(total.filter("amount is not null").select(*key, none.alias("a"), zero.alias("n"), zero.alias("u"), F.col("amount").alias("o")))
    g = rows.groupBy(*key).agg(m.checked(F.coalesce(F.sum("a"), F.lit(0))).alias("attributed_total"), F.sum("n").alias("contribution_count"), F.sum("u").alias("unknown_contributions"), m.checked(F.sum("o")).alias("observed_total"), F.count("o").alias("total_observations"))
    d = F.col("attributed_total") - F.col("observed_total")
    status = F.when(F.col("observed_total").isNull(), "unverifiable").when(d == 0, "consistent")
    strict = lambda on, e, name: F.raise_error(F.lit(e)).cast("string") if on else F.lit(name)
    status = status.when(d < 0, strict(policy.residual == "strict-reject", "ConservationViolation", "residual")).otherwise(strict(policy.excess == "strict-reject", "OverAttribution", "excess"))
    return g.withColumns({"status": status, "delta": m.clamp(d), "residual_to_unknown": F.greatest(-d, F.lit(0)).cast("decimal(20,0)")})


def efficiency(claim: DataFrame, domains: DataFrame) -> DataFrame:
    """Six rows, one a measure: exact ratio of useful to all known work, withheld where anything is unknown."""
    use = m.usefulness(F.col("category"))
    part = lambda n: F.coalesce(F.sum(F.when(use == n, F.col("known_total"))), F.lit(0)).cast("decimal(20,0)").alias(n.replace("-", "_"))
    c = claim.groupBy("measure").agg(*[part(n) for n in ("useful", "necessary-overhead", "avoidable", "failed")], F.count_if(use == "unknown").alias("unclassified"))
    d = domains.groupBy("measure").agg(F.sum("unknown_contributions").alias("unmeasured"), F.count_if(F.col("status").isin("residual", "excess")).alias("broken"), F.count_if(F.col("status") != "consistent").alias("open"))
    kinds = local(claim.sparkSession, list(enumerate(m.MEASURES)), "kind_ord int, measure string")
    x = kinds.join(c, "measure", "left").join(d, "measure", "left").na.fill(0)
    x = x.withColumn("denominator", m.checked(F.col("useful") + F.col("necessary_overhead") + F.col("avoidable") + F.col("failed")))
    x = x.withColumn("unknown_contributions", (F.col("unclassified") + F.col("unmeasured")).cast("long"))
    why = F.when(F.col("broken") > 0, "a domain is not consistent").when(F.col("unknown_contributions") > 0, "some contributions could not be measured").when(F.col("denominator") == 0, "no known work")
    x = x.withColumn("indeterminacy_reason", why).withColumn("determinate", F.col("indeterminacy_reason").isNull())
    cover = F.when(F.col("denominator") == 0, "unknown").when((F.col("open") > 0) | (F.col("unknown_contributions") > 0), "partial").otherwise("known")
    g = m.gcd(F.col("useful"), F.col("denominator"))
    only = lambda v: F.when(F.col("determinate"), v)
    x = x.withColumns({"coverage": cover, "ratio_numerator": only(F.col("useful") / g).cast("decimal(20,0)"), "ratio_denominator": only(F.col("denominator") / g).cast("decimal(20,0)"), "permille": only(m.permille(F.col("useful"), F.col("denominator")))})
    return x.drop("unclassified", "unmeasured", "broken", "open").orderBy("kind_ord").drop("kind_ord")
