"""Shape and ingest gates: the first reason that fails a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as m
from ..topology import SMALL, Topology


def shape_fault() -> Column:
    """Why an observation's shape is refused; null if it is not."""
    meta = F.coalesce("metadata", F.array().cast("array<struct<key:string,value:string>>"))
    bad = F.exists(meta, lambda m: (m["key"] == "") | (F.octet_length(m["key"]) > 64) | (F.octet_length(m["value"]) > 512))
    zero = (F.col("observed_at") == 0) | (F.col("received_at") == 0) | (F.col("window_start") == 0) | (F.col("window_end") == 0)
    named = [F.coalesce(F.col(c).isin(*names), F.lit(False)) for c, names in (("measure", m.MEASURES), ("category", m.CATEGORIES), ("role", m.ROLES))]
    return (
        F.when(~(named[0] & named[1] & named[2]), "unknown name")
        .when(F.col("window_end") <= F.col("window_start"), "window")
        .when(zero, "time missing")
        .when((F.size(meta) > 32) | bad, "metadata")
        .when(F.size(meta) != F.size(F.array_distinct(meta)), "metadata repeated")
        .when((F.col("role") == "total") & (F.col("category") != "unknown-unattributed"), "total with category")
    )


def with_period(obs: DataFrame, periods: DataFrame) -> DataFrame:
    """The period that contains each row's window (periods do not overlap, so at most one); null if none does.

    Periods are met by the stretch of time that a window starts in, as long as the longest period,
    so a row is compared with the few periods of its stretch. They are broadcast up to SMALL of them.
    """
    p = periods.select(F.col("id").alias("period"), F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col("state").alias("p_state"))
    n, longest = p.agg(F.count("*"), F.max(F.col("p_end") - F.col("p_start"))).head()
    stretch = max(1, longest or 1)
    at = lambda c: F.floor(F.col(c) / F.lit(stretch)).cast("long")
    p = p.withColumn("stretch", F.explode(F.sequence(at("p_start"), at("p_end"))))
    p = F.broadcast(p) if n <= SMALL else p
    inside = (at("window_start") == F.col("stretch")) & (F.col("window_start") >= F.col("p_start")) & (F.col("window_end") <= F.col("p_end"))
    return obs.join(p, inside, "left").drop("p_start", "p_end", "stretch")


def gate(obs: DataFrame, t: Topology, periods: DataFrame, late: str = "requires-correction") -> DataFrame:
    """Rows with verdict: the first gate that refuses them, late-evidence, or accepted."""
    s = t.joined("source", F.col("id").alias("s_id"), F.col("provenance").alias("s_prov"))
    i = t.joined("incarnation", F.col("id").alias("i_id"), F.col("boot_epoch").alias("i_boot"), F.col("retired_at").alias("i_retired"))
    g = t.joined("generation", F.col("id").alias("g_id"))
    x = obs.join(s, F.col("source") == F.col("s_id"), "left").join(i, F.col("incarnation") == F.col("i_id"), "left").join(g, F.col("generation") == F.col("g_id"), "left")
    x = with_period(x, periods)
    verdict = (
        F.when(shape_fault().isNotNull(), "rejected-shape")
        .when(F.col("s_id").isNull(), "rejected-unknown-source")
        .when(F.col("i_id").isNull(), "rejected-undeclared-incarnation")
        .when(F.col("received_at") > F.col("i_retired"), "rejected-retired-incarnation")
        .when(F.col("epoch") < F.col("i_boot"), "rejected-epoch-fenced")
        .when(F.col("g_id").isNull(), "rejected-unknown-generation")
        .when(F.col("s_prov") == "unsupported", "rejected-unsupported-provenance")
        .when(F.col("period").isNull(), "rejected-no-period")
        .when(F.col("p_state") != "open", "late-evidence")
        .otherwise("accepted")
    )
    return x.withColumn("verdict", verdict).drop("s_id", "s_prov", "i_id", "i_boot", "i_retired", "g_id")


def report(gated: DataFrame) -> DataFrame:
    return gated.groupBy("verdict").agg(F.count("*").alias("n"))
