"""Admissibility: the first rule that a record breaks, in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import freshness
from ..policy import Policy
from ..topology import Topology


def bound(obs: DataFrame, binding: DataFrame, small: bool = False) -> DataFrame:
    """Rows with bound: a binding relates the resource and generation at the observed time, both ends included."""
    spans = binding.groupBy(F.col("resource").alias("b_res"), F.col("generation").alias("b_gen")).agg(F.collect_list(F.struct("valid_from", "valid_to")).alias("spans"))
    spans = F.broadcast(spans) if small else spans
    x = obs.join(spans, (F.col("resource") == F.col("b_res")) & (F.col("generation") == F.col("b_gen")), "left")
    held = F.exists("spans", lambda s: (s["valid_from"] <= F.col("observed_at")) & (s["valid_to"].isNull() | (F.col("observed_at") <= s["valid_to"])))
    return x.withColumn("bound", F.coalesce(held, F.lit(False))).drop("b_res", "b_gen", "spans")


def assessed(obs: DataFrame, t: Topology, policy: Policy, as_of: int) -> DataFrame:
    """Rows (with peak) and reason: null if admitted; adds authority, provenance and freshness."""
    s = t.joined("source", F.col("id").alias("s_id"), "authority", "provenance", "enabled")
    i = t.joined("incarnation", F.col("id").alias("i_id"), F.col("source").alias("i_source"), "boot_epoch", "started_at", "retired_at")
    x = obs.join(s, F.col("source") == F.col("s_id"), "left").join(i, F.col("incarnation") == F.col("i_id"), "left")
    x = bound(x, t.binding, t.small("binding")).withColumn("freshness", freshness(F.col("observed_at"), F.col("received_at"), as_of, policy))
    rules = [("s_id IS NULL", "attribution-failure"), ("provenance = 'unsupported'", "unsupported-provenance")]
    rules += [("i_id IS NOT NULL AND epoch < peak", "fenced-epoch"), ("NOT enabled", "unsupported-provenance")]
    if policy.require_incarnation_coverage:
        rules += [("i_id IS NULL", "retired-incarnation"), ("i_source <> source", "attribution-failure")]
        rules += [("received_at > retired_at", "retired-incarnation"), ("received_at < started_at", "clock-anomaly")]
    rules.append(("epoch < boot_epoch", "fenced-epoch"))
    if policy.require_generation_binding:
        rules.append(("resource IS NOT NULL AND NOT bound", "stale-generation"))
    rules.append(("freshness = 'anomaly'", "clock-anomaly"))
    if policy.reject_future:
        rules.append(("freshness = 'future'", "clock-anomaly"))
    if policy.stale != "include-marked":
        rules.append(("freshness = 'stale'", "stale-evidence"))
    rules.append(("freshness = 'expired'", "expired-evidence"))
    reason = F.expr("CASE " + " ".join(f"WHEN {when} THEN '{name}'" for when, name in rules) + " END")
    return x.withColumn("reason", reason).drop("s_id", "enabled", "i_id", "i_source", "boot_epoch", "started_at", "retired_at", "bound")
