"""Disputes within a cell and window, and between independent totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..policy import Policy
from .attribution import identity

SUBJECTS = ["resource", "flow", "path", "reservation"]
KEY = ["generation", "scope", "measure", "category", "basis", *SUBJECTS]


def by_authority(votes: Column, tie_break: str) -> Column:
    """The amount that source authority decides, null if it does not.

    votes: array of (amount, source, rank), folded in that order. A later source of higher rank
    takes over; one of the same rank ends the fold under reject, and else wins by its id. A
    preferred source with two amounts decides nothing.
    """
    start = F.struct(F.lit(None).cast("string").alias("source"), F.lit(None).cast("decimal(20,0)").alias("rank"), F.lit(False).alias("stuck"))

    def step(a, v):
        other = (v["rank"] == a["rank"]) & (v["source"] != a["source"])
        wins = a["source"].isNull() | (v["rank"] > a["rank"])
        if tie_break == "lowest-source-id-wins":
            wins = wins | (other & (v["source"] < a["source"]))
        elif tie_break == "highest-source-id-wins":
            wins = wins | (other & (v["source"] > a["source"]))
        stuck = other & F.lit(tie_break == "reject") & ~wins
        pick = lambda n: F.when(a["stuck"] | ~wins, a[n]).otherwise(v[n])
        return F.struct(pick("source").alias("source"), pick("rank").alias("rank"), F.coalesce(a["stuck"] | stuck, F.lit(False)).alias("stuck"))

    def decided(best):
        own = F.filter(votes, lambda v: v["source"] == best["source"])
        return F.when(~best["stuck"] & (F.size(own) == 1), F.get(own, F.lit(0))["amount"])

    # the fold is bound to a variable: inside the filter it would run again for each vote
    return F.get(F.transform(F.array(F.aggregate(F.array_sort(votes), start, step)), decided), F.lit(0))


def plain(policy: Policy) -> bool:
    """Whether a group counts only if all its amounts agree, so that no votes are needed."""
    return policy.conflict == "record-and-unknown" and policy.tie_break == "reject"


def spread() -> list[Column]:
    """Aggregates that tell whether all amounts of a group agree."""
    return [F.min("amount").alias("lo"), F.max("amount").alias("hi"), F.count("amount").alias("told"), F.count("*").alias("k")]


def agreed() -> Column:
    """Whether spread() found one amount in all records, or none in any."""
    return F.when(F.col("told") == 0, True).otherwise((F.col("told") == F.col("k")) & (F.col("lo") == F.col("hi")))


def settle(entries: DataFrame) -> DataFrame:
    """resolve() under a plain policy, without who took part: one fold a (cell, window), and one shuffle."""
    at = [*KEY, "window_start", "window_end"]
    g = entries.groupBy(F.xxhash64(*at).alias("_hash"), *at).agg(  # the fold sorts, by the hash first
        *spread(), F.min(F.struct("id", "source", "provenance", F.col("freshness").alias("fresh"))).alias("rep"),
    )
    return g.select(*at, "k", F.when(agreed(), F.col("lo")).alias("counted"), agreed().alias("agreed"), F.when(agreed() & (F.col("told") > 0), F.col("rep")).alias("rep"))


def resolve(entries: DataFrame, policy: Policy) -> DataFrame:
    """One row a (cell, window): agreed, amount (null if unresolved), the counted record, and who took part.

    A cell is its KEY here; its identity is computed once cells are folded. Groups are folded
    before they are shuffled; a cell's votes are distinct (amount, source).
    """
    at = [*KEY, "window_start", "window_end"]
    vote = F.struct("amount", "source", F.coalesce("authority", F.lit(0)).cast("decimal(20,0)").alias("rank"))
    # the lowest id of each amount first, then of the amount that wins
    own = F.xxhash64(*at).alias("_hash")  # leads the keys of sorts
    per = entries.groupBy(own, *at, "amount").agg(F.min(F.struct("id", "source", "provenance", F.col("freshness").alias("fresh"))).alias("rep"), F.count("*").alias("k"), F.collect_set(vote).alias("votes"), F.collect_set("source").alias("srcs"))
    g = per.groupBy("_hash", *at).agg(
        F.count("*").alias("amounts"), F.sum("k").alias("k"), F.collect_list(F.struct("amount", "rep")).alias("reps"), F.flatten(F.collect_list("votes")).alias("votes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("srcs")))).alias("sources")
    )
    amount = F.when(F.col("amounts") == 1, F.get("reps", F.lit(0))["amount"])
    if policy.conflict == "strict-fail":
        amount = F.when(F.col("amounts") > 1, F.raise_error(F.lit("ConflictingEvidence")).cast("decimal(20,0)")).otherwise(amount)
    elif policy.conflict == "prefer-higher-authority" or policy.tie_break != "reject":
        amount = amount.otherwise(by_authority(F.col("votes"), policy.tie_break))
    rep = F.get(F.filter("reps", lambda r: r["amount"] == F.col("counted")), F.lit(0))["rep"]
    return g.select(*at, "amounts", "k", "reps", "sources", amount.alias("counted"), (F.col("amounts") == 1).alias("agreed")).select(*at, "amounts", "k", "sources", "counted", "agreed", rep.alias("rep"))


def contributions(resolved: DataFrame) -> DataFrame:
    """The records that count, one a (cell, window)."""
    stale = F.col("agreed") & (F.col("rep.fresh") == "stale")
    own = [F.col("counted").alias("amount"), F.col("rep.id").alias("id"), F.col("rep.source").alias("source"), F.col("rep.provenance").alias("provenance"), stale.alias("stale")]
    return resolved.filter("counted is not null").select(identity().alias("cell"), *KEY, "window_start", "window_end", *own)


def dispute_rejects(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """Records that an agreed group already counts, and all of an unresolved one."""
    at = [*KEY, "window_start", "window_end"]
    r = resolved.filter("k > 1").select(*[F.col(c).alias(f"r_{c}") for c in at], "agreed", "counted", F.col("rep.id").alias("rep_id"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"r_{c}")) if c in SUBJECTS else F.col(c) == F.col(f"r_{c}") for c in at])
    reason = F.when(F.col("agreed") & (F.col("id") != F.col("rep_id")), "duplicate-suppressed").when(~F.col("agreed") & F.col("counted").isNull(), "conflicting-evidence")
    x = entries.join(r, same).select("id", "source", "generation", "measure", reason.alias("reason"), F.lit("cell and window").alias("detail"))
    return x.filter("reason is not null")


def conflicts(resolved: DataFrame) -> DataFrame:
    return resolved.filter("not agreed").select(identity().alias("cell"), "window_start", "window_end", F.col("amounts").alias("distinct_amounts"), "sources", F.col("counted").isNotNull().alias("resolved"))


def totals(rows: DataFrame) -> DataFrame:
    """Independent totals of a (domain, window): amount if all agree, else null; evidence is the lowest id."""
    g = rows.groupBy("scope", "generation", "measure", "window_start", "window_end").agg(F.min("amount").alias("lo"), F.max("amount").alias("hi"), F.min("id").alias("id"), F.count("*").alias("k"))
    return g.withColumn("amount", F.when(F.col("lo") == F.col("hi"), F.col("lo"))).drop("lo", "hi")
