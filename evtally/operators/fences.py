"""Identity, origin, sequence and epoch fences over the whole candidate set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids


def _dealt(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by their keys, with a hash of them for the sort: its eight bytes decide nearly every comparison, while ids often begin alike.

    The parts are as many as the session's: merged to parts of one size they came to hardly more than the cores, and waited for the last.
    """
    n = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return obs.repartition(n, *keys).withColumn("_hash", F.xxhash64(*keys))  # computed after the shuffle, so it is not moved


def collisions(obs: DataFrame) -> DataFrame:
    """Rows with id_clash: another record claims the same id."""
    return _dealt(obs, ["id"]).withColumn("id_clash", F.count("*").over(Window.partitionBy("_hash", "id")) > 1).drop("_hash")


def grouped(obs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows with name: null, duplicate (equal content, not the lowest id) or divergent (any difference)."""
    w = Window.partitionBy("_hash", *keys).orderBy("id")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one sort for both passes
    x = _dealt(obs, keys).withColumn("_content", F.when(F.count("*").over(every) > 1, ids.content_digest()))  # not of a row alone
    divergent = F.min("_content").over(every) != F.max("_content").over(every)
    return x.withColumn(name, F.when(divergent, "divergent").when(F.row_number().over(w) > 1, "duplicate")).drop("_hash", "_content")


def peaks(obs: DataFrame) -> DataFrame:
    """Highest epoch of each incarnation, over all candidates; few rows, folded before they are shuffled."""
    return obs.groupBy(F.col("incarnation").alias("pk_incarnation")).agg(F.max("epoch").alias("peak"))


def fenced(obs: DataFrame) -> DataFrame:
    """All candidates with the three fences' findings and their incarnation's peak epoch."""
    x = grouped(collisions(obs), ["origin"], "origin_fence")
    x = grouped(x, ["source", "incarnation", "sequence"], "sequence_fence")
    return x.join(peaks(obs), F.col("incarnation") == F.col("pk_incarnation"), "left").drop("pk_incarnation")


def findings() -> Column:
    """Array of (reason, detail), one for each fence that refuses a row."""
    return F.filter(
        F.array(
            F.when(F.col("id_clash"), F.struct(F.lit("conflicting-evidence").alias("reason"), F.lit("evidence id claimed twice").alias("detail"))),
            *[
                F.when(F.col(c) == "duplicate", F.struct(F.lit("duplicate-suppressed").alias("reason"), F.lit(f"{n} delivered again").alias("detail"))).when(
                    F.col(c) == "divergent", F.struct(F.lit("conflicting-evidence").alias("reason"), F.lit(f"{n} reused with other content").alias("detail"))
                )
                for c, n in (("origin_fence", "origin"), ("sequence_fence", "sequence"))
            ],
        ),
        lambda r: r.isNotNull(),
    )


def fence_rejects(x: DataFrame) -> DataFrame:
    """(id, source, generation, measure, reason, detail) of the fences; a row that several refuse has several."""
    return x.select("id", "source", "generation", "measure", F.explode(findings()).alias("r")).select("id", "source", "generation", "measure", "r.reason", "r.detail")


def passed() -> Column:
    return ~F.col("id_clash") & F.col("origin_fence").isNull() & F.col("sequence_fence").isNull()


def survivors(x: DataFrame) -> DataFrame:
    return x.filter(passed())
