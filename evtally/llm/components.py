"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    met = both.join(low, "u")
    if large:
        return met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of an edge list (u, v) of longs; root is the component's smallest node.

    Each round is two shuffles of the edges, written to the shared folder; rounds grow with the
    logarithm of a component's size. An empty list gives none.
    """
    swap = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, was = durable(swap), None
    for _ in range(most):
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).head())
        if mark == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        was = mark
        wide = _star(now, True).filter("u <> v").distinct()
        now = durable(_star(wide, False).filter("u <> v").distinct())
    raise RuntimeError("components did not settle")
