"""From raw documents to a training mix: five stages, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtally.llm import decontaminate, mixing, near_dedup, quality, suffix_dedup
from evtally.llm.common import bounded, content_key, durable, table

#: Bytes of a passage that counts as a repeat: 50 words of four bytes, their blanks included.
PASSAGE = 200
#: Rows that a join may broadcast once they are counted.
SMALL = 50_000


def _same(docs: DataFrame) -> DataFrame:
    """The columns of documents, without what an input may have besides."""
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _same(quality.classify(docs, model, keep=("text", "lang", "source", "n_chars")).filter("predicted = 1"))


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the smallest id, null ids last, then of the least key.

    Texts without shingles are linked with nothing; of those only rows that repeat an id are removed.
    """
    found = durable(near_dedup.near_duplicates(docs, width=5).select("doc_id", "key", "root"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = found.filter("root is not null").groupBy("root").agg(F.min(first).alias("best"), F.count("*").alias("n"))
    best, _ = bounded(durable(best.filter("n > 1").select("root", "best")), SMALL)
    other = ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key")))
    gone = found.join(best, "root").filter(other).select(F.col("doc_id").alias("gone"), F.col("key").alias("of")).distinct()
    rows = _same(docs).withColumn("key", content_key(F.col("text")))
    rows = rows.join(gone, (rows["key"] == gone["of"]) & rows["doc_id"].eqNullSafe(gone["gone"]), "left_anti")
    again = found.filter("root is not null or doc_id is not null").groupBy(F.col("doc_id").alias("twice"), F.col("key").alias("of")).agg(F.count("*").alias("n"))
    again = durable(again.filter("n > 1").select("twice", "of"))
    if not again.limit(1).count():
        return _same(rows)
    again, _ = bounded(again, SMALL)
    same = (rows["key"] == again["of"]) & rows["doc_id"].eqNullSafe(again["twice"])
    return _same(rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(["doc_id", "key"])))


def passage_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat."""
    out = suffix_dedup.dedup(docs, PASSAGE, keep=("lang", "source"))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    gone = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("key").distinct()
    rows = _same(docs).withColumn("key", content_key(F.col("text")))
    return _same(rows.join(gone, "key", "left_anti"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup_filter),
    ("suffix-array dedup", passage_removal),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
]

#: Learned models, sketches and random rounding have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
