"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of alphanumeric words (ASCII but digits and letters) and of blank-separated words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANKS = r"[\x20\x09-\x0D]+"
#: Measured bytes up to which a side of a join may be broadcast.
MOST_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    A session in a single process that names none (tests) gets a temporary one; on a cluster,
    whose executors could not see it, a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evtally-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evtally-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone: by bytes where all are ASCII, else letter by letter, which is slower."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def tokens(text: Column, separators: str) -> Column:
    """Lower-cased words between the separators; null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), separators), lambda w: w != "")


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def content_key(text: Column) -> Column:
    """128 bits that identify a text; rows with equal keys have equal texts."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _weight(c: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(c) + 16
    elif isinstance(kind, T.StructType):
        size = reduce(lambda a, f: a + _weight(c[f.name], f.dataType), kind.fields, F.lit(8))
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(c, F.lit(16).cast("long"), lambda a, x: a + _weight(x, kind.elementType).cast("long"))
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(8).cast("long"))


def bounded(df: DataFrame, rows: int, most: int = MOST_BYTES) -> tuple[DataFrame, bool]:
    """The frame, marked for broadcast only if it is measured to have at most so many rows and bytes.

    Beyond that the same join shuffles both sides; the result is the same.
    """
    size = reduce(lambda a, f: a + _weight(F.col(f"`{f.name}`"), f.dataType), df.schema.fields, F.lit(0).cast("long"))
    n, total = df.select(size.alias("size")).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).head()
    small = n <= rows and total <= most
    return (F.broadcast(df) if small else df), small


def by_bytes(batch, columns: tuple[str, ...] = ("text",), most: int = 1_000_000):
    """Slices of an Arrow batch whose texts have at most so many bytes, or a single row."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def sliced(batches, columns: tuple[str, ...] = ("text",), most: int = 1_000_000):
    """All slices by bytes of a task's batches; at the end, memory that the task no longer needs goes back to the system."""
    try:
        for b in batches:
            yield from by_bytes(b, columns, most)
    finally:
        released()


def released() -> None:
    """Give free memory back: Python workers outlive their tasks and would keep the largest size they had."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        return
