"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash space is kept."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, content_key, durable, sliced

#: Characters of a shingle.
WIDTH = 9
#: A sketch keeps one in so many of all hashes: the most of these that leaves LEAST of them, or else all.
SCALES, LEAST = (32, 4, 1), 32
#: Bits of a hash.
BITS = 40
_M1, _M2, _R = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Sketch:
    """All shingle hashes below 2**BITS / scale, sorted and distinct.

    The threshold is one of a fixed ladder and follows from the text's own shingles alone. Two
    sketches are compared, and merged, at the larger of their scales, where either holds every hash
    below the threshold: estimates of likeness and of containment have no bias from unequal lengths.
    """

    __slots__ = ("scale", "hashes")

    def __init__(self, scale: int, hashes: np.ndarray):
        self.scale, self.hashes = scale, hashes

    def at(self, scale: int) -> np.ndarray:
        return self.hashes if scale <= self.scale else self.hashes[self.hashes < np.uint64(2**BITS // scale)]


def hashed(text: str, width: int = WIDTH) -> np.ndarray:
    """Hashes of a text's character shingles, a piece at a time; a text of fewer characters is one shingle, an empty one has none."""
    if not text:
        return np.zeros(0, np.uint64)
    k, found, piece = min(width, len(text)), [], 1 << 18
    for lo in range(0, len(text) - k + 1, piece):
        c = np.frombuffer(text[lo : lo + piece + k - 1].encode("utf-32-le"), "<u4").astype(np.uint64)
        with np.errstate(over="ignore"):
            c = (c + np.uint64(1)) * _R
            h = np.full(len(c) - k + 1, k, np.uint64)
            for i in range(k):
                h = h * _M1 + c[i : len(c) - k + 1 + i]
            found.append(mix(h) >> np.uint64(64 - BITS))
    return np.concatenate(found)


def sketch(text: str, width: int = WIDTH) -> Sketch:
    """The text's sketch; that of the empty text has no hash, every other has one at least."""
    h = hashed(text, width)
    for scale in SCALES:
        kept = np.unique(h[h < np.uint64(2**BITS // scale)])
        if len(kept) >= LEAST:
            break
    return Sketch(scale, kept)


def _level(a: Sketch, b: Sketch) -> tuple[int, np.ndarray, np.ndarray]:
    scale = max(a.scale, b.scale)
    return scale, a.at(scale), b.at(scale)


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of two texts' shingles together."""
    scale, x, y = _level(a, b)
    return Sketch(scale, np.union1d(x, y))


def jaccard(a: Sketch, b: Sketch) -> float:
    """Estimated shingle likeness, 0 to 1; two empty texts are alike."""
    _, x, y = _level(a, b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    every = len(x) + len(y) - both
    return both / every if every else 1.0


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated part of a's shingles that b has; of the empty text 1, and 0 where a has no hash below b's threshold."""
    _, x, y = _level(a, b)
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x) if len(x) else float(not len(a.hashes))


def dump(s: Sketch) -> str:
    """The scale, and each hash as ten hexadecimal digits."""
    return f"{s.scale:x}:" + s.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def load(s: str) -> Sketch:
    scale, _, x = s.partition(":")
    wide = np.zeros((len(x) // 10, 8), np.uint8)
    wide[:, 3:] = np.frombuffer(bytes.fromhex(x), np.uint8).reshape(-1, 5)
    return Sketch(int(scale, 16), wide.view(">u8").reshape(-1).astype(np.uint64))


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


def bucketed(docs: DataFrame, rows_each: int = 4_000) -> DataFrame:
    """doc_id, text, key and bucket: buckets ascend as ids descend and have about rows_each rows.

    Numeric ids are cut at up to 1,000 approximate quantiles and each range evenly; other ids by the
    rank of their text among sampled cuts. Rows without id come last, cut by the text's key.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), content_key(F.col("text")).alias("key"))
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        n, none, low, high = rows.select(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id")).head()
        parts = min(1000, max(1, n // rows_each))
        cuts = rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
        edges = sorted({float(low or 0), *cuts, float(high or 0) + 1}, reverse=True)
        each = max(1, n // rows_each // max(1, len(edges) - 1))
        x, e = F.col("doc_id").cast("double"), F.array(*map(F.lit, edges))
        i = F.least(F.greatest(F.size(F.filter(e, lambda y: y > x)), F.lit(1)), F.lit(max(1, len(edges) - 1)))
        top, bottom = F.element_at(e, i), F.element_at(e, F.least(i + 1, F.lit(len(edges))))
        part = F.least(F.greatest(F.floor((top - x) / F.greatest(top - bottom, F.lit(1e-300)) * each), F.lit(0)), F.lit(each - 1))
        bucket = i * each + part
    else:
        n, none = rows.select(F.count("*"), F.count_if(F.col("doc_id").isNull())).head()
        share = min(1.0, 50_000 / max(1, n))
        ids = sorted((r[0] for r in rows.select("doc_id").filter("doc_id is not null").sample(share, 7).distinct().collect()), reverse=True)
        cuts = ids[:: max(1, len(ids) // max(1, min(1000, n // rows_each)))]
        x, e = F.col("doc_id"), F.array(*map(F.lit, cuts)) if cuts else F.array().cast(f"array<{kind}>")
        bucket = F.size(F.filter(e, lambda y: y >= x))
    nulls = max(1, none // rows_each)
    first = F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("double") / 2.0**32
    own = F.when(F.col("doc_id").isNotNull(), bucket.cast("long"))
    return rows.withColumn("bucket", F.coalesce(own, 2**62 + F.floor(first * nulls).cast("long")))


def with_heads(docs: DataFrame, rows_each: int = 4_000) -> DataFrame:
    """The rows of bucketed(), and for each bucket a row of flag 1: the first row of the next bucket that has any.

    The order is by descending id (nulls last), then by the text's key; the last bucket's next is the first.
    """
    rows = bucketed(docs, rows_each)
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top"))  # a row for rows_each rows
    w = Window.orderBy("bucket")
    links = tops.withColumn("at", F.coalesce(F.lag("bucket").over(w), F.last("bucket").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    links, _ = bounded(durable(links.withColumnRenamed("bucket", "of")), 100_000)
    same = (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top"))
    heads = rows.join(links, same).groupBy("at").agg(F.min_by("text", "key").alias("text"))
    none = F.lit(None).cast(rows.schema["doc_id"].dataType)
    heads = heads.select(none.alias("doc_id"), "text", F.lit(None).cast("binary").alias("key"), F.col("at").alias("bucket"), F.lit(1).alias("flag"))
    return rows.withColumn("flag", F.lit(0)).unionByName(heads)


def fingerprint_pairs(docs: DataFrame, rows_each: int = 4_000) -> DataFrame:
    """Each row's text, its edited text and the next document as sketches, with their likeness.

    Null texts count as empty, and the empty text has the empty fingerprint. Rows of equal id are
    ordered by their texts' keys, rows without id come last; repeated rows stay, a single row is
    its own next. Further columns are ignored. Texts are shuffled once, to buckets of neighbouring
    ids; a task reads its buckets in order and holds two rows at a time.
    """
    names = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches):
        bucket = waiting = text = own = ids = None
        for b in sliced(batches):
            out, done = [[] for _ in names], []
            for i, (at, flag, now) in enumerate(zip(b.column("bucket").to_pylist(), b.column("flag").to_pylist(), b.column("text").to_pylist(), strict=True)):
                new = own if now == text else sketch(now)
                if at == bucket and waiting is not None:
                    changed = edited(text, now)
                    other = own if changed == text else sketch(changed)
                    values = (len(text), hashlib.sha256(changed.encode()).hexdigest(), dump(own), dump(other), jaccard(own, other), jaccard(own, new))
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
                    done.append(waiting)
                bucket, text, own, waiting = at, now, new, None if flag else b.column("doc_id").slice(i, 1)
            if done:
                ids = pa.concat_arrays(done)
                waiting = waiting and pa.array(waiting.to_pylist(), waiting.type)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_heads(docs, rows_each).repartition("bucket").sortWithinPartitions("bucket", "flag", F.col("doc_id").desc_nulls_last(), "key")
    return rows.select("doc_id", "text", "bucket", "flag").mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
