"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere are removed.

Every window of length bytes is keyed by the least hash of the shorter strings in it, which equal
windows share. Consecutive windows of one key form a segment. A key met once holds no repeat; equal
segments repeat whole; the distinct segments of a key are compared by a suffix array from two-stage
sorting and by the common prefixes of its neighbours. A key with more bytes of distinct segments
than one task should sort is cut by longer strings: its segments are keyed anew, as texts are, by
the least hash of strings nearer to the length. What is crowded to the end is compared window by
window, by hashes that are dealt in packed buckets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, durable, released, sliced

LENGTH = 400
#: Parts of the length that strings have which key a window, from level to level; after them whole windows are compared.
GRAMS = (0.16, 0.4, 0.7, 0.9)
#: Most windows of a segment; bytes of a text keyed at once; bytes of a key's distinct segments that one task sorts.
RUN, PIECE, CHUNK = 4096, 1 << 18, 1_200_000
#: Windows of a bucket of hashes, until there are the most buckets.
BUCKET, BUCKETS = 1 << 16, 1024
_R = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 15), r, np.uint64)])) for r in (_R, pow(_R, -1, 2**64))]
    return _POWERS[0], _POWERS[1]


def gram_of(length: int, level: int = 0) -> int:
    """Bytes of the strings whose least hash keys a window."""
    return min(length, max(4, int(length * GRAMS[level])))


def _keyed(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings' hashes, and the key of every window of a text no longer than a piece."""
    n, w = len(data), length - gram + 1
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * down[:n])])
        h = (total[gram:] - total[:-gram]) * up[gram : n + 1]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    blocks = np.full(-(-len(h) // w) * w, 2**64 - 1, np.uint64)
    blocks[: len(h)] = h
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return h, np.minimum(ahead[: n - length + 1], np.minimum.accumulate(blocks, axis=1).reshape(-1)[w - 1 : n - gram + 1])


def segments(data: bytes, length: int = LENGTH, level: int = 0):
    """(key, first window, windows, whether the key's string stands in it twice) of a text, in order.

    A long text is keyed piece by piece; a piece's end only cuts a segment in two.
    """
    gram = gram_of(length, level)
    w = length - gram + 1
    for lo in range(0, max(0, len(data) - length + 1), PIECE):
        h, least = _keyed(data[lo : lo + PIECE + length - 1], length, gram)
        cuts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            key = least[s]
            twice = bool(np.count_nonzero(h[s : e + w - 1] == key) > 1)
            for x in range(s, e, RUN):
                yield int(key.view(np.int64)), lo + x, min(RUN, e - x), twice


def mark(segment: bytes) -> tuple[int, int]:
    d = hashlib.md5(segment, usedforsecurity=False).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def two_stage(parts: list[bytes], wanted: list[int], length: int = LENGTH) -> np.ndarray:
    """Places, in the parts' joined bytes, of each part's first wanted suffixes, in order of their first length bytes.

    Suffixes smaller than their successor are sorted directly. The others are induced: a scan of
    the buckets in ascending order puts the predecessor of each suffix met, if it is greater than
    its successor, next in the front of its own first byte's bucket.
    """
    sizes = np.array([len(p) + 1 for p in parts])
    first = np.cumsum(sizes) - sizes
    data = b"\x00".join(parts) + b"\x00"
    t = np.frombuffer(data, np.uint8).astype(np.int16) + 1
    stop = first + sizes - 1
    t[stop] = 0  # below all bytes
    # smaller than the successor: by the next byte that differs
    step = np.sign(t[1:] - t[:-1])
    at = np.where(step != 0, np.arange(len(step), dtype=np.int32), np.int32(len(step) - 1))
    small = np.append(step[np.minimum.accumulate(at[::-1])[::-1]] > 0, False)
    small[stop] = False
    # a part's suffixes are needed up to the first small one from its last wanted on
    near = np.where(small, np.arange(len(t), dtype=np.int32), np.int32(len(t)))
    near = np.minimum.accumulate(near[::-1])[::-1]
    last = np.minimum(near[first + np.array(wanted) - 1], stop)
    del step, at, near
    need = np.zeros(len(t) + 1, np.int8)
    np.add.at(need, first, 1)
    np.add.at(need, last + 1, -1)
    need = np.cumsum(need[:-1], dtype=np.int8) > 0
    end = np.repeat(stop.astype(np.int32), sizes)
    direct = np.flatnonzero(small & need)
    by_byte = np.split(direct[np.argsort(t[direct], kind="stable")], np.cumsum(np.bincount(t[direct], minlength=257))[:-1])
    front: list[list[np.ndarray]] = [[] for _ in range(257)]
    big = need & ~small

    def scan(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[big[before] & (t[before] > 0)]
        c = t[before]
        for x in np.unique(c):
            front[x].append(before[c == x])

    scan(stop)
    order = []
    for c in range(1, 257):
        i = 0
        while i < len(front[c]):  # what a byte's run adds comes to the same front, behind
            order.append(front[c][i])
            scan(front[c][i])
            i += 1
        back = by_byte[c]
        if len(back):
            back = np.array(sorted(back.tolist(), key=lambda p, e=end: data[p : min(p + length, e[p])]), np.int64)
            order.append(back)
            scan(back)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    return order[order - np.repeat(first, sizes)[order] < np.repeat(np.array(wanted), sizes)[order]]


def repeats(parts: list[bytes], wanted: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, which of its first wanted windows also start elsewhere in the parts."""
    order, data = two_stage(parts, wanted, length), b"\x00".join(parts) + b"\x00"
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)
    hit = np.zeros(len(data), bool)
    for lo in range(0, len(order) - 1, 4096):
        a, b = order[lo : lo + 4096], order[lo + 1 : lo + 4097]
        same = (view[a[: len(b)]] == view[b]).all(1)  # a common prefix of length bytes
        hit[a[: len(b)][same]] = hit[b[same]] = True
    out, at = [], 0
    for p, n in zip(parts, wanted, strict=True):
        out.append(hit[at : at + n])
        at += len(p) + 1
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _places(rows: DataFrame, length: int, level: int) -> DataFrame:
    """(m, h1, h2, rid, sn): every segment's key and content hash, its text, and first window, windows, twice in one long."""

    def run(batches):
        for b in sliced(batches, ("data",)):
            cols: list[list[int]] = [[], [], [], [], []]
            for rid, data in zip(b.column("rid").to_pylist(), b.column("data").to_pylist(), strict=True):
                for m, s, n, twice in segments(data, length, level):
                    for c, v in zip(cols, (m, *mark(data[s : s + n + length - 1]), rid, s << 14 | n << 1 | twice), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["m", "h1", "h2", "rid", "sn"])

    return rows.select("rid", "data").mapInArrow(run, "m long, h1 long, h2 long, rid long, sn long")


def _bytes(rows: DataFrame, need: DataFrame, length: int, level: int) -> DataFrame:
    """(m, h1, h2, n, big, part): the bytes of the needed segments, each from one row that holds it."""
    wanted = durable(need.groupBy("rid").agg(F.collect_list(F.struct("m", "h1", "h2", "big")).alias("list")))
    ids = rows.groupBy("rid").agg(F.min("doc_id").alias("one")).withColumnRenamed("rid", "r")  # a copy for all
    wanted = durable(ids.join(wanted, F.col("r") == F.col("rid")).drop("rid"))

    def run(batches):
        kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
        for b in sliced(batches, ("data",)):
            out: list[list] = [[] for _ in kinds]
            for data, own in zip(b.column("data").to_pylist(), b.column("list").to_pylist(), strict=True):
                left = {(x["m"], x["h1"], x["h2"]): x["big"] for x in own}
                for m, s, n, _ in segments(data, length, level):
                    part = data[s : s + n + length - 1]
                    if (k := (m, *mark(part))) in left:
                        for c, v in zip(out, (*k, n, left.pop(k), part), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["m", "h1", "h2", "n", "big", "part"])

    met = rows.join(wanted, (rows["rid"] == wanted["r"]) & rows["doc_id"].eqNullSafe(wanted["one"]))
    return met.select("data", "list").mapInArrow(run, "m long, h1 long, h2 long, n long, big boolean, part binary")


_SPANS = "m long, h1 long, h2 long, spans array<struct<lo:int,hi:int>>"


def _sorted_spans(parts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of each segment, from the suffix arrays of whole keys, about CHUNK bytes at a time."""
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def solve(rows):
        distinct = list(rows.items())
        found = repeats([p for _, (_, p) in distinct], [n for _, (n, _) in distinct], length)
        spans = [(k, runs(f)) for (k, _), f in zip(distinct, found, strict=True) if f.any()]
        ranges = pa.array([[{"lo": a, "hi": b} for a, b in s] for _, s in spans], kind)
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in spans], pa.int64()) for i in range(3)), ranges], ["m", "h1", "h2", "spans"])

    def run(batches):
        held, size, key = {}, 0, None
        for b in sliced(batches, ("part",)):
            for m, h1, h2, n, part in zip(*(b.column(c).to_pylist() for c in ("m", "h1", "h2", "n", "part")), strict=True):
                if m != key and size >= CHUNK // 4:  # so that a task holds little more than its largest key
                    yield solve(held)
                    held, size = {}, 0
                key = m
                if (m, h1, h2) not in held:
                    held[m, h1, h2] = (n, part)
                    size += len(part)
        if held:
            yield solve(held)
        released()

    return parts.select("m", "h1", "h2", "n", "part").repartition("m").sortWithinPartitions("m").mapInArrow(run, _SPANS)


_HASHED = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("rid", "<i8"), ("at", "<i4")])
_MET = np.dtype([("rid", "<i8"), ("at", "<i4")])


def _by(batches, key: str, kind: np.dtype):
    """For rows sorted by key: (key, slices, entries) of each key, its rows' packed entries in one array."""
    now, ids, held = None, [], []

    def whole():
        return now, np.repeat(np.array(ids, np.int64), [len(x) for x in held]), np.concatenate(held)

    for b in sliced(batches, ("packed",)):
        for k, i, x in zip(b.column(key).to_pylist(), b.column("slice").to_pylist(), b.column("packed").to_pylist(), strict=True):
            if k != now and held:
                yield whole()
                ids, held = [], []
            now = k
            ids.append(i)
            held.append(np.frombuffer(x, kind))
    if held:
        yield whole()


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """(rid, spans): ranges of the windows that also start elsewhere, by 128 bits of each window's hash.

    A slice of texts sends its windows' hashes packed, a row for each bucket of hashes, and a bucket
    sends back, packed again, which of them it met twice: rows grow neither with the windows nor with
    the size of a group, and a group is only as large as its packed hashes.
    """
    total = rows.agg(F.coalesce(F.sum(F.octet_length("data") - (length - 1)), F.lit(0))).head()[0]
    many = max(1, min(BUCKETS, total // BUCKET))
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def hashed(batches):
        at = TaskContext.get().partitionId() << 32
        for b in sliced(batches, ("data",)):
            texts = b.column("data").to_pylist()
            sizes = np.array([len(x) - length + 1 for x in texts], np.int64)
            e = np.zeros(int(sizes.sum()), _HASHED)
            h = np.frombuffer(b"".join(hashlib.md5(x[i : i + length], usedforsecurity=False).digest() for x in texts for i in range(len(x) - length + 1)), "<u8")
            e["h1"], e["h2"] = h[::2], h[1::2]
            e["rid"] = np.repeat(b.column("rid").to_numpy(), sizes)
            e["at"] = np.arange(len(e)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            bucket = (e["h1"] % np.uint64(many)).astype(np.int64)
            e = e[np.argsort(bucket, kind="stable")]
            n = np.bincount(bucket, minlength=many)
            full, to = np.flatnonzero(n), np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array([at] * len(full), pa.int64()), pa.array(full, pa.int64()), pa.array([e[to[k] - n[k] : to[k]].tobytes() for k in full], pa.binary())], ["slice", "bucket", "packed"])
            at += 1

    def met(batches):
        for _, ids, e in _by(batches, "bucket", _HASHED):
            order = np.lexsort((e["h2"], e["h1"]))
            same = (e["h1"][order[1:]] == e["h1"][order[:-1]]) & (e["h2"][order[1:]] == e["h2"][order[:-1]])
            hit = np.zeros(len(e), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            ids, found = ids[hit], np.zeros(int(hit.sum()), _MET)
            found["rid"], found["at"] = e["rid"][hit], e["at"][hit]
            first = np.flatnonzero(np.diff(ids, prepend=-1))  # a slice has one row in a bucket
            yield pa.RecordBatch.from_arrays([pa.array(ids[first], pa.int64()), pa.array([x.tobytes() for x in np.split(found, first[1:])][: len(first)], pa.binary())], ["slice", "packed"])

    def joined(batches):
        for _, _, e in _by(batches, "slice", _MET):
            e = e[np.lexsort((e["at"], e["rid"]))]
            cuts = np.flatnonzero((e["rid"][1:] != e["rid"][:-1]) | (e["at"][1:] > e["at"][:-1] + 1)) + 1
            lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(e)]]) - 1
            rid, lo, hi = e["rid"][lo], e["at"][lo], e["at"][hi] + 1
            first = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]]))
            ranges = pa.StructArray.from_arrays([pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["lo", "hi"])
            yield pa.RecordBatch.from_arrays([pa.array(rid[first], pa.int64()), pa.ListArray.from_arrays(pa.array([*first, len(rid)], pa.int32()), ranges).cast(kind)], ["rid", "spans"])

    packed = durable(rows.select("rid", "data").mapInArrow(hashed, "slice long, bucket long, packed binary"))
    found = durable(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(met, "slice long, packed binary"))
    return durable(found.repartition("slice").sortWithinPartitions("slice").mapInArrow(joined, "rid long, spans array<struct<lo:int,hi:int>>"))


def _whole(sn: str = "sn") -> Column:
    return F.expr(f"array(named_struct('lo', 0, 'hi', cast(shiftright({sn}, 1) & 8191 as int)))")


def repeated(rows: DataFrame, length: int, level: int = 0) -> DataFrame:
    """(rid, spans): ranges [lo, hi) of the windows that also start elsewhere, of rows (doc_id, rid, data).

    Rows of one rid have equal data. Keys of over CHUNK bytes go on to the next level, and their
    segments' ranges come back by the segments' ids; after the last level their windows are compared.
    """
    rows = rows.filter(F.octet_length("data") >= length)
    if level == len(GRAMS):
        return _windows(rows, length)
    place = durable(_places(rows, length, level))
    keys = place.groupBy("m").agg(F.count("*").alias("k"), F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max(F.col("sn").bitwiseAND(F.lit(1))).alias("twice"))
    keys = keys.filter("k > 1 or twice = 1").select("m", F.expr("lo <> hi or twice = 1").alias("mixed"))
    place = durable(place.join(keys, "m"))
    kinds = place.groupBy("m", "h1", "h2").agg(F.count("*").alias("c"), F.min("rid").alias("rid"), F.max("mixed").alias("mixed"), F.max("sn").alias("sn"))
    kinds = durable(kinds)
    mixed = kinds.filter("mixed")
    size = F.sum((F.shiftright("sn", 1).bitwiseAND(F.lit(8191))) + length - 1)
    big = durable(mixed.groupBy("m").agg(size.alias("size")).filter(F.col("size") > CHUNK).select("m", F.lit(True).alias("big")))
    crowded = big.limit(1).count() > 0
    big, _ = bounded(big, 100_000)
    mixed = mixed.join(big, "m", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    parts = durable(_bytes(rows, mixed, length, level))
    found = _sorted_spans(parts.filter("not big"), length)
    if crowded:
        own = parts.filter("big").select("m", "h1", "h2", F.xxhash64("m", "h1", "h2").alias("rid"), F.col("part").alias("data"))
        own = durable(own.dropDuplicates(["m", "h1", "h2"]))
        deeper = repeated(own.withColumn("doc_id", F.lit(0)), length, level + 1)
        found = found.unionByName(own.select("m", "h1", "h2", "rid").join(deeper, "rid").select("m", "h1", "h2", "spans"))
    found = durable(found).withColumnsRenamed({"m": "fm", "h1": "f1", "h2": "f2"})
    hit = place.join(kinds.select("m", "h1", "h2", "c"), ["m", "h1", "h2"])
    hit = hit.join(found, (F.col("m") == F.col("fm")) & (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left")
    hit = hit.withColumn("spans", F.when(F.col("c") > 1, _whole()).otherwise(F.col("spans"))).filter("spans is not null")
    moved = "transform(spans, x -> named_struct('lo', cast(shiftright(sn, 14) as int) + x.lo, 'hi', cast(shiftright(sn, 14) as int) + x.hi))"
    hit = hit.select("rid", F.expr(moved).alias("spans"))
    return durable(hit.distinct().groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def identified(docs: DataFrame, *more: str | Column) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("rid"), *more)


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, spans): removed byte ranges [lo, hi), unmerged, of the texts that have any."""
    rows = identified(docs).select("doc_id", "rid", F.col("text").cast("binary").alias("data"))
    wide = F.expr(f"transform(spans, x -> named_struct('lo', x.lo, 'hi', x.hi + {length - 1}))")
    return repeated(rows, length).select("rid", wide.alias("spans"))


def removed(size: int, ranges) -> np.ndarray:
    """Mask of the bytes that ranges cover."""
    edge = np.zeros(size + 1, np.int32)
    for x in ranges or ():
        edge[x["lo"]] += 1
        edge[x["hi"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (text) and the columns of keep, of every row.

    A byte is removed if it lies in a string of length bytes that also starts at another place of any
    row's text; repeats are judged on the whole input and do not cross rows. Null texts are empty,
    shorter texts lose nothing, repeated rows are repeats of each other; null ids and ties stay.
    kept leaves out a character of which only a part remains; the sum is over the remaining bytes.
    """
    ranges = spans(docs, length).withColumnRenamed("rid", "r")
    rows = identified(docs, *keep)
    rows = rows.join(ranges, rows["rid"] == ranges["r"], "left")

    def run(batches):
        for b in sliced(batches):
            out: list[list] = [[], [], [], [], []]
            for text, ranges in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data = text.encode()
                if ranges:
                    gone = removed(len(data), ranges)
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    n = len(runs(gone))
                else:
                    kept, n = data, 0
                for c, v in zip(out, (len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            own = [b.column(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], ["doc_id", *keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    return rows.select("doc_id", *keep, "text", "spans").mapInArrow(run, f"{own}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
