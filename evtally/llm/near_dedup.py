"""Near-duplicates by SetSketch registers: bands of registers, joint likelihood, then exact sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, by_bytes, content_key, durable, sliced
from .components import components

#: Registers of a sketch in bands; base and rate of the exponentially spaced truncated minima.
ROWS, BANDS, BASE, RATE, TOP = 5, 40, 1.001, 20.0, 65_535
REGISTERS = ROWS * BANDS
#: Pairs estimated below this are not verified: five standard errors under 0.8.
HOPE = 0.65
#: Members of a bucket that are compared at once, rows that a join may broadcast once counted.
BLOCK, SMALL = 1024, 100_000
_rng = np.random.default_rng(20240601)
_SEEDS = _rng.integers(0, 2**63, REGISTERS, np.uint64)
_ODDS = _rng.integers(0, 2**63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; of fewer words, one for all of them."""
    raw = [t.encode().lower() for t in texts]
    data = np.frombuffer(b" ".join([*raw, b" "]), np.uint8)
    blank = _SPACE[data]
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    with np.errstate(over="ignore"):
        up, down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), r)])) for r in (_R, _BACK))
        total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:-1])])
        word = mix((total[end] - total[start]) * up[end] + (end - start).astype(np.uint64))  # byte i times _R ** (end - i)
        ends = np.cumsum([len(x) + 1 for x in raw])
        at = np.concatenate([[0], np.searchsorted(start, ends)])
        n = max(0, len(word) - width + 1)
        full = np.full(n, width, np.uint64)
        for i in range(width):
            full = mix(full * _R + word[i : n + i])
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(full[a : b - width + 1]))
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for w in word[a:b]:
                    h = mix(h * _R + w)
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch of each set that is not empty: floor(1 - log_BASE of the least exponential), cut to 0..TOP."""
    low = np.full((len(sets), REGISTERS), np.uint64(2**64 - 1))
    i = 0
    while i < len(sets):  # as many sets as fit a cache
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= 16_384):
            size += len(sets[j])
            j += 1
        h = np.concatenate(sets[i:j])
        first = np.cumsum([0, *map(len, sets[i : j - 1])])
        with np.errstate(over="ignore"):
            for r in range(REGISTERS):
                low[i:j, r] = np.minimum.reduceat((h ^ _SEEDS[r]) * _ODDS[r], first)
        i = j
    x = -np.log1p(-np.clip((low.astype(np.float64) + 0.5) / 2.0**64, 1e-19, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def likelihood(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 100) -> np.ndarray:
    """Jaccard of greatest joint likelihood, from registers greater and less and the sets' sizes."""
    u = na / (na + nb)
    v, j = 1 - u, np.linspace(0, 1, steps + 1)[None, :]
    j = j * np.minimum(u / v, v / u)[:, None]
    p = lambda x: -np.log(np.maximum(1e-12, 1 - np.maximum(x, 0) * (BASE - 1) / BASE)) / np.log(BASE)
    a, b = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    same = np.maximum(1e-12, 1 - a - b)
    score = more[:, None] * np.log(np.maximum(a, 1e-12)) + less[:, None] * np.log(np.maximum(b, 1e-12)) + (REGISTERS - more - less)[:, None] * np.log(same)
    return j[np.arange(len(j)), score.argmax(1)]


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key (of the text), node (of the set; null if it is empty), n and registers of every row."""

    def run(batches):
        for c in sliced(batches):
            sets = shingle_sets(c.column("text").to_pylist(), width)
            full = [s for s in sets if len(s)]
            regs = iter(registers(full))
            with np.errstate(over="ignore"):
                node = [int(mix(mix(s + _R).sum(keepdims=True) + mix(s).sum() * _R).view(np.int64)[0]) if len(s) else None for s in sets]
            blobs = [next(regs).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("key"), pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "key", "node", "n", "regs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", content_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, key binary, node long, n long, regs binary")


def buckets(nodes: DataFrame) -> DataFrame:
    """(band, bucket, node, pivot): bands of equal registers that two nodes or more share, with the least node."""
    width = 2 * ROWS
    cut = f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(regs, b * {width} + 1, {width})))"
    at = nodes.select("node", F.posexplode(F.expr(cut)).alias("band", "bucket"))
    pivots = at.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot <> last")
    return at.join(pivots.drop("last"), "bucket")


def hopeful(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sketches do not rule out."""

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            na, nb = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
            est = likelihood((x > y).sum(1), (x < y).sum(1), na, nb)
            yield b.select(["a", "b"]).filter(pa.array(est >= HOPE))

    side = lambda x, o: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    met = pairs.join(side("a", 0), "a").join(side("b", 0), "b")
    return met.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def texts(nodes: DataFrame, need: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the needed nodes, each from one row that holds its set."""
    need, _ = bounded(durable(nodes.select("node", F.col("doc_id").alias("doc"), "key").join(need.distinct(), "node")), SMALL)
    rows = docs.select("doc_id", content_key(F.col("text")).alias("key"), "text")
    return rows.join(need, (rows["key"] == need["key"]) & rows["doc_id"].eqNullSafe(need["doc"])).select("node", "text").dropDuplicates(["node"])


def linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    pairs = durable(pairs)
    found = durable(texts(nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")), docs))

    def run(batches):
        seen = [None, None]
        for whole in batches:
            for b in by_bytes(whole, ("ta",)):
                keep = []
                sets = shingle_sets(b.column("ta").to_pylist(), width)
                for i, (s, node) in enumerate(zip(sets, b.column("b").to_pylist(), strict=True)):
                    if seen[0] != node:
                        seen = [node, shingle_sets([b.column("tb")[i].as_py()], width)[0]]
                    keep.append(alike(s, seen[1], percent))
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(found.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    met = met.join(found.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").sortWithinPartitions("b")
    return met.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def alike(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def _hopes(key, t):
    """For each member of block i, the members of block j that may be linked with it from another
    component: of a fitting size, not already met in an earlier band, and not ruled out by registers."""
    band, blk, node, root, n = (t.column(c).to_numpy() for c in ("band", "blk", "node", "root", "n"))
    regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    left = np.flatnonzero(blk == key[1].as_py())
    right = left if key[1] == key[2] else np.flatnonzero(blk == key[2].as_py())
    for k in left:
        o = right[(root[right] != root[k]) & (10 * n[right] >= 8 * n[k]) & (10 * n[k] >= 8 * n[right])]
        o = o[node[o] > node[k]] if key[1] == key[2] else o
        same = regs[o] == regs[k]
        o = o[(same.sum(1) >= REGISTERS * (HOPE - 0.1)) & ~same[:, : ROWS * band[k]].reshape(len(o), band[k], ROWS).all(2).any(1)]
        if len(o):
            est = likelihood((regs[k] > regs[o]).sum(1), (regs[k] < regs[o]).sum(1), np.full(len(o), float(n[k])), n[o].astype(float))
            if len(o := o[est >= HOPE]):
                yield k, o


def contested(members: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) that join different components of a bucket.

    Buckets are cut into blocks of about BLOCK members, and a task compares two blocks at a time:
    first registers, to find the members with any hope; then, with the sets of those alone, it
    verifies hopes that its links have not yet joined. No pair leaves a task but the links that
    join, at most one a member.
    """
    split = members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).filter("lo <> hi").select("bucket", F.ceil(F.col("c") / BLOCK).cast("int").alias("m"))
    rows = members.join(split, "bucket").withColumn("blk", F.pmod(F.xxhash64("node"), "m").cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("bucket", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "band", "blk", "node", "root")
    regs = nodes.select("node", "n", "regs")

    def hope(key, t):
        found: set[int] = set()
        for k, o in _hopes(key, t):
            found.update([int(k), *map(int, o)])
        return t.take(pa.array(sorted(found), pa.int64())).drop_columns(["n", "regs"])

    def verify(key, t):
        node, root, own, links = t.column("node").to_numpy(), t.column("root").to_numpy(), t.column("set").to_pylist(), []
        up: dict[int, int] = {}

        def top(x):
            while x in up:
                x = up[x]
            return x

        for k, o in _hopes(key, t):
            s = np.frombuffer(own[k], np.uint64)
            for x in o:
                a, b = top(int(root[k])), top(int(root[x]))
                if a != b and alike(s, np.frombuffer(own[x], np.uint64), percent):
                    up[a] = b
                    links.append((int(node[k]), int(node[x])))
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    def sets(batches):
        for whole in batches:
            for b in by_bytes(whole):
                found = [s.tobytes() for s in shingle_sets(b.column("text").to_pylist(), width)]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(found, pa.binary())], ["node", "set"])

    few = durable(rows.join(regs, "node").groupBy("bucket", "i", "j").applyInArrow(hope, "node long, bucket long, i int, j int, band int, blk int, root long"))
    whole = durable(texts(nodes, few.select("node"), docs).mapInArrow(sets, "node long, set binary"))
    return few.join(regs, "node").join(whole, "node").groupBy("bucket", "i", "j").applyInArrow(verify, "u long, v long")


def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """The components after more links."""
    if not more.limit(1).count():
        return roots
    return durable(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, key (the text's content key), n_shingles, component_id (the smallest id reachable), kept
    and root (the component's own number, null without shingles) of every row.

    Rows of equal shingle sets are one node. Each node is first compared with the least node of
    each band it shares, then with a node that each band draws; then pairs of a band that still lie
    in different components are, so that components are those of all links (a link of 0.8 shares
    no band with probability 1e-7, and is estimated under HOPE with about as little).
    Empty and null texts are linked with nothing; repeated rows share a component; a null id is
    never the smallest and is kept where its component has no other id; further columns are ignored.
    """
    if percent < 80:
        raise ValueError("bands, hopes and size limits are laid out for a likeness of 80 % or more")
    rows = durable(sketched(docs, width))
    nodes = durable(rows.filter("node is not null").groupBy("node").agg(F.min_by(F.struct("doc_id", "key", "n", "regs"), F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("x")).select("node", "x.*"))
    band = durable(buckets(nodes))
    stars = band.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    edges = durable(linked(hopeful(stars, nodes), nodes, docs, width, percent).toDF("u", "v"))
    roots = durable(components(edges))
    members = durable(band.join(roots, "node", "left").select("band", "bucket", "node", F.coalesce("root", "node").alias("root")))
    # what is still apart meets a centre that each bucket draws for itself
    apart = members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by(F.struct("node", "root"), F.xxhash64("bucket", "node")).alias("c")).filter("lo <> hi")
    stars = members.join(apart, "bucket").filter(F.col("root") != F.col("c.root")).select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
    more = durable(linked(hopeful(stars, nodes), nodes, docs, width, percent).toDF("u", "v"))
    roots = joined(roots, more)
    members = durable(band.join(roots, "node", "left").select("band", "bucket", "node", F.coalesce("root", "node").alias("root")))
    roots = joined(roots, durable(contested(members, nodes, docs, width, percent)))
    least = nodes.join(roots, "node").groupBy("root").agg(F.min("doc_id").alias("least"))
    labels = roots.join(least, "root").select(F.col("node").alias("at"), "least", "root").unionByName(nodes.join(roots, "node", "left_anti").select(F.col("node").alias("at"), F.col("doc_id").alias("least"), F.col("node").alias("root")))
    out = rows.select("doc_id", "key", "node", "n").join(labels, F.col("node") == F.col("at"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "root")
