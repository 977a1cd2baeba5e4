"""LM scoring: a gated recurrent language model in numpy with a class-factored softmax.

The vocabulary is all training words. The commonest words are clustered into topics by the training
documents they stand in, each document has a topic by the same words, and each word belongs to the topic that has most of its occurrences. A topic's words fill
classes in order of their counts; what does not fit is the tail of the topic's last class, from
which a word is drawn by its count. Words beyond the dictionary, and words never seen, are one
symbol, from which a word is drawn by add-one counts.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content_key, durable, released, remainder, sliced

#: Classes and words of a class, hidden units, steps that gradients go back, lanes, learning rate.
CLASSES, EACH, HIDDEN, STEPS, LANES, RATE = 32, 32, 12, 16, 1024, 0.04
#: Symbols: class 0 has the end of a text and any word beyond the dictionary; slot 0 of each other class is its tail.
SYMBOLS, END, OTHER = CLASSES * EACH, 0, 1
#: Topics, words that tell a document's topic, words of the dictionary, documents of one matrix of signatures.
TOPICS, MARKS, DICTIONARY, SIGNED = 8, 256, 131_072, 4096
#: Scale of signatures and centres, which are whole numbers: sums over documents do not depend on their order.
SCALE = 4096
#: Bytes of text, and symbols, in memory at once; words of a shard; words of the first weights' shard and passes over it; models summed by one task.
BYTES, STREAM, SHARD, WARM, PASSES, FAN_IN = 8_000_000, 1_000_000, 4_000_000, 1_000_000, 2, 16
_SHAPES = {"wx": (SYMBOLS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wo": (CLASSES, HIDDEN, EACH), "bo": (CLASSES, EACH)}


def initial(mass: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Small random weights; biases give each symbol the share of its mass, if that is known."""
    g = np.random.default_rng(7)
    w = {k: (g.normal(0, 0.1, s) if k != "bc" and k != "bo" else np.zeros(s)).astype(np.float32) for k, s in _SHAPES.items()}
    if mass is not None:
        m = np.maximum(mass.reshape(CLASSES, EACH).astype(np.float64), 1e-9)
        w["bc"] = np.log(m.sum(1) / m.sum()).astype(np.float32)
        w["bo"] = np.maximum(np.log(m / m.sum(1, keepdims=True)), -30).astype(np.float32)
    return w


def packed(w: dict) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in _SHAPES])


def unpacked(v: np.ndarray) -> dict:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        out[k] = v[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
        at += int(np.prod(s))
    return out


def _exp(x: np.ndarray) -> np.ndarray:
    """An exponential in place, linear between powers of two: within 6 % and positive, so that what is
    normalised by its own sum is a distribution; several times faster than the exact one."""
    np.clip(x, -40, 40, out=x)
    x *= np.float32(2**23 / np.log(2))
    x += np.float32(127 * 2**23 - 366_000)
    return x.astype(np.int32).view(np.float32)


def _sigmoid(x):
    np.negative(x, out=x)
    x = _exp(x)
    x += 1
    return np.reciprocal(x, out=x)


def _softmax(x):
    x = _exp(x)
    x /= (x @ np.ones(x.shape[1], np.float32))[:, None]
    return x


def _cell(w, x, h):
    """One step from input symbols x and states h: the new states and what the gradient needs."""
    a, b = w["wx"][x], h @ w["u"]
    q = b[:, 2 * HIDDEN :]
    g = a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN]
    g = _sigmoid(g)
    z, r = g[:, :HIDDEN], g[:, HIDDEN:]
    n = r * q
    n += a[:, 2 * HIDDEN :]
    n *= 2
    n = _sigmoid(n)  # tanh
    n *= 2
    n -= 1
    new = h - n
    new *= z
    new += n
    return new, (z, r, q, n)


def _output(w, h, y, grads=None):
    """Natural log-probabilities of symbols y after states h; with grads, adds the weights' and returns the states'."""
    y = y.astype(np.uint16)
    order = np.argsort((y // EACH).astype(np.uint8), kind="stable")  # by class
    h, y = h[order], y[order]
    c, i, at = y // EACH, y % EACH, np.arange(len(y))
    edges = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
    parts = [(k, slice(edges[k], edges[k + 1])) for k in range(CLASSES) if edges[k] < edges[k + 1]]
    p = h @ w["wc"]
    p += w["bc"]
    p = _softmax(p)
    q = np.empty((len(y), EACH), np.float32)
    for k, o in parts:
        np.matmul(h[o], w["wo"][k], out=q[o])
        q[o] += w["bo"][k]
    q = _softmax(q)
    out = np.empty(len(y), np.float32)
    out[order] = np.log(np.maximum(p[at, c] * q[at, i], 1e-30))
    if grads is None:
        return out, None
    p[at, c] -= 1
    q[at, i] -= 1
    grads["wc"] += h.T @ p
    grads["bc"] += np.ones(len(y), np.float32) @ p
    own = p @ w["wc"].T
    for k, o in parts:
        grads["wo"][k] += h[o].T @ q[o]
        grads["bo"][k] += np.ones(o.stop - o.start, np.float32) @ q[o]
        own[o] += q[o] @ w["wo"][k].T
    back = np.empty_like(own)
    back[order] = own
    return out, back


def train(w: dict, stream: np.ndarray, memory: dict | None = None, rate: float = RATE) -> dict:
    """Backpropagation truncated after STEPS over a stream of documents, each closed by 0, in LANES lanes.

    Lanes keep their states from window to window; an end sets them to zero. Steps are scaled by
    the squares of past gradients, which memory carries from stream to stream.
    """
    memory = memory if memory is not None else {k: np.full(s, 1e-6, np.float32) for k, s in _SHAPES.items()}
    if not len(stream):
        return w
    lanes = max(1, min(LANES, len(stream) // (4 * STEPS)))
    m = -(-len(stream) // lanes)
    y = np.resize(stream, m * lanes).reshape(lanes, m).T  # the last lane ends with the first symbols again
    x = np.concatenate([np.zeros((1, lanes), y.dtype), y[:-1]])
    h = np.zeros((lanes, HIDDEN), np.float32)
    for t0 in range(0, m, STEPS):
        xs, ys, before, kept = x[t0 : t0 + STEPS], y[t0 : t0 + STEPS], [], []
        states = []
        for row in xs:
            h = h * (row != 0)[:, None]
            before.append(h)
            h, k = _cell(w, row, h)
            kept.append(k)
            states.append(h)
        grads = {k: np.zeros(s, np.float32) for k, s in _SHAPES.items()}
        _, back = _output(w, np.concatenate(states), ys.reshape(-1), grads)
        back = back.reshape(len(xs), lanes, HIDDEN)
        carry = np.zeros((lanes, HIDDEN), np.float32)
        da_all = []
        for s in range(len(xs) - 1, -1, -1):
            z, r, q, n = kept[s]
            d = back[s]
            d += carry
            rest = 1 - z
            da = np.empty((len(d), 3 * HIDDEN), np.float32)
            dz, dr, dn = da[:, :HIDDEN], da[:, HIDDEN : 2 * HIDDEN], da[:, 2 * HIDDEN :]
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            rest *= d
            dn *= rest
            np.subtract(before[s], n, out=dz)
            dz *= z
            dz *= rest
            np.subtract(1, r, out=dr)
            dr *= r
            dr *= q
            dr *= dn
            da_all.append(da)
            db = da.copy()
            db[:, 2 * HIDDEN :] *= r
            grads["u"] += before[s].T @ db
            carry = db @ w["u"].T
            d *= z
            carry += d
            carry *= (xs[s] != 0)[:, None]
        flat, da = xs[::-1].reshape(-1), np.ascontiguousarray(np.concatenate(da_all).T)
        for j in range(3 * HIDDEN):
            grads["wx"][:, j] = np.bincount(flat, da[j], SYMBOLS)
        size = xs.size
        for k, g in grads.items():
            g *= np.float32(1 / size)
            np.clip(g, -1, 1, out=g)
            square = g * g
            memory[k] += square
            np.sqrt(memory[k], out=square)
            g /= square
            g *= np.float32(rate)
            w[k] -= g
    return w


def likelihood(w: dict, flat: np.ndarray, sizes: np.ndarray, window: int = 32) -> np.ndarray:
    """log10-probability of each of the documents in flat (symbols, each document closed by 0)."""
    total = np.zeros(len(sizes))
    if not len(sizes):
        return total
    start = np.cumsum(sizes) - sizes
    before = np.concatenate([[0], flat[:-1]])  # a document starts after an end
    order = np.argsort(-sizes, kind="stable")
    size, start = sizes[order], start[order]
    h = np.zeros((len(sizes), HIDDEN), np.float32)
    for t0 in range(0, int(size[0]), window):
        a = int(np.searchsorted(-size, -t0, "left"))  # those longer than t0
        h = h[:a]
        at = np.minimum(start[:a, None] + t0 + np.arange(window), len(flat) - 1)
        live = t0 + np.arange(window) < size[:a, None]
        x, states = before[at], []
        for s in range(min(window, int(size[0]) - t0)):
            h, _ = _cell(w, x[:, s], h)
            states.append(h)
        k = len(states)
        live, y = live[:, :k].T.reshape(-1), flat[at][:, :k].T.reshape(-1)
        owner = np.tile(np.arange(a), k)[live]
        hs, y = np.concatenate(states)[live], y[live]
        for lo in range(0, len(y), 65_536):
            out, _ = _output(w, hs[lo : lo + 65_536], y[lo : lo + 65_536])
            total[:a] += np.bincount(owner[lo : lo + 65_536], out, a)
    out = np.zeros(len(sizes))
    out[order] = total / np.log(10)
    return out


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased words between ASCII blanks."""
    return text.lower().split()


def utf8(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


def signatures(flat: np.ndarray, sizes: np.ndarray, marks: int):
    """For documents of places in flat, SIGNED at a time: the square roots of the marks' counts, of length SCALE, and the places."""
    ends = np.cumsum(sizes)
    for lo in range(0, len(sizes), SIGNED):
        size = sizes[lo : lo + SIGNED]
        own = flat[ends[lo] - sizes[lo] : ends[lo + len(size) - 1]]
        owner = np.repeat(np.arange(len(size)), size)
        mark = (own >= 0) & (own < marks)
        x = np.sqrt(np.bincount(owner[mark] * marks + own[mark], minlength=len(size) * marks).reshape(len(size), marks))
        yield np.rint(SCALE * unit(x)), owner, own


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centres(together: np.ndarray, many: int = TOPICS) -> np.ndarray:
    """Centres of topics from the marks' products over all documents: a mark's row is the mean signature of its documents."""
    seen = unit(together[together.any(1)].astype(float)) if len(together) else together
    seen = np.unique(seen, axis=0) if len(seen) else seen
    if not len(seen):
        return np.zeros((1, len(together)))
    c = [seen.mean(0)]
    for _ in range(many - 1):  # the mark least like all centres so far
        c.append(seen[int(np.argmin(np.max(seen @ unit(np.array(c)).T, 1)))])
    c = unit(np.array(c))
    for _ in range(12):
        own = np.argmax(seen @ c.T, 1)
        c = unit(np.array([seen[own == k].sum(0) if (own == k).any() else c[k] for k in range(len(c))]))
    return np.rint(SCALE * c)


def _placed(batches):
    """Places and sizes of the documents of a task's slices."""
    for b in sliced(batches, ("places",), 4 * STREAM):
        held = b.column("places").to_pylist()
        yield np.frombuffer(b"".join(held), "<i4"), np.array([len(x) // 4 for x in held], np.int64)


def _summed(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of arrays of whole numbers, one a task, over a tree of tasks."""

    def add(batches):
        total = None
        for b in sliced(batches, ("v",)):
            for v in b.column("v").to_pylist():
                v = np.frombuffer(v, "<i8")
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    parts = durable(parts)
    while (k := parts.count()) > 1:  # a single array reaches the driver
        parts = durable(parts.repartition(-(-k // FAN_IN)).mapInArrow(add, "v binary"))
    return sum((np.frombuffer(r["v"], "<i8") for r in parts.collect()), np.zeros(int(np.prod(shape)), np.int64)).reshape(shape)


def topics(learned: DataFrame, marks: int) -> np.ndarray:
    """Centres of topics from all rows (places): only the marks' products, a square matrix, reach the driver."""

    def run(batches):
        total = np.zeros((marks, marks))
        for flat, sizes in _placed(batches):
            for x, _, _ in signatures(flat, sizes, marks):
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], ["v"])

    return centres(_summed(learned.mapInArrow(run, "v binary"), (marks, marks)))


def word_topics(learned: DataFrame, found: np.ndarray, many: int) -> np.ndarray:
    """The topic of each of many words that has most of its occurrences in all rows (places)."""
    blob = learned.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        c = blob.value
        total = np.zeros(len(c) * many, np.int64)
        for flat, sizes in _placed(batches):
            for x, owner, own in signatures(flat, sizes, c.shape[1]):
                known = own >= 0
                total += np.bincount(np.argmax(x @ c.T, 1)[owner[known]] * many + own[known], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], ["v"])

    return np.argmax(_summed(learned.mapInArrow(run, "v binary"), (len(found), many)), 0)


def word_counts(learned: DataFrame) -> DataFrame:
    """(word, n) over all texts; each batch is counted before it is shuffled."""

    def run(batches):
        for b in sliced(batches, most=BYTES):
            c: Counter[bytes] = Counter()
            for t in utf8(b.column("text")):
                c.update(words(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    return learned.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Dictionary:
    """The commonest words' places and logarithms of their counts and one."""

    def __init__(self, found: list[tuple[bytes, int]]):
        self.index = {w: i for i, (w, _) in enumerate(found)}
        self.logs = np.log10(np.append(np.array([n for _, n in found], float), 0) + 1)

    def coded(self, texts: list[bytes]):
        """Places of all words (-1: none), words of each text, and the words without a place by text."""
        places, sizes, rare = [], [], []
        get = self.index.get
        for t in texts:
            ws = words(t)
            p = np.fromiter(map(get, ws, repeat(-1)), np.int32, len(ws))
            places.append(p)
            sizes.append(len(ws))
            rare.append(Counter([ws[i] for i in np.flatnonzero(p < 0).tolist()]))
        return np.concatenate([*places, np.zeros(0, np.int32)]), np.array(sizes, np.int64), rare


class Vocabulary:
    """The dictionary's symbols by place, and how a symbol's word is drawn."""

    def __init__(self, found: list[tuple[bytes, int, int]], ends: int, others: int):
        """found: words, counts and topics, commonest first; ends and others: how often those two symbols stand."""
        n = np.array([c for _, c, _ in found], float)
        topic = np.array([t for _, _, t in found], int)
        self.symbol = np.full(len(found) + 1, OTHER, np.uint16)
        self.drawn = np.zeros(len(found) + 1)
        self.mass = np.zeros(SYMBOLS)
        self.mass[[END, OTHER]] = ends, others
        sizes = np.bincount(topic, n, TOPICS) if len(found) else np.zeros(TOPICS)
        share = np.zeros(TOPICS, int)
        share[sizes > 0] = 1
        for _ in range(CLASSES - 1 - share.sum() if share.any() else 0):
            share[int(np.argmax(sizes / np.maximum(share, 1) * (sizes > 0)))] += 1
        first = 1
        for t in range(TOPICS):
            own = np.flatnonzero(topic == t) if len(found) else np.zeros(0, int)
            if not len(own):
                continue
            place = np.arange(len(own))
            tail = place >= share[t] * (EACH - 1)
            cls = first + np.minimum(place // (EACH - 1), share[t] - 1)
            self.symbol[own] = np.where(tail, cls * EACH, cls * EACH + 1 + place % (EACH - 1))
            if tail.any():
                self.drawn[own[tail]] = np.log10(n[own[tail]] / n[own[tail]].sum())
            first += share[t]
        if len(found):
            self.mass += np.bincount(self.symbol[:-1], n, SYMBOLS)

    def symbols(self, places: np.ndarray) -> np.ndarray:
        """Symbols of places, -1 any word without one and -2 the end."""
        return np.append(self.symbol[:-1], np.array([END, OTHER], np.uint16))[places]

    def logs_drawn(self, places: np.ndarray) -> np.ndarray:
        return np.append(self.drawn[:-1], [0.0, 0.0])[places]


def _listed(rare: list[dict[bytes, int]]) -> pa.ListArray:
    """Words and their counts, a list for each text."""
    words_, counts = (pa.array(list(chain.from_iterable(map(part, rare))), kind) for part, kind in ((dict.keys, pa.binary()), (dict.values, pa.int32())))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rare)]), pa.int32()), pa.StructArray.from_arrays([words_, counts], ["word", "k"]))


def encoded(rows: DataFrame, dictionary) -> DataFrame:
    """Each row's places, closed by -2, and what its base adds up to; texts are read once for all that follows."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        task, i, v = TaskContext.get().partitionId(), 0, dictionary.value
        for b in sliced(batches, most=BYTES):
            places, sizes, rare = v.coded(utf8(b.column("text")))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            by = lambda x, o=owner, k=len(sizes): np.bincount(o, x, k).astype(float)
            flat, ends = np.insert(places, np.cumsum(sizes), -2).astype("<i4"), np.cumsum(sizes + 1)
            uid = (task << 40) + i + np.arange(len(sizes))
            i += len(sizes)
            columns = {
                "uid": pa.array(uid, pa.int64()), "doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "h": b.column("h"), "words": pa.array(sizes, pa.int64()),
                "known": pa.array(by(places >= 0).astype(np.int64)), "logs": pa.array(by(v.logs[places])), "drawn": pa.array(by(places < 0)),
                "places": pa.array([flat[e - k - 1 : e].tobytes() for k, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary()),
                "rare": _listed(rare),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    found = rows.select("doc_id", "text", "held_out", "h").mapInArrow(run, f"uid long, doc_id {kind}, held_out boolean, h long, words long, known long, logs double, drawn double, places binary, rare array<struct<word:binary,k:int>>")
    return durable(found)


_MODEL = "n long, w binary"


def _row(n: int, w: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w.astype(np.float32).tobytes()], pa.binary())], ["n", "w"])


def _learn(start: np.ndarray, memory: float, passes: int, vocabulary: Vocabulary):
    """For mapInArrow over rows (shard, places), by shard: from the start, one model a shard, times its symbols."""

    def run(batches):
        shard = held = None
        w = state = None
        size = n = 0

        def more():
            nonlocal w, size
            stream = vocabulary.symbols(np.frombuffer(b"".join(held), "<i4"))
            for _ in range(passes):
                w = train(w, stream, state)
            held.clear()
            size = 0

        for b in sliced(batches, ("places",)):
            for s, x in zip(b.column("shard").to_pylist(), b.column("places").to_pylist(), strict=True):
                if s != shard:
                    if shard is not None:
                        more()
                        yield _row(n, packed(w).astype(np.float64) * n)
                    shard, held, size, n = s, [], 0, 0
                    w, state = unpacked(start.copy()), {k: np.full(z, memory, np.float32) for k, z in _SHAPES.items()}
                held.append(x)
                size += len(x) // 4
                n += len(x) // 4
                if size >= STREAM:
                    more()
        if shard is not None:
            more()
            yield _row(n, packed(w).astype(np.float64) * n)

    return run


def _total(batches):
    n, w = 0, None
    for b in batches:
        for k, v in zip(b.column("n").to_pylist(), b.column("w").to_pylist(), strict=True):
            v = np.frombuffer(v, np.float32).astype(np.float64)
            n, w = n + k, v if w is None else w + v
    if w is not None:
        yield _row(n, w)


def trained(rows: DataFrame, vocabulary, mass: np.ndarray, total: int) -> dict:
    """Weights learned from all rows (h, places), which hold total symbols.

    The first shard, of the rows of smallest hash with about WARM words in all, gives the first weights.
    From them every shard of about SHARD words, dealt and ordered by hash, learns alone; the models are
    averaged by their words over a tree of tasks. Neither files nor tasks change the result.
    """
    w = initial(mass)
    if not total:
        return w
    spark = rows.sparkSession
    share = min(1.0, WARM / total)
    few = rows.filter(F.col("h") < F.lit(int(share * 2.0**63) * 2 - 2**63 if share < 1 else 2**63 - 1)).withColumn("shard", F.lit(0))
    start = spark.sparkContext.broadcast(packed(w))
    got = few.repartition(1).sortWithinPartitions("h").select("shard", "places").mapInArrow(lambda b: _learn(start.value, 1e-6, PASSES, vocabulary.value)(b), _MODEL).head()
    if got is None:
        return w
    first = (np.frombuffer(got["w"], np.float32).astype(np.float64) / got["n"]).astype(np.float32)
    warm = spark.sparkContext.broadcast(first)
    shards = -(-total // SHARD)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))).select("shard", "h", "places").repartition("shard").sortWithinPartitions("shard", "h")
    models = durable(dealt.select("shard", "places").mapInArrow(lambda b: _learn(warm.value, 1e-4, 1, vocabulary.value)(b), _MODEL))
    while (k := models.count()) > FAN_IN:
        models = durable(models.repartition(-(-k // FAN_IN)).mapInArrow(_total, _MODEL))
    got = sorted((r["n"], bytes(r["w"])) for r in models.collect())
    return unpacked(sum(np.frombuffer(v, np.float32).astype(np.float64) for _, v in got) / sum(n for n, _ in got))


def scores(docs: DataFrame, fold: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row's whole text.

    The base is the add-one unigram over all training words. The model's network gives symbols;
    from a symbol of many words, the word is drawn by their counts. Null and empty texts are one
    end token; with no training rows every base is 0 and the network is as it starts. Null ids are
    scored, repeated rows have a row each, further columns are ignored. Words beyond the broadcast
    dictionary meet their counts in a join.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (remainder(F.col("doc_id"), fold) == held).alias("held_out"), F.xxhash64("doc_id", content_key(F.col("text"))).alias("h"))
    learned = rows.filter("not held_out")
    ends = learned.count()
    counts = durable(word_counts(learned))
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    common = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()]
    n_all, v_all = total + ends, distinct + (ends > 0)
    others = total - sum(n for _, n in common)
    other = others + distinct - len(common) + 1  # add-one weight of the words beyond the dictionary and of an unseen one
    coded = encoded(rows, spark.sparkContext.broadcast(Dictionary(common)))
    taught, topic = coded.filter("not held_out").select("h", "places"), np.zeros(0, int)
    if common:
        topic = word_topics(taught.select("places"), topics(taught.select("places"), min(MARKS, len(common))), len(common))
    vocabulary = Vocabulary([(w, n, t) for (w, n), t in zip(common, topic.tolist(), strict=True)], ends, others)
    blob = spark.sparkContext.broadcast(vocabulary)
    weights = spark.sparkContext.broadcast(trained(taught, blob, vocabulary.mass, n_all))
    own = spark.createDataFrame([(w,) for w, _ in common], "word binary")  # at most DICTIONARY rows
    rest = counts.join(F.broadcast(own), "word", "left_anti").select("word", "n")

    def run(batches):
        for b in sliced(batches, ("places",), 8_000_000):
            held = b.column("places").to_pylist()
            sizes = np.array([len(x) // 4 for x in held], np.int64)
            flat = np.frombuffer(b"".join(held), "<i4")
            net = likelihood(weights.value, blob.value.symbols(flat), sizes)
            net += np.bincount(np.repeat(np.arange(len(sizes)), sizes), blob.value.logs_drawn(flat), len(sizes))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(net)], [*names, "net"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["uid", "doc_id", "held_out", "words", "known", "logs", "drawn"]
    scored = coded.select(*names, "places").mapInArrow(run, f"uid long, doc_id {kind}, held_out boolean, words long, known long, logs double, drawn double, net double")
    met = coded.select("uid", F.inline("rare")).join(rest, "word").withColumnRenamed("uid", "of")
    met = met.groupBy("of").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("k").alias("found"))
    out = scored.join(met, F.col("uid") == F.col("of"), "left")
    more = F.coalesce("more", F.lit(0.0))
    base = F.col("logs") + more + float(np.log10(ends + 1)) - (F.col("words") + 1) * float(np.log10(n_all + v_all + 1))
    score = F.col("net") + more - F.col("drawn") * float(np.log10(other))
    known = F.col("known") + F.coalesce("found", F.lit(0)) + int(ends > 0)
    return out.select("doc_id", "held_out", (F.col("words") + 1).alias("n_tokens"), known.cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
