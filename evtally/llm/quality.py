"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, remainder, sliced

#: About the most labelled ids that a model learns from, and what it learns.
SAMPLE, BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 20_000, 32, 8, 6, 120, 0.15
FEATURES = ("words", "word_len", "upper", "digit", "mark", "pipe", "bang", "symbol", "distinct", "commonest", "run", "lines", "twice", "line_len", "wide", "tail", "bad_lines", "short_words")
_SYMBOL, _TAIL = re.compile(r"[#$%&*@^~=<>]"), re.compile(r"[^\w\s.,;:'\"!?)\]-]{2,}(?=\s|$)|!!(?=\s|$)")


def features(text: str) -> list[float]:
    """Shape of a whole text, all finite; the empty text has zeros."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [x for x in text.split("\n") if x.strip()]
    counts, seen = Counter(words), Counter(lines)
    alnum = sum(map(len, re.findall(r"[^\W_]+", text)))
    run = best = 1
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        best = max(best, run)
    caps, symbols, bangs, pipes = sum(map(str.isupper, words)), len(_SYMBOL.findall(text)), text.count("!!"), text.count("|")
    bad = sum(1 for x in lines if x.count("|") + x.count("!!") + len(_SYMBOL.findall(x)) > 0.2 * (1 + x.count(" ")))
    return [
        float(np.log1p(n)), size / n, caps / n, sum(map(str.isdigit, text)) / size, 1 - (alnum + n) / (size + 1), pipes / n, bangs / n, symbols / n,
        len(counts) / n, max(counts.values()) / n, float(np.log1p(best)), len(lines) / n, 1 - len(seen) / len(lines), float(np.log1p(size / len(lines))),
        sum(1 for c in text if c > "\x7f") / size, len(_TAIL.findall(text)) / n, bad / len(lines), sum(1 for w in words if len(w) < 4) / n,
    ]


def steps(g: np.ndarray, h: np.ndarray, depth: int = 2, least: float = 4.0) -> np.ndarray:
    """A shallow tree over ordered bins: its leaf value for each bin, from gradients and weights."""
    out = np.full(len(g), g.sum() / (h.sum() + 1))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1), -1)
        k = int(gain.argmax()) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            out = np.concatenate([steps(g[:k], h[:k], depth - 1, least), steps(g[k:], h[k:], depth - 1, least)])
    return out


class Gam:
    """Lookup tables for single features and for pairs, fitted by cyclic boosting; the sum is a logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        d = x.shape[1]
        q = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], q)) for f in range(d)]
        self.coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for f in range(d)]
        rate = (y.sum() + 1) / (len(y) + 2)
        self.base, self.one, self.pairs, self.two = float(np.log(rate / (1 - rate))), [np.zeros(BINS) for _ in range(d)], [], []
        fine, z = self.binned(x, self.edges), np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for f in range(d):
                p = 1 / (1 + np.exp(-z))
                t = RATE * steps(*(np.bincount(fine[:, f], v, BINS) for v in (y - p, p * (1 - p) + 1e-3)))
                self.one[f] += t
                z += t[fine[:, f]]
        wide, size = self.binned(x, self.coarse), PAIR_BINS**2

        def cells(a, b, p):
            at = wide[:, a] * PAIR_BINS + wide[:, b]
            return at, np.bincount(at, y - p, size), np.bincount(at, p * (1 - p) + 1e-3, size)

        p = 1 / (1 + np.exp(-z))
        gain = {(a, b): (lambda c: float((c[1] ** 2 / (c[2] + 2)).sum()))(cells(a, b, p)) for a in range(d) for b in range(a)}
        self.pairs = sorted(gain, key=lambda k: (-gain[k], k))[:PAIRS]
        self.two = [np.zeros(size) for _ in self.pairs]
        for _ in range(ROUNDS // 4):
            for i, (a, b) in enumerate(self.pairs):
                at, g, h = cells(a, b, 1 / (1 + np.exp(-z)))
                g, h = g.reshape(PAIR_BINS, -1), h.reshape(PAIR_BINS, -1)
                rows = steps(g.sum(1), h.sum(1), 1)  # a first split on one feature, then on the other within each side
                t = np.zeros_like(g)
                for v in np.unique(rows):
                    t[rows == v] = steps(g[rows == v].sum(0), h[rows == v].sum(0), 1)
                t = RATE * t.reshape(-1)
                self.two[i] += t
                z += t[at]

    @staticmethod
    def binned(x, edges):
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], 1) if len(x) else np.zeros((0, len(edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        fine, wide, z = self.binned(x, self.edges), self.binned(x, self.coarse), np.full(len(x), self.base)
        for f, t in enumerate(self.one):
            z += t[fine[:, f]]
        for (a, b), t in zip(self.pairs, self.two, strict=True):
            z += t[wide[:, a] * PAIR_BINS + wide[:, b]]
        return 1 / (1 + np.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    """Learn from labelled ids outside the held-out fold: all of them, or about sample, those of smallest hash.

    Null labels and ids teach nothing; an id labelled twice counts with its mean, an id with several
    rows once, with the least features. With no row of its kind to learn from, the model gives one
    half, or the only label's smoothed share.
    """
    known = labels.filter("doc_id is not null and quality is not null").filter(remainder(F.col("doc_id"), 5) != 0)
    known = durable(known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y")))
    n = known.count()
    if n > sample:
        known = known.filter(F.xxhash64("doc_id") < int((2 * sample / n - 1) * 2.0**63))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([features(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64())), b.column("y")], ["doc_id", "x", "y"])

    got = rows.mapInArrow(run, f"doc_id {kind}, x array<double>, y double").groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("r.x", "r.y").collect()
    got = sorted((tuple(r["x"]), r["y"]) for r in got)
    x = np.array([x for x, _ in got], float).reshape(-1, len(FEATURES))
    return Gam(x, np.array([y for _, y in got])) if got else Gam(np.zeros((1, len(FEATURES))), np.array([0.5]))


def classify(docs: DataFrame, model: Gam, cut: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns of keep of every row; texts are scored whole.

    Null texts count as empty, whose features are zeros. Repeated rows and null ids stay (a null
    id counts as held out); further columns are ignored. Rows need no shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in sliced(batches):
            x = np.array([features(t or "") for t in b.column("text").to_pylist()], float).reshape(-1, len(FEATURES))
            own = [b.column(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(model.value.score(x))], ["doc_id", *keep, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    text = [] if "text" in keep else [F.coalesce("text", F.lit("")).alias("text")]
    out = docs.select("doc_id", *keep, *text).mapInArrow(run, f"{kinds}, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), *keep)
