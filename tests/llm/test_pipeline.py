"""Each stage of the pipeline on a small corpus, against brute force on that stage's own input."""

import collections
import random

import corpus_pipeline
from evtally.llm import quality, suffix_dedup
from evtally.llm.common import durable, table

R = random.Random(11)
SAY = lambda n: " ".join(f"{R.choice('abcdefgh')}{R.randrange(300)}" for _ in range(n))
ITEM, PASSAGE, LONG = SAY(12), SAY(70), SAY(120)
TEXTS = [SAY(80), SAY(30) + " " + PASSAGE, PASSAGE + " " + SAY(25), SAY(20) + " " + ITEM + " " + SAY(9), None, "", "a", LONG, LONG + " end", LONG, SAY(5)]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def near(rows):
    """Ids that stay when the smallest id of each component of 0.8 on five words does."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = min(root[a], root[b])
    return {i for i in sets if root[i] == i}


def without(rows, size):
    """Texts without the bytes of strings of that size that start anywhere else too."""
    data = {i: (t or "").encode() for i, t in rows}
    seen = collections.Counter(b[k : k + size] for b in data.values() for k in range(len(b) - size + 1))
    out = {}
    for i, b in data.items():
        gone = {p for k in range(len(b) - size + 1) if seen[b[k : k + size]] > 1 for p in range(k, k + size)}
        out[i] = bytes(x for p, x in enumerate(b) if p not in gone).decode()
    return out


def test_stages(spark, tmp_path):
    docs = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(TEXTS)]
    for name, rows, kind in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("benchmark", [(1, ITEM), (2, None)], "item_id long, text string"),
        ("labels", [(i, 1, 0) for i in range(8)] + [(10, 0, 0)], "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    now, got = table(spark, tmp_path, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        was, now = now, durable(stage(spark, now, str(tmp_path)))
        got.append(([tuple(r) for r in was.select("doc_id", "text").collect()], now.collect()))
        if stage is not corpus_pipeline.source_mix:
            assert now.columns == COLUMNS
        if stage is corpus_pipeline.quality_filter:
            model = quality.fit(was, table(spark, tmp_path, "labels"))
            assert {r[0] for r in got[0][1]} == {r["doc_id"] for r in quality.classify(was, model).collect() if r["score"] >= 0.3}
    assert {r[0] for r in got[1][1]} == near(got[1][0])
    assert {r[0]: r[1] for r in got[2][1]} == without(got[2][0], corpus_pipeline.PASSAGE)
    assert {r[0] for r in got[3][1]} == {i for i, t in got[3][0] if ITEM[: len(ITEM.rsplit(" ", 2)[0])] not in (t or "")}
    assert {r["doc_id"] for r in got[4][1]} == {i for i, _ in got[4][0]}
    sizes = {i: len((t or "").split()) for i, t in got[4][0]}
    assert all(r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] for r in got[4][1])


def test_one_row_of_each_component(spark, tmp_path):
    """Repeated rows and copies without an id leave one whole text, which the next stage then keeps."""
    one, two, three = SAY(120), SAY(120), SAY(120)
    rows = [(1, one), (1, one), (2, one + " end"), (None, two), (None, two), (None, two + " end"), (None, three), (3, three), (4, ""), (4, ""), (None, None), (5, SAY(50)), (None, SAY(50))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = durable(corpus_pipeline.near_dedup_filter(spark, docs, str(tmp_path)))
    kept = [tuple(r) for r in got.select("doc_id", "text").collect()]
    texts = [t for i, t in kept if i is None and t in (two, two + " end")]
    assert len(texts) == 1 and sorted(kept, key=str) == sorted([(1, one), (None, texts[0]), (3, three), (4, ""), (None, None), rows[-2], rows[-1]], key=str)
    passed = corpus_pipeline.passage_removal(spark, got, str(tmp_path)).collect()
    assert sorted(r["text"] for r in passed) == sorted(t or "" for _, t in kept)


def test_passage_in_every_text(spark, tmp_path, monkeypatch):
    """The suffix-array stage removes a passage that crowds all levels, and none of its steps makes a row of each window."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 15_000)
    made, write = [], suffix_dedup.durable

    def counted(df):
        out = write(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(suffix_dedup, "durable", counted)
    r = random.Random(31)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = say(300)
    rows = [(i, say(150) + passage + say(150)) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.passage_removal(spark, docs, str(tmp_path)).collect()}
    assert got == without(rows, corpus_pipeline.PASSAGE) and max(made) <= 20 * len(rows), made
