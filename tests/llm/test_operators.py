"""Operators on small tables: nulls, empty and repeated rows, extra columns, and brute force."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evtally.llm import decontaminate, fingerprints, licenses, lm_scoring, mixing, near_dedup, quality, suffix_dedup, token_counts, url_filter
from evtally.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long"
R = random.Random(5)
WORDS = [f"w{i}" for i in range(500)]
SAY = lambda n: " ".join(R.choice(WORDS) for _ in range(n))
PASSAGE, ITEM = SAY(150), SAY(14)
TEXTS = [SAY(60), SAY(40) + " " + PASSAGE, PASSAGE + " " + SAY(30), SAY(20) + " " + ITEM.upper() + ". " + SAY(9), None, "", " \n", "a", "A", SAY(60) + "\nReleased under the MIT License.", "é" * 500]
TEXTS += [TEXTS[0], TEXTS[0]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, [None, "", "a", "b"][i % 4], None, "x", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, TEXTS[0], None, None, None, None, None), rows[0]], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "a"), (None, "w1"), (4, "zzz")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contaminated(docs, items).collect()}
    assert got[3]["n_hit"] == 14 and got[3]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert got[7]["n_hit"] == got[8]["n_hit"] == 1 and not got[0]["contaminated"] and got[4]["n_words"] == 0
    assert decontaminate.contaminated(docs, items).count() == docs.count()
    assert decontaminate.contaminated(none, items).count() == 0
    assert (3, 1) in {tuple(r) for r in decontaminate.proximity(docs, items).collect()}


def test_proximity_has_all_words(spark):
    """Every word of the item must stand in the stretch, not only the three rarest; op1 tells the matches."""
    r = random.Random(3)
    item = [f"q{i}" for i in range(14)]
    say = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    mixed, spread = list(item), [x for w in item for x in (w, "a")]
    r.shuffle(mixed)
    texts = {
        1: say(30) + " " + " ".join(mixed) + " " + say(30),  # in another order
        2: say(9) + " " + " ".join(spread) + " " + say(5),  # 27 words
        3: say(9) + " " + " ".join(item[:13]) + " " + say(40),  # one word short
        4: " ".join(item[:7]) + " " + say(60) + " " + " ".join(item[7:]),  # too far apart
        5: " ".join(f"{w} {w}" for w in item[1:]) + " " + say(25),  # the others, twice
        6: item[0] + " " + " ".join(item[:7]) + " " + say(20) + " " + " ".join(item[7:]),  # exactly 34 words
        7: " ".join(item[:7]) + " " + say(21) + " " + " ".join(item[7:]),  # 35
    }
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(8, None), (None, texts[1]), (1, texts[1])], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "zzz")], "item_id long, text string")

    def want(t):
        w = (t or "").split()
        return any(set(item) <= set(w[i : i + 34]) for i in range(len(w)))

    assert {tuple(x) for x in decontaminate.proximity(docs, items).collect()} == {(i, 1) for i, t in [*texts.items(), (None, texts[1])] if want(t)} == {(1, 1), (2, 1), (6, 1), (None, 1)}
    rows = decontaminate.contaminated(docs, items, slop=20).collect()
    assert len(rows) == 10 and {x["doc_id"] for x in rows if x["n_near"] == 1} == {1, 2, 6, None}
    assert {x["near_sha256"] for x in rows if x["n_near"]} == {hashlib.sha256(b"1").hexdigest()}


def test_suffix_dedup(docs):
    texts = [(r["text"] or "").encode() for r in docs.collect()]
    seen = collections.Counter(b[i : i + 400] for b in texts for i in range(len(b) - 399))
    want = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        want.append((len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = [(r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.dedup(docs).collect()]
    assert sorted(got) == sorted(want) and sum(x[1] for x in want)


@pytest.mark.parametrize("chunk", [0, 3000, 10**6])
def test_suffix_dedup_crowded_keys(spark, monkeypatch, chunk):
    """Keys with more bytes than one task sorts go on to longer strings; the result is the same on every level."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    r = random.Random(8)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line, passage, run = say(30), say(90), "z" * 200
    texts = [say(r.randrange(60)) + r.choice([line, passage, passage[20:75], run[: r.randrange(200)]]) + say(r.randrange(60)) for _ in range(60)] + [None, "", run, line * 4]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0], texts[5]])], "doc_id long, text string")
    length, data = 40, [(t or "").encode() for t in [*texts, texts[0], texts[5]]]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    got = {x["doc_id"]: x for x in suffix_dedup.dedup(docs, length).collect()}
    for i, b in enumerate(data):
        gone = {p for k in range(len(b) - length + 1) if seen[b[k : k + length]] > 1 for p in range(k, k + length)}
        assert got[i]["kept"].encode() == bytes(x for p, x in enumerate(b) if p not in gone), i
        assert got[i]["n_removed"] == len(gone) and got[i]["n_spans"] == sum(p - 1 not in gone for p in gone)


def test_suffix_dedup_common_passage_makes_few_rows(spark, monkeypatch):
    """A passage in every text, crowded on all levels: its windows are all found, and no step makes a row of each."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 20_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 1000)
    made, write = [], suffix_dedup.durable

    def counted(df):
        out = write(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(suffix_dedup, "durable", counted)
    r = random.Random(18)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = say(600)
    texts = [say(250) + passage + say(250) for _ in range(200)]
    got = suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    seen = collections.Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    for x in got:
        t = texts[x["doc_id"]]
        gone = {p for k in range(len(t) - 399) if seen[t[k : k + 400]] > 1 for p in range(k, k + 400)}
        assert x["n_removed"] == len(gone) >= 600 and x["n_spans"] == 1
    assert max(made) <= 20 * len(texts), made  # 1101 windows a text


def test_suffix_dedup_long_text_and_empty_table(spark, none):
    r = random.Random(9)
    passage = "".join(r.choice("abcdef") for _ in range(1000))
    long = "".join(r.choice("abcdefgh\n é") for _ in range(1_500_000)) + passage + "x" * 300_000
    got = {x["doc_id"]: x for x in suffix_dedup.dedup(spark.createDataFrame([(1, long), (2, "q" + passage)], "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 301_000 and got[2]["kept"] == "q" and got[1]["n_spans"] == 1
    assert suffix_dedup.dedup(none).count() == 0


@pytest.mark.parametrize("letters", ["ab", "a", "abc"])
def test_two_stage(letters):
    parts = ["".join(R.choice(letters) for _ in range(n)).encode() for n in (60, 45, 80)]
    wanted = [len(p) - 19 for p in parts]
    joined = b"\x00".join(parts) + b"\x00"
    got = [joined[p : p + 20] for p in suffix_dedup.two_stage(parts, wanted, 20)]
    assert got == sorted(p[i : i + 20] for p, n in zip(parts, wanted, strict=True) for i in range(n))


def test_near_dedup(docs, none):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, 4).collect()}
    assert got[11]["component_id"] == got[12]["component_id"] == got[None]["component_id"] == 0 and not got[12]["kept"]
    assert got[8]["component_id"] == 7 and got[4]["kept"] and got[5]["kept"] and got[4]["n_shingles"] == 0
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_recall_at_the_threshold(spark):
    """Pairs of likeness 0.80 to 0.83 and just below, against brute force: every link is found, none is made up."""
    r = random.Random(21)
    rows = []
    for i in range(120):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(60, 300))]
        other = list(words)
        while True:
            sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in (words, other)]
            likeness = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            if likeness < 0.84:
                break
            other[r.randrange(len(other))] = "changed"
        rows += [(2 * i, " ".join(words), likeness), (2 * i + 1, " ".join(other), likeness)]
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), 4).collect()}
    linked = [i for i, _, likeness in rows if i % 2 and likeness >= 0.8]
    assert len(linked) > 60 and all(got[i] == i - 1 for i in linked)
    assert all(got[i] == i for i, _, likeness in rows if likeness < 0.8)
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 4, 70)


def test_register_likelihood():
    a = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x, y = near_dedup.registers([near_dedup.mix(a[:1800]), near_dedup.mix(a[200:])])
    est = near_dedup.likelihood(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([1800.0]), np.array([1800.0]))
    assert abs(est[0] - 0.8) < 0.12


def test_token_counts(docs, none, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer_file())
    for r in token_counts.count_tokens(docs, tokenizer_file()).filter("doc_id is not null").collect():
        text = TEXTS[r["doc_id"]] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
    assert token_counts.count_tokens(none, tokenizer_file()).count() == 0
    spec = json.loads(open(tokenizer_file(), encoding="utf-8").read())
    counter = token_counts.Counter(json.dumps(spec))
    for text in ("ab" * 30_000, "a" * 20_000, "<|endoftext|>x <|endoftext|>", " \u00a0\t x\n\n y's 12é", "abcdefgh" * 200):
        assert counter.tokens(text) == len(t.encode(text, add_special_tokens=False).ids)
    for part, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("model", spec["model"] | {"byte_fallback": True})):
        with pytest.raises(ValueError, match=part):
            token_counts.understood(spec | {part: value})


def _next(rows):
    """Rows with the next one's text, by descending id, nulls last, equal ids by the text's md5."""
    key = lambda r: hashlib.md5((r[1] or "").encode()).digest()
    rows = sorted(sorted(rows, key=key), key=lambda r: (r[0] is None, -r[0] if isinstance(r[0], int) else 0))
    return [(i, t or "", rows[(k + 1) % len(rows)][1] or "") for k, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("each", [1, 3, 20_000])
def test_fingerprints(docs, none, each):
    """Neighbours, edited texts and likenesses against plain Python, with buckets of one row and of all."""
    rows = fingerprints.fingerprint_pairs(docs, each).collect()
    want = []
    for i, t, after in _next([tuple(r) for r in docs.select("doc_id", "text").collect()]):
        k = len(t) // 3
        e = t[: len(t) - k] + after[:k]
        a, b, c = map(fingerprints.sketch, (t, e, after))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.dump(a), fingerprints.dump(b), fingerprints.jaccard(a, b), fingerprints.jaccard(a, c)))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert fingerprints.fingerprint_pairs(none, each).count() == 0
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (0, 11, 12, None)}) == 1


def test_fingerprints_of_text_ids_and_null_ids(spark):
    ids = ["b", "a", "c", None, "aa", "a", None]
    docs = spark.createDataFrame([(i, f"text {k} " * 9) for k, i in enumerate(ids)], "doc_id string, text string")
    got = {(r["doc_id"], r["fingerprint"]) for r in fingerprints.fingerprint_pairs(docs, 2).collect()}
    assert len(got) == 7 and fingerprints.fingerprint_pairs(docs.limit(1), 2).head()["near_next"] == 1
    empty = spark.createDataFrame([(None, None), (None, ""), (None, "x")], "doc_id long, text string")
    assert sorted(r["near_next"] for r in fingerprints.fingerprint_pairs(empty, 1).collect()) in ([0, 0, 1], [0, 1, 1])


def test_sketches():
    """Estimates against whole shingle sets, for texts of all lengths; strings of sketches come back the same."""
    r = random.Random(2)
    say = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    sets = lambda t: {t[i : i + 9] for i in range(max(1, len(t) - 8))}
    off = []
    for n in (20, 100, 200, 800, 2000, 9000, 9000):
        common, a, b = say(n), say(n // 3), say(n // 2)
        x, y = common + a, common + b
        sx, sy = fingerprints.sketch(x), fingerprints.load(fingerprints.dump(fingerprints.sketch(y)))
        off.append(abs(fingerprints.jaccard(sx, sy) - len(sets(x) & sets(y)) / len(sets(x) | sets(y))))
        assert fingerprints.dump(sy) == fingerprints.dump(fingerprints.sketch(y)) and fingerprints.containment(sx, fingerprints.merge(sx, sy)) == 1
        assert len(fingerprints.dump(sx)) < 1400 + 0.4 * len(x)
    assert max(off) < 0.2 and sum(off) / len(off) < 0.06
    long = say(300_000)
    assert abs(fingerprints.containment(fingerprints.sketch(long[5000:7000] + say(2000)), fingerprints.sketch(long)) - 0.5) < 0.15
    assert fingerprints.jaccard(fingerprints.sketch("a" * 5000), fingerprints.sketch("b" * 5000)) == 0
    assert fingerprints.jaccard(fingerprints.sketch(""), fingerprints.sketch("")) == 1 and fingerprints.jaccard(fingerprints.sketch(""), fingerprints.sketch("a")) == 0
    big = fingerprints.sketch("xyz " * 3_000_000)
    assert big.scale == 1 and len(big.hashes) == 4


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert abs(sum(t for t, _ in {(r["target"], r["source_size"]) for r in rows}) - sum(r["size"] for r in rows)) < 1e-6
    assert sorted(rows, key=str) == sorted(mixing.mix(docs.repartition(3)).collect(), key=str) and mixing.mix(none).count() == 0


def test_mixing_targets(spark):
    """Targets are the fixed point of cutting and resharing; taken words come near them; copies are whole."""
    r = random.Random(6)
    rows, sizes = [], collections.defaultdict(int)
    for i in range(3000):
        source = [None, "a", "b", "c", "d", "tiny"][min(5, i % 5 + (i % 300 == 0) * 5)]
        n = int(r.paretovariate(1.1)) % 400
        rows.append((i, "x " * n, source))
        sizes[source] += n
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        whole = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / whole > 3 * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / whole for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    name = {i: s for i, _, s in rows}
    taken = collections.defaultdict(int)
    for x in got:
        s = name[x["doc_id"]]
        taken[s] += x["taken"]
        assert x["target"] == pytest.approx(target[s]) and x["source_size"] == sizes[s] and x["taken"] <= 3 * x["size"]
        assert x["size"] == 0 or x["taken"] % x["size"] == 0
    assert "tiny" in sizes and all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 20 for s in sizes), (dict(taken), target)


def test_licenses(docs, none):
    assert [r[:2] for r in licenses.scan(docs).collect()] == [(9, "MIT")] and licenses.scan(none).count() == 0 and licenses.scan(docs, {}).count() == 0


def test_license_texts_and_shortest_statement(spark):
    """Three words are found among thirteen other shingles in each of 300 texts, and every template in its own text."""
    r = random.Random(4)
    say = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    rows = [(i, say(5 + i % 9) + " Released All rights reserved. " + say(20)) for i in range(300)]
    rows += [(1000 + i, say(30) + "\n" + t + "\n" + say(30)) for i, t in enumerate(licenses.TEMPLATES.values())]
    got = {(x["doc_id"], x["license"]) for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, "All-rights-reserved") for i in range(300)} <= got
    assert {(1000 + i, name) for i, name in enumerate(licenses.TEMPLATES)} <= got
    families = {"MIT", "ISC", "BSD", "Apache", "GPL", "LGPL", "AGPL", "MPL", "CC0", "All"}
    assert families <= {name.split("-")[0] for name in licenses.TEMPLATES}


def test_quality_and_urls(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(9)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, quality.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(none, quality.fit(none, labels.limit(0))).count() == 0
    urls = ["http://A.com/en/x", "http://a.example.com/en/7?q", "com/en/", None, "", "http://b.net/de/1#x", "x://example.net/de/8"]
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert out[0] == ("a.com", "/en/x", "com/en/", "block") and out[1][2:] == ("example.com/en/7", "allow") and out[2][:3] == ("", "", None) and out[5][2:] == ("net/de/", "allow") and out[6][3] == "block"


def test_quality_held_out(spark):
    """Held-out accuracy; neither the held-out labels nor the rows' order change the model; a sample is bounded."""
    r = random.Random(3)
    good = lambda: " ".join(SAY(r.randrange(6, 14)).capitalize() + "." for _ in range(r.randrange(3, 9)))
    junk = lambda: " | ".join(SAY(2) for _ in range(r.randrange(10, 60))) + " !!" * r.randrange(9)
    rows = [(i, junk() if i % 3 == 0 else good(), int(i % 3 != 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    turned = spark.createDataFrame([(i, 1 - y if i in held else y) for i, _, y in rows], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.classify(docs, quality.fit(docs, labels)).collect()}
    same = {x["doc_id"]: x["score"] for x in quality.classify(docs.repartition(5), quality.fit(docs.repartition(3), turned)).collect()}
    assert {i for i, x in got.items() if x["held_out"]} == held
    assert sum(got[i]["predicted"] == y for i, _, y in rows if i in held) >= 0.95 * len(held)
    assert all(same[i] == pytest.approx(x["score"]) for i, x in got.items())
    few = quality.fit(docs, labels, 100)
    assert sum(x["predicted"] == rows[x["doc_id"]][2] for x in quality.classify(docs, few).collect()) >= 0.9 * len(rows)


def test_quality_tables_add_up():
    """A score is the logistic of the sum of the tables' cells, looked up one by one."""
    g = np.random.default_rng(1)
    x = g.normal(size=(500, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = quality.Gam(x, y)
    for row, score in zip(x[:50], m.score(x[:50]), strict=True):
        z = m.base + sum(m.one[f][sum(e <= row[f] for e in m.edges[f])] for f in range(4))
        z += sum(t[sum(e <= row[a] for e in m.coarse[a]) * quality.PAIR_BINS + sum(e <= row[b] for e in m.coarse[b])] for (a, b), t in zip(m.pairs, m.two, strict=True))
        assert score == pytest.approx(1 / (1 + math.exp(-z)))
    assert ((m.score(x) > 0.5) == (y > 0.5)).mean() > 0.85  # an interaction that single tables cannot learn


def test_url_models(spark, none):
    """Scores against a plain Markov model with dictionaries; clashing columns and repeated rows; the empty table."""
    r = random.Random(7)
    word = lambda s: "".join(r.choice(s) for _ in range(r.randrange(4, 12)))
    rows = [(i, f"http://{word('abc')}.{'net/de/' + word('qrs') if i % 2 else 'org/es/' + word('xyz')}") for i in range(300)]
    rows += [(1000 + i, f"http://{word('abc')}.test/{word('qrs' if i % 2 else 'xyz')}") for i in range(60)] + [rows[0], (None, rows[1][1])]
    pages = spark.createDataFrame([(i, u, "c", "x", 0) for i, u in rows], "page_id long, url string, host string, rule string, label int")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(rows)
    apart = pages.select("url", (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("aside")).distinct().collect()
    aside = {x["url"] for x in apart if x["aside"]}
    table = [collections.Counter(), collections.Counter()]
    for _, u in rows:
        label = 1 if "net/de/" in u else 0 if "org/es/" in u else None
        if label is None or u in aside:
            continue
        for i, c in enumerate(u):
            for k in range(url_filter.ORDER + 1):
                before = ("^" * k + u[:i])[len("^" * k + u[:i]) - k :]
                table[label][k, before, c] += 1
                table[label][k, before] += 1

    def score(u):
        total = 0.0
        for label, sign in ((1, 1), (0, -1)):
            for i, c in enumerate(u):
                p = 1 / 256
                for k in range(url_filter.ORDER + 1):
                    before = ("^" * k + u[:i])[len("^" * k + u[:i]) - k :]
                    p = (table[label][k, before, c] + url_filter.BACKOFF * p) / (table[label][k, before] + url_filter.BACKOFF)
                total += sign * math.log(p)
        return total / max(1, len(u))

    by = dict(rows)
    for x in got:
        assert x["score"] == pytest.approx(score(by[x["page_id"]]), abs=0.02)
    open_ = [x for x in got if x["page_id"] is not None and x["page_id"] >= 1000]
    assert all((x["verdict"] == "allow") == (x["page_id"] % 2 == 1) for x in open_)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_counts_are_apart():
    """Each context, alone or with the byte after it, has a key of its own; marks of a url's start are no bytes."""
    r = random.Random(12)
    urls = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789./\x02") for _ in range(r.randrange(1, 60))) for _ in range(500)] + ["\x02a", "a"]
    start, _, full, short = url_filter.grams([u.encode() for u in urls])
    for k in range(url_filter.ORDER + 1):
        pairs = [((None,) * k + tuple(u[:i]))[i:] + (c,) for u in urls for i, c in enumerate(u)]
        assert len(set(full[k][~start].tolist())) == len(set(pairs)) == len(set(zip(full[k][~start].tolist(), pairs, strict=True)))
        alone = [x[:-1] for x in pairs]
        assert len(set(short[k][~start].tolist())) == len(set(alone)) == len(set(zip(short[k][~start].tolist(), alone, strict=True)))
    assert len({x for keys in (*full, *short) for x in keys[~start].tolist()}) == sum(len(set(keys[~start].tolist())) for keys in (*full, *short))


def test_url_counts_beyond_the_limit(spark, monkeypatch):
    """Only the longest contexts share bins; no count is lost, and scores stay near those of counts kept apart."""
    r = random.Random(13)
    word = lambda s: "".join(r.choice(s) for _ in range(r.randrange(4, 12)))
    rows = [(i, f"http://{word('abc')}.{'net/de/' + word('qrs') if i % 2 else 'org/es/' + word('xyz')}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    known = pages.select((F.col("page_id") % 2).cast("int").alias("label"), "url")
    codes, counts, whole = url_filter.held_counts(known)
    apart = {x["page_id"]: x["score"] for x in url_filter.judge(pages).collect()}
    assert whole == url_filter.ORDER + 1 and counts.sum() == 2 * whole * sum(len(u) for _, u in rows)
    monkeypatch.setattr(url_filter, "MOST", 500)
    monkeypatch.setattr(type(known), "toPandas", None)  # would make an object of each number in the driver
    few, n, some = url_filter.held_counts(known)
    assert 0 < some < whole and n.sum() == counts.sum()
    low = lambda c: set(c[c < 4 * some * url_filter.SPAN].tolist())
    assert 0 < len(low(few)) <= 500 and low(few) == low(codes)
    got = {x["page_id"]: x["score"] for x in url_filter.judge(pages).collect()}
    assert sum(abs(got[i] - apart[i]) < 0.02 for i in apart) >= 0.9 * len(apart)


def test_lm_edges(docs, none):
    rows = lm_scoring.scores(docs).collect()
    assert len(rows) == docs.count() and all(r["score"] < 0 for r in rows) and lm_scoring.scores(none).count() == 0
    untaught = lm_scoring.scores(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")).collect()
    assert untaught and all(r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] < 0 for r in untaught)


def _two_tongues(n):
    r = random.Random(12)
    tongues = [[f"{x}{i}" for i in range(400)] for x in "pq"]
    texts = [" ".join(r.choices(tongues[i % 2], [1 / (k + 1) for k in range(400)], k=r.randrange(20, 80))) for i in range(n)]
    return [*texts, None, "", "never-seen " * 3, "P1 p1\tP1"]


def test_lm_against_plain_counts_and_above_them(spark):
    """Base scores equal plain Python; the network knows a document's language, so held-out texts score well above the base."""
    texts = _two_tongues(1500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lm_scoring.scores(docs).collect()
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), ""] for i, t in enumerate(texts)}
    held = {i for i in words if zlib.crc32(str(i).encode()) % 7 == 2}
    c = collections.Counter(w for i, ws in words.items() if i not in held for w in ws)
    total, distinct = sum(c.values()), len(c)
    assert {r["doc_id"] for r in rows if r["held_out"]} == held and len(rows) == len(texts)
    for r in rows:
        ws = words[r["doc_id"]]
        assert r["n_tokens"] == len(ws) and r["n_known"] == sum(c[w] > 0 for w in ws) and r["train_tokens"] == total
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws), rel=1e-9)
    aside = [r for r in rows if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in aside) / sum(r["n_tokens"] for r in aside)
    assert gain > 0.1, gain
    again = {r["doc_id"]: r["score"] for r in lm_scoring.scores(docs.repartition(7)).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], abs=1e-3) for r in rows)  # neither files nor tasks matter


def test_lm_topics_come_from_all_rows(spark):
    """Six tongues, the sixth in the last twentieth of 5000 documents: none shares a topic with another, whatever the files."""
    r = random.Random(15)
    tongues = [[f"{x}{i}" for i in range(40)] for x in "pqrstu"]
    of = [5 if i >= 4750 else i % 5 for i in range(5000)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(tongues[k], k=12))) for i, k in enumerate(of)], "doc_id long, text string")
    found = sorted((w, int(n)) for w, n in collections.Counter(w for x in docs.collect() for w in x["text"].split()).items())
    found = [(w.encode(), n) for w, n in sorted(found, key=lambda x: (-x[1], x[0]))]
    rows = docs.selectExpr("doc_id", "text", "false as held_out", "doc_id as h")
    got = []
    for n in (3, 8):
        places = lm_scoring.encoded(rows.repartition(n), spark.sparkContext.broadcast(lm_scoring.Dictionary(found))).select("places")
        c = lm_scoring.topics(places, len(found))
        got.append((c.tolist(), lm_scoring.word_topics(places, c, len(found)).tolist()))
    assert got[0] == got[1]
    topic = [{t for (w, _), t in zip(found, got[0][1], strict=True) if w[:1] == x} for x in (b"p", b"q", b"r", b"s", b"t", b"u")]
    assert sum(map(len, topic)) == len(set.union(*topic)), topic
    v = lm_scoring.Vocabulary([(w, n, t) for (w, n), t in zip(found, got[0][1], strict=True)], 5000, 0)
    assert v.symbols(np.array([*range(240), -1, -2])).tolist() == [*v.symbol.tolist(), lm_scoring.END] and v.logs_drawn(np.array([3, -1, -2])).tolist() == [v.drawn[3], 0, 0]
    assert {(x["word"].decode(), x["n"]) for x in lm_scoring.word_counts(docs).collect()} == {(w.decode(), n) for w, n in found}


def test_lm_sums_reach_the_driver_as_one(spark, monkeypatch):
    made, write = [], lm_scoring.durable

    def counted(df):
        out = write(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(lm_scoring, "durable", counted)
    parts = spark.createDataFrame([(np.array([i, 1], "<i8").tobytes(),) for i in range(15)], "v binary").repartition(15)
    assert lm_scoring._summed(parts, (1, 2)).tolist() == [[105, 15]] and made == [15, 1]
    assert lm_scoring._summed(parts.limit(0), (1, 2)).tolist() == [[0, 0]]


def test_lm_is_a_distribution():
    found = [(b"a", 5, 0), (b"b", 4, 1), (b"c", 2, 0)] + [(f"t{i}".encode(), 1, 1) for i in range(2000)]
    v = lm_scoring.Vocabulary(found, 7, 9)
    w = lm_scoring.initial(v.mass)
    used = np.flatnonzero(v.mass)
    first = [10 ** lm_scoring.likelihood(w, np.array([s], np.uint16), np.array([1]))[0] for s in used]
    assert abs(sum(first) - 1) < 1e-3  # each used symbol alone, from the same state
    for s in np.unique(v.symbol[:-1]):
        own = v.drawn[:-1][v.symbol[:-1] == s]
        assert abs((10**own).sum() - 1) < 1e-9  # a symbol's words share all of it
    flat = np.array([5, 6, 7, 0, 5, 5, 0] * 200, np.uint16)
    w = lm_scoring.initial()
    before = lm_scoring.likelihood(w, flat[:7], np.array([4, 3])).sum()
    assert lm_scoring.likelihood(lm_scoring.train(w, flat), flat[:7], np.array([4, 3])).sum() > before
