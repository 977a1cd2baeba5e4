"""The registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from .common import table
from . import decontaminate, fingerprints, licenses, lm_scoring, mixing, near_dedup, quality, suffix_dedup, token_counts, url_filter


def tokenizer_file() -> str:
    """The vocabulary that op7 counts by; count_tokens() takes any other path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=20).drop("key")


def op2_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4).drop("key", "root")


def op7_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file())


def op8_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op9_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_lm_scores(spark, sf_dir):
    return lm_scoring.scores(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_url_filter, op3_quality, op4_license_scan, op5_suffix_dedup, op6_near_dedup, op7_token_counts, op8_fingerprints, op9_mix, op10_lm_scores)
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS br, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + 9], ' ') AS x
       FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT d.doc_id, d.r, i AS pos, ks.k, array_to_string(w[i:i + ks.k - 1], ' ') AS x
       FROM d, ks, unnest(range(1, len(w) - ks.k + 2)) AS t(i) WHERE len(w) >= ks.k),
m AS (SELECT dw.r, dw.pos, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.x = bw.x),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + k)) AS p FROM (SELECT DISTINCT r, pos, k FROM m)) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, cast(item_id AS varchar) AS i FROM m) GROUP BY r),
iw AS (SELECT item_id, br, len(w) + 20 AS span, len(list_distinct(w)) AS n, unnest(list_distinct(w)) AS x FROM b WHERE len(w) > 0),
o AS (SELECT r, pos, item_id, br, span, n, x FROM (SELECT r, i AS pos, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(i)) JOIN iw USING (x)),
full_ AS (SELECT r, br FROM o GROUP BY r, br HAVING count(DISTINCT x) = min(n)),
fo AS (SELECT o.* FROM o JOIN full_ USING (r, br)),
nr AS (SELECT DISTINCT r, i FROM (SELECT a.r, cast(a.item_id AS varchar) AS i FROM fo a JOIN fo z ON z.r = a.r AND z.br = a.br AND z.pos BETWEEN a.pos AND a.pos + a.span - 1 GROUP BY a.r, a.br, a.item_id, a.pos HAVING count(DISTINCT z.x) = min(a.n))),
p AS (SELECT r, count(*) AS n_near, string_agg(i, ',' ORDER BY i) AS ids FROM nr GROUP BY r)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, cast(coalesce(h.n_hit, 0) AS bigint) AS n_hit,
       cast(coalesce(g.n_items, 0) AS bigint) AS n_items, sha256(coalesce(g.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated,
       cast(coalesce(p.n_near, 0) AS bigint) AS n_near, sha256(coalesce(p.ids, '')) AS near_sha256
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN g ON d.r = g.r LEFT JOIN p ON d.r = p.r
"""

_TEMPLATES = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in kv)) for kv in sorted(licenses.TEMPLATES.items()))
OP4 = f"""
WITH t0 AS (SELECT license, {_WORDS} AS w FROM (VALUES {_TEMPLATES}) AS v(license, text)),
t AS (SELECT DISTINCT license, cast(greatest(8, pow(2, ceil(log2(len(w))))) AS bigint) AS c, array_to_string(w[i:i + 2], ' ') AS x
      FROM t0, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS u(i)),
n AS (SELECT license, count(*) AS n FROM t GROUP BY license),
d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, text, i - 1 AS pos, array_to_string(w[i:i + 2], ' ') AS x FROM d, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS u(i) WHERE len(w) > 0),
m AS (SELECT s.doc_id, s.text, t.license, t.c, s.pos, t.x FROM s JOIN t ON s.x = t.x),
k AS (SELECT doc_id, text, license, pos // c - o AS win, x FROM m, unnest([0, 1]) AS u(o) WHERE pos // c >= o AND pos < (pos // c - o) * c + 2 * c - 2),
g AS (SELECT doc_id, text, k.license, win, count(DISTINCT x) AS c FROM k GROUP BY ALL)
SELECT doc_id, g.license, count(*) AS n_windows, max(g.c / n.n) AS containment FROM g JOIN n ON g.license = n.license
WHERE g.c / n.n >= 0.8 GROUP BY doc_id, text, g.license
"""

OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x FROM d, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT node, min(reach) AS root FROM r GROUP BY node)
SELECT d.doc_id, cast(coalesce(n.n, 0) AS bigint) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, d.doc_id = coalesce(c.root, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""

ORACLE_SQL = {"op1_decontaminate": OP1, "op4_license_scan": OP4, "op6_near_dedup": OP6}
