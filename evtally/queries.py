"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bridge
from .functions import ids, measures
from .operators import admission, attribution, disputes, fences, folds, gates, serving
from .plans import derivation
from .plans.ledger import chain
from .policy import SECOND, Policy
from .topology import closure, dangling, overlaps

POLICY = Policy(fresh_ttl=40 * 86400 * SECOND, stale_ttl=80 * 86400 * SECOND)
T0, T1, ROOT = bridge.T0, bridge.T1, bridge.py_hexid(1000)
QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = bridge.SQL + sql
        return f

    return add


def whole(c: str):
    return F.col(c).cast("long").alias(c)


def derived(spark, d, policy=POLICY) -> derivation.Derivation:
    return derivation.derive(bridge.observations(spark, d), bridge.topology(spark, d), policy, T0, T1, T1)


def fenced(spark, d) -> DataFrame:
    return fences.fenced(derivation.members(bridge.observations(spark, d), T0, T1))


def placed(spark, d) -> DataFrame:
    t = bridge.topology(spark, d)
    x = admission.assessed(fences.survivors(fenced(spark, d)), t, POLICY, T1)
    return attribution.attributed(x.filter("reason is null").drop("reason"), t)


@query("SELECT 'ok' AS fault, cast(count(*) AS bigint) AS n FROM obs")
def shape_filter(spark, d):
    return bridge.observations(spark, d).groupBy(F.coalesce(gates.shape_fault(), F.lit("ok")).alias("fault")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN window_end > {T0 + 10 * 86400 * 10**9} AND window_start >= {T0 + 10 * 86400 * 10**9} THEN 'accepted' WHEN window_start >= {T0} AND window_end <= {T0 + 9 * 86400 * 10**9} THEN 'late-evidence' ELSE 'rejected-no-period' END AS verdict, cast(count(*) AS bigint) AS n FROM obs GROUP BY 1")
def ingest_gate_counts(spark, d):
    day = 86400 * 10**9
    p = spark.createDataFrame([("a", T0, T0 + 9 * day, "closed"), ("b", T0 + 10 * day, T1, "open")], "id string, start long, end long, state string")
    return gates.report(gates.gate(bridge.observations(spark, d), bridge.topology(spark, d), p))


@query(f"SELECT id, window_start FROM obs WHERE window_start >= {T0 + 86400 * 10**9} AND window_end <= {T0 + 3 * 86400 * 10**9}")
def period_membership(spark, d):
    return derivation.members(bridge.observations(spark, d), T0 + 86400 * 10**9, T0 + 3 * 86400 * 10**9).select("id", "window_start")


@query(f"""SELECT CASE WHEN observed_at > received_at THEN 'anomaly' WHEN greatest(observed_at, received_at) > {T0 + 20 * 86400 * 10**9 + 30 * 10**9} THEN 'future'
 WHEN greatest(0, {T0 + 20 * 86400 * 10**9} - observed_at) <= {5 * 86400 * 10**9} THEN 'fresh' WHEN {T0 + 20 * 86400 * 10**9} - observed_at <= {10 * 86400 * 10**9} THEN 'stale' ELSE 'expired' END AS class, cast(count(*) AS bigint) AS n FROM obs GROUP BY 1""")
def freshness_class_counts(spark, d):
    day = 86400 * SECOND
    c = measures.freshness(F.col("observed_at"), F.col("received_at"), T0 + 20 * day, Policy(fresh_ttl=5 * day, stale_ttl=10 * day))
    return bridge.observations(spark, d).groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query("SELECT id, cast(count(*) AS bigint) AS n FROM cand GROUP BY id HAVING count(*) > 1")
def identity_collisions(spark, d):
    return fences.collisions(bridge.observations(spark, d)).filter("id_clash").groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT id, origin_fence AS fence FROM fen WHERE origin_fence IS NOT NULL")
def origin_fence(spark, d):
    return fenced(spark, d).filter("origin_fence is not null").select("id", F.col("origin_fence").alias("fence"))


@query("SELECT id, sequence_fence AS fence FROM fen WHERE sequence_fence IS NOT NULL")
def sequence_fence(spark, d):
    return fenced(spark, d).filter("sequence_fence is not null").select("id", F.col("sequence_fence").alias("fence"))


@query("SELECT source, cast(max(peak) AS bigint) AS peak, cast(count(*) FILTER (epoch < peak) AS bigint) AS superseded FROM fen GROUP BY source")
def epoch_fence(spark, d):
    return fenced(spark, d).groupBy("source").agg(F.max("peak").cast("long").alias("peak"), F.count_if(F.col("epoch") < F.col("peak")).alias("superseded"))


@query("SELECT id FROM cand WHERE resource IS NOT NULL AND (generation = 'g1' OR cast(right(resource, 1) AS int) % 2 = 0)")
def binding_semijoin(spark, d):
    return admission.bound(bridge.observations(spark, d), bridge.topology(spark, d).binding).filter("bound").select("id")


@query("SELECT coalesce(reason, 'admitted') AS reason, cast(count(*) AS bigint) AS n FROM judged GROUP BY 1")
def admission_reasons(spark, d):
    x = admission.assessed(fences.survivors(fenced(spark, d)), bridge.topology(spark, d), POLICY, T1)
    return x.groupBy(F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT basis, scope, lost, cast(count(*) AS bigint) AS n FROM (SELECT basis, CASE WHEN lost THEN NULL ELSE scope END AS scope, lost FROM placed) GROUP BY ALL")
def attribution_basis(spark, d):
    return placed(spark, d).withColumn("scope", F.when(~F.col("lost"), F.col("scope"))).groupBy("basis", "scope", "lost").agg(F.count("*").alias("n"))


def entries(spark, d):
    return placed(spark, d).filter("role = 'contribution' and not lost")


@query("SELECT cast(amounts AS bigint) AS amounts, cast(count(*) AS bigint) AS groups, cast(sum(k) AS bigint) AS records FROM grp GROUP BY amounts")
def dispute_groups(spark, d):
    return disputes.resolve(entries(spark, d), POLICY).groupBy("amounts").agg(F.count("*").alias("groups"), F.sum("k").cast("long").alias("records"))


@query(""", va AS (SELECT DISTINCT ckey, window_start, amount, source, authority FROM entries),
 best AS (SELECT ckey, window_start, arg_min(source, (-authority, source)) AS b, count(DISTINCT amount) AS amounts FROM va GROUP BY ALL)
SELECT cast(count(*) AS bigint) AS groups, cast(count(*) FILTER (m = 1) AS bigint) AS settled, cast(coalesce(sum(a) FILTER (m = 1), 0) AS bigint) AS total
FROM (SELECT b.ckey, b.window_start, count(*) AS m, min(v.amount) AS a FROM best b JOIN va v ON v.ckey = b.ckey AND v.window_start = b.window_start AND v.source = b.b GROUP BY ALL)""")
def dispute_resolution_authority(spark, d):
    p = Policy(fresh_ttl=POLICY.fresh_ttl, stale_ttl=POLICY.stale_ttl, conflict="prefer-higher-authority", tie_break="lowest-source-id-wins")
    x = disputes.resolve(entries(spark, d), p)
    return x.agg(F.count("*").alias("groups"), F.count("counted").alias("settled"), F.coalesce(F.sum("counted"), F.lit(0)).cast("long").alias("total"))


@query("SELECT generation, scope, measure, category, basis, resource, flow, cast(known_total AS bigint) AS known_total, cast(n AS bigint) AS known_contributions FROM claims")
def claims(spark, d):
    return derived(spark, d).cells.select("generation", "scope", "measure", "category", "basis", "resource", "flow", whole("known_total"), "known_contributions")


_FR = "unhex(lpad(to_hex(strlen({0})), 16, '0')) || encode({0})"
_ID = "sha256(" + " || ".join(_FR.format(x) for x in ("'fel.accounting-identity/1'", "generation", "scope", "measure", "category", "basis", "coalesce(resource, repeat('0', 32))", "coalesce(flow, repeat('0', 32))", "repeat('0', 32)", "repeat('0', 32)")) + ")"


@query(f"SELECT {_ID} AS identity, category FROM claims")
def accounting_identity(spark, d):
    return derived(spark, d).cells.select(F.col("cell").alias("identity"), "category")


@query("SELECT scope, generation, cast(attributed AS bigint) AS attributed_total, cast(observed AS bigint) AS observed_total, cast(contributions AS bigint) AS contribution_count, cast(unknown AS bigint) AS unknown_contributions, status, cast(attributed - observed AS bigint) AS delta FROM status")
def conservation(spark, d):
    return derived(spark, d).conservation.select("scope", "generation", whole("attributed_total"), whole("observed_total"), whole("contribution_count"), whole("unknown_contributions"), "status", "delta")


@query("SELECT scope, generation, window_start, cast(amount AS bigint) AS amount, cast(k AS bigint) AS k FROM (SELECT CASE WHEN true THEN scope END AS scope, generation, window_start, amount, k FROM tot)")
def totals_dispute(spark, d):
    return derived(spark, d).totals.select("scope", "generation", "window_start", whole("amount"), whole("k"))


_USE = "CASE category WHEN 'useful-delivered-work' THEN 'useful' WHEN 'control-overhead' THEN 'necessary' WHEN 'failed-transfer' THEN 'failed' WHEN 'unknown-unattributed' THEN 'unknown' ELSE 'avoidable' END"


@query(f""", cu AS (SELECT measure, {_USE} AS use, known_total FROM claims),
e AS (SELECT k.measure, coalesce((SELECT sum(known_total) FROM cu WHERE cu.measure = k.measure AND use = 'useful'), 0) AS useful, coalesce((SELECT sum(known_total) FROM cu WHERE cu.measure = k.measure AND use <> 'unknown'), 0) AS denominator,
 coalesce((SELECT sum(unknown) FROM status s WHERE s.measure = k.measure), 0) AS unk, (SELECT count(*) FROM status s WHERE s.measure = k.measure AND status IN ('residual', 'excess')) AS broken
 FROM (VALUES {", ".join(f"('{n}')" for n in measures.MEASURES)}) AS k(measure))
SELECT measure, cast(useful AS bigint) AS useful, cast(denominator AS bigint) AS denominator, cast(unk AS bigint) AS unknown_contributions, unk = 0 AND broken = 0 AND denominator > 0 AS determinate,
 CASE WHEN denominator = 0 THEN 'unknown' ELSE 'partial' END AS coverage FROM e""")
def efficiency(spark, d):
    return derived(spark, d).efficiency.select("measure", whole("useful"), whole("denominator"), "unknown_contributions", "determinate", "coverage")


@query("SELECT id, reason, why FROM rej")
def rejected(spark, d):
    why = {"evidence id claimed twice": "id", "admission": "admission", "subject is not declared": "lost", "cell and window": "cell"}
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in why.items() for x in kv])[F.col("detail")], F.split("detail", " ")[0])
    return derived(spark, d).rejected.select("id", "reason", label.alias("why"))


@query("SELECT scope, generation, measure, reason, cast(c AS bigint) AS evidence_count FROM unk UNION SELECT scope, generation, measure, CASE status WHEN 'residual' THEN 'residual-unclassified' ELSE 'over-attribution' END, 1 FROM status WHERE status IN ('residual', 'excess')")
def unknown_bucket(spark, d):
    return derived(spark, d).unknowns


@query("SELECT anc AS scope, generation, category, cast(sum(known_total) AS bigint) AS known_total, cast(sum(n) AS bigint) AS known_contributions FROM claims JOIN up ON scope = leaf GROUP BY ALL")
def scope_rollup(spark, d):
    return serving.rollup(derived(spark, d).cells, bridge.topology(spark, d).ancestry()).select("scope", "generation", "category", whole("known_total"), "known_contributions")


@query(f"SELECT scope, category, cast(sum(known_total) AS bigint) AS known_total FROM claims WHERE scope IN (SELECT leaf FROM up WHERE anc = '{bridge.py_hexid(101)}') GROUP BY ALL")
def descendant_query(spark, d):
    rows, _ = serving.rows(derived(spark, d).cells, bridge.topology(spark, d).ancestry(), scope=bridge.py_hexid(101), descendants=True)
    return rows.groupBy("scope", "category").agg(F.sum("known_total").cast("long").alias("known_total"))


@query("SELECT leaf, anc FROM up")
def scope_closure(spark, d):
    return bridge.topology(spark, d).ancestry().select("leaf", "anc")


def _axis(axis: str) -> None:
    width = 6 * 3600 * 10**9
    label = f"cast({T0} + (window_end - {T0}) // {width} * {width} AS varchar)" if axis == "time" else f"coalesce({axis}, repeat('0', 32))" if axis != "flow" else "coalesce(CASE WHEN resource IS NULL THEN flow END, repeat('0', 32))"

    def parity(spark, d):
        return serving.aggregate(derived(spark, d).contributions, axis, T0, width).select("label", "category", "scope", "generation", "source", "provenance", whole("known_total"), "known_contributions", "claim_count")

    def single(spark, d):
        return serving.aggregate_axis(derived(spark, d).contributions, axis, T0, width).select("label", whole("known_total"), "known_contributions")

    parity.__name__, single.__name__ = f"aggregate_{axis}", f"axis_{axis}"
    query(f"SELECT {label} AS label, category, scope, generation, source, provenance, cast(sum(amount) AS bigint) AS known_total, cast(count(*) AS bigint) AS known_contributions, cast(count(DISTINCT ckey) AS bigint) AS claim_count FROM contrib GROUP BY {label}, category, scope, generation, source, provenance, resource, CASE WHEN resource IS NULL THEN flow END")(parity)
    query(f"SELECT {label} AS label, cast(sum(amount) AS bigint) AS known_total, cast(count(*) AS bigint) AS known_contributions FROM contrib GROUP BY 1")(single)


for _a in measures.AXES:
    _axis(_a)


@query("SELECT cast(count(*) AS bigint) AS domains, cast(count(*) FILTER (status = 'consistent') AS bigint) AS consistent, cast(count(*) FILTER (status = 'residual') AS bigint) AS residual, cast(count(*) FILTER (status = 'excess') AS bigint) AS excess, cast(count(*) FILTER (status = 'unverifiable') AS bigint) AS unverifiable, bool_and(status = 'consistent') AS fully_consistent FROM status")
def reconcile(spark, d):
    return serving.reconcile(derived(spark, d).conservation)


@query(f", one AS (SELECT * FROM (SELECT {_ID} AS cell, * FROM claims) ORDER BY cell LIMIT 1) SELECT 'basis' AS step, basis AS item, scope AS detail FROM one UNION ALL SELECT 'total', cast(known_total AS varchar), cast(n AS varchar) FROM one UNION ALL SELECT 'counted', e.id, '' FROM contrib e JOIN one ON e.ckey = one.ckey UNION ALL SELECT 'excluded', r.id, r.reason FROM rej r JOIN one ON r.generation = one.generation")
def explain_steps(spark, d):
    x = derived(spark, d)
    first = x.claims.agg(F.min("cell")).head()[0]
    return serving.explain(x.claims, x.rejected, first or "")


_UNIT = "CASE measure WHEN 'wire-bytes' THEN 'octets' WHEN 'payload-bytes' THEN 'octets' WHEN 'control-messages' THEN 'messages' WHEN 'frame-count' THEN 'frames' ELSE 'nanoseconds' END"


@query(f"""SELECT CASE WHEN scope = repeat('0', 32) THEN '-' ELSE scope END AS scope, generation, measure, {_UNIT} AS unit, category, replace({_USE}, 'necessary', 'necessary-overhead') AS usefulness, basis,
 coalesce(nullif(resource, repeat('0', 32)), '-') AS resource, coalesce(nullif(flow, repeat('0', 32)), '-') AS flow, '-' AS path, '-' AS reservation, 'known' AS coverage,
 cast(known_total AS varchar) AS known_total, cast(n AS varchar) AS known_contributions, '0' AS unknown_contributions FROM claims""")
def export_rows(spark, d):
    rows, _ = serving.rows(derived(spark, d).cells, limit=10**9)
    return serving.export_columns(rows)


_LOST = "SELECT scope, generation, measure, reason FROM unk UNION SELECT scope, generation, measure, CASE status WHEN 'residual' THEN 'residual-unclassified' ELSE 'over-attribution' END FROM status WHERE status IN ('residual', 'excess')"


@query(f""", lost AS ({_LOST}), parts AS (SELECT category, scope, generation, source, coalesce(resource, repeat('0', 32)) AS resource, coalesce(CASE WHEN resource IS NULL THEN flow END, repeat('0', 32)) AS flow, provenance, amount AS a, 1 AS k, 0 AS u FROM contrib
 UNION ALL SELECT 'unknown-unattributed', scope, generation, repeat('0', 32), repeat('0', 32), repeat('0', 32), 'real', 0, 0, 1 FROM lost)
SELECT category, scope, generation, source, resource, flow, provenance, cast(sum(a) AS bigint) AS known_total, cast(sum(k) AS bigint) AS evidence_count, cast(sum(u) AS bigint) AS unknown_contributions,
 CASE WHEN sum(u) = 0 THEN 'known' WHEN sum(k) = 0 THEN 'unknown' ELSE 'partial' END AS coverage, CASE WHEN sum(k) = 0 THEN 'NONE' ELSE upper(provenance) END AS proof_surfaces FROM parts WHERE generation = 'g1' GROUP BY category, scope, generation, source, resource, flow, provenance""")
def aggregate_buckets(spark, d):
    x = derived(spark, d)
    rows, _ = serving.buckets(x.contributions, x.unknowns, "category", generation="g1", measure="wire-bytes")
    rows = rows.withColumn("c", F.element_at("cells", 1))
    return rows.select("category", "scope", "generation", "source", "resource", "flow", "provenance", F.col("c.known_total").cast("long").alias("known_total"), "evidence_count", "c.unknown_contributions", "c.coverage", "proof_surfaces")


@query("""SELECT CASE WHEN amount % 13 = 0 THEN 'unknown name' WHEN amount % 11 = 0 THEN 'window' WHEN amount % 7 = 0 THEN 'time missing' WHEN amount % 5 = 0 THEN 'metadata repeated' WHEN amount % 3 = 0 AND category <> 'unknown-unattributed' THEN 'total with category' ELSE 'ok' END AS fault,
 cast(count(*) AS bigint) AS n FROM obs GROUP BY 1""")
def shape_faults(spark, d):
    """The shape filter on rows with planted faults, several in one row, told by their amounts."""
    per = lambda k: F.col("amount").cast("long") % k == 0
    x = bridge.observations(spark, d).withColumns({
        "measure": F.when(per(13), "no-such-measure").otherwise(F.col("measure")), "window_end": F.when(per(11), F.col("window_start")).otherwise(F.col("window_end")),
        "observed_at": F.when(per(7), 0).otherwise(F.col("observed_at")), "role": F.when(per(3), "total").otherwise(F.col("role")),
        "metadata": F.when(per(5), F.array_repeat(F.struct(F.lit("k").alias("key"), F.lit("v").alias("value")), 2)).otherwise(F.col("metadata")),
    })
    return x.groupBy(F.coalesce(gates.shape_fault(), F.lit("ok")).alias("fault")).agg(F.count("*").alias("n"))


@query(f"SELECT scope, generation, category, resource, flow, cast(known_total AS bigint) AS known_total FROM claims ORDER BY scope, generation, list_position({list(measures.CATEGORIES)}, category), list_position({list(measures.BASES)}, basis), resource NULLS FIRST, flow NULLS FIRST LIMIT 50")
def topk_rows(spark, d):
    rows, _ = serving.rows(derived(spark, d).cells, limit=50)
    return rows.select("scope", "generation", "category", "resource", "flow", whole("known_total"))


@query("SELECT cast(count(*) AS bigint) AS kept FROM obs WHERE i % 2 = 1")
def idempotent_ingest(spark, d):
    x = bridge.observations(spark, d).withColumn("record", F.sha2(F.to_json(F.struct("*")), 256))
    e = spark.read.parquet(f"{d}/events.parquet").filter("event_id % 2 = 0").select(bridge.hexid(F.when(F.col("event_id") % 211 == 0, F.col("event_id") + 1).otherwise(F.col("event_id"))).alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("observed_at"), F.round(F.col("value") * 100).cast("decimal(20,0)").alias("amount"))
    kept = x.join(e, ["id", "observed_at", "amount"], "left_semi").select("id", "record")
    return x.join(kept, ["id", "record"], "left_anti").agg(F.count("*").alias("kept"))


@query(f"SELECT cast(count(*) FILTER (window_end <= {T0 + 5 * 86400 * 10**9}) AS bigint) AS late, cast(count(*) FILTER (window_start >= {T0 + 5 * 86400 * 10**9}) AS bigint) AS accepted FROM obs")
def late_evidence(spark, d):
    cut = T0 + 5 * 86400 * 10**9
    p = spark.createDataFrame([("a", T0, cut, "closed"), ("b", cut, T1, "open")], "id string, start long, end long, state string")
    g = gates.gate(bridge.observations(spark, d), bridge.topology(spark, d), p)
    return g.agg(F.count_if(F.col("verdict") == "late-evidence").alias("late"), F.count_if(F.col("verdict") == "accepted").alias("accepted"))


@query("SELECT DISTINCT id FROM contrib")
def correction_delta(spark, d):
    return derived(spark, d).claims.select(F.explode("evidence").alias("id")).distinct()


@query("SELECT cast(o_custkey AS varchar) AS period, cast(count(*) AS bigint) AS revisions FROM orders GROUP BY 1")
def lineage_verify(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey", "o_orderdate")
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("revision", F.row_number().over(w)).withColumn("digest", F.sha2(F.concat_ws("|", "o_custkey", "revision"), 256))
    o = o.withColumn("parent", F.lag("digest").over(w)).select(F.col("o_custkey").cast("string").alias("period"), "revision", "digest", "parent")
    return chain(o).filter("ok").groupBy("period").agg(F.count("*").alias("revisions"))


@query("SELECT id FROM cand EXCEPT SELECT id FROM contrib")
def compaction_keep(spark, d):
    obs, used = derivation.members(bridge.observations(spark, d), T0, T1), derived(spark, d).claims.select(F.explode("evidence").alias("id"))
    return obs.join(used, "id", "left_anti").select("id").distinct()


@query(f", iv AS (SELECT o_custkey AS k, epoch_us(o_orderdate) AS a, epoch_us(o_orderdate) + 2592000000000 AS b, o_orderkey FROM orders), w AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM iv) SELECT k AS source, cast(count(*) AS bigint) AS n FROM w WHERE p >= a GROUP BY k")
def incarnation_overlap(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("source"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("started"))
    return overlaps(o.withColumn("ended", F.col("started") + 2592000000000), ["source"], "started", "ended").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS supplier, cast(count(*) AS bigint) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20) GROUP BY 1")
def topology_antijoin(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").filter("s_nationkey < 20").select(F.col("s_suppkey").alias("id"))
    return dangling(spark.read.parquet(f"{d}/lineitem.parquet"), "l_suppkey", s).groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("n"))


_LINES = "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)) * 100) AS attributed FROM lineitem GROUP BY 1"


@query(f", x AS (SELECT l_orderkey, sum(cast(round(l_extendedprice * 100) AS bigint)) AS a FROM lineitem GROUP BY 1) SELECT CASE WHEN a IS NULL THEN 'no-evidence' WHEN a = t THEN 'consistent' WHEN a < t THEN 'residual' ELSE 'excess' END AS status, cast(count(*) AS bigint) AS n FROM (SELECT o_orderkey, cast(round(o_totalprice * 100) AS bigint) AS t FROM orders) LEFT JOIN x ON o_orderkey = l_orderkey GROUP BY 1")
def order_conservation(spark, d):
    """Order lines against the order's own total: the conservation fold's shape on a large join."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("a"))
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("t"))
    status = F.when(F.col("a").isNull(), "no-evidence").when(F.col("a") == F.col("t"), "consistent").when(F.col("a") < F.col("t"), "residual").otherwise("excess")
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, cast(count(*) AS bigint) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def line_collisions(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return x.filter("n > 1")
