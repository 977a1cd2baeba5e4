"""The driver's tables as observations and a topology, with the same mapping as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .topology import SCHEMAS, Topology

# Fixed values of the mapping.
T0, T1 = 1704067200 * 10**9, 1706745600 * 10**9  # January 2024
KIND, GENERATIONS = "wire-bytes", ("g1", "g2")
CATEGORY = {"purchase": "useful-delivered-work", "view": "control-overhead", "click": "retransmission", "signup": "reroute-overhead"}
SOURCES = [(0, 10, "real"), (1, 5, "synthetic"), (2, 5, "replay"), (3, 7, "real")]


def hexid(c: Column | int) -> Column:
    return F.lpad(F.lower(F.hex(c if isinstance(c, Column) else F.lit(c))), 32, "0")


def py_hexid(i: int) -> str:
    return f"{i:032x}"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence, 20 sources' worth of clashes planted by arithmetic on event_id."""
    e, i, u = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id"), F.col("user_id")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    hour = F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp"))) * 1000
    source = u % 4
    category = F.lit("failed-transfer")
    for k, v in CATEGORY.items():
        category = F.when(F.col("event_type") == k, v).otherwise(category)
    string = lambda: F.lit(None).cast("string")
    return e.select(
        hexid(F.when(i % 211 == 0, i + 1).otherwise(i)).alias("id"), hexid(F.when(i % 97 == 0, i + 2).otherwise(i)).alias("origin"), hexid(source).alias("source"), hexid(source).alias("incarnation"),
        F.when((source == 3) & (i % 5 != 0), 2).otherwise(1).cast("decimal(20,0)").alias("epoch"), F.floor(i / 3).cast("decimal(20,0)").alias("sequence"), F.when(F.dayofmonth("ts") <= 15, "g1").otherwise("g2").alias("generation"),
        ts.alias("observed_at"), (ts + (i % 7 - F.when(i % 301 == 0, 9).otherwise(0)) * 1_000_000_000).alias("received_at"), F.lit(KIND).alias("measure"), F.when(i % 19 == 0, "total").otherwise("contribution").alias("role"),
        F.when(i % 19 == 0, "unknown-unattributed").otherwise(category).alias("category"), F.when(i % 3 == 0, hexid(u % 10)).alias("resource"), F.when(i % 3 == 1, hexid(u % 25)).alias("flow"), string().alias("path"), string().alias("reservation"),
        F.round(F.col("value") * 100).cast("decimal(20,0)").alias("amount"), hour.alias("window_start"), (hour + 3600 * 10**9).alias("window_end"),
        F.array().cast("array<struct<key:string,value:string>>").alias("metadata"), string().alias("integrity"),
    )


def topology(spark: SparkSession, sf_dir: str) -> Topology:
    """Four sources, two generations, nations under regions under one root; ten resources and 25 flows by nation."""
    region, nation = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation"))
    none = F.array().cast("array<string>")
    root = spark.range(0, 1, 1, 1).select(hexid(1000).alias("id"), F.lit("root").alias("label"), F.lit("fabric").alias("kind"), F.lit(None).cast("string").alias("parent"), none.alias("members"))
    scope = root.unionByName(region.select(hexid(F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("label"), F.lit("pod").alias("kind"), hexid(1000).alias("parent"), none.alias("members")))
    scope = scope.unionByName(nation.select(hexid(F.col("n_nationkey")).alias("id"), F.col("n_name").alias("label"), F.lit("switch").alias("kind"), hexid(F.col("n_regionkey") + 100).alias("parent"), none.alias("members")))
    names = lambda n: [f.split()[0] for f in SCHEMAS[n].split(", ")]
    at = lambda n, *v: dict(zip(names(n), v, strict=False))
    return Topology.of(
        spark, scope=scope, source=[at("source", py_hexid(i), f"s{i}", "probe", a, p, True) for i, a, p in SOURCES],
        incarnation=[at("incarnation", py_hexid(i), py_hexid(i), 1, 0, None) for i, _, _ in SOURCES],
        generation=[at("generation", g, k, g, T0, None, "active") for k, g in enumerate(GENERATIONS)],
        binding=[at("binding", py_hexid(r), g, 0, None) for r in range(10) for g in GENERATIONS if g == "g1" or r % 2 == 0],
        resource=[at("resource", py_hexid(r), f"r{r}", "port", py_hexid(r)) for r in range(10)],
        flow=[at("flow", py_hexid(f), f"f{f}", py_hexid(f), "g1", []) for f in range(23)],
    )


SQL = f"""
WITH RECURSIVE ev AS (
  SELECT event_id AS i, user_id AS u, event_type, value, ts, epoch_us(ts) * 1000 AS observed_at, epoch_us(date_trunc('hour', ts)) * 1000 AS hour_ns FROM events),
obs AS (
  SELECT i, lpad(lower(to_hex(CASE WHEN i % 211 = 0 THEN i + 1 ELSE i END)), 32, '0') AS id, lpad(lower(to_hex(CASE WHEN i % 97 = 0 THEN i + 2 ELSE i END)), 32, '0') AS origin,
    lpad(lower(to_hex(u % 4)), 32, '0') AS source, lpad(lower(to_hex(u % 4)), 32, '0') AS incarnation, CASE WHEN u % 4 = 3 AND i % 5 <> 0 THEN 2 ELSE 1 END AS epoch, i // 3 AS sequence,
    CASE WHEN day(ts) <= 15 THEN 'g1' ELSE 'g2' END AS generation, observed_at, observed_at + (i % 7 - CASE WHEN i % 301 = 0 THEN 9 ELSE 0 END) * 1000000000 AS received_at,
    '{KIND}' AS measure, CASE WHEN i % 19 = 0 THEN 'total' ELSE 'contribution' END AS role,
    CASE WHEN i % 19 = 0 THEN 'unknown-unattributed' WHEN event_type = 'purchase' THEN 'useful-delivered-work' WHEN event_type = 'view' THEN 'control-overhead' WHEN event_type = 'click' THEN 'retransmission' WHEN event_type = 'signup' THEN 'reroute-overhead' ELSE 'failed-transfer' END AS category,
    CASE WHEN i % 3 = 0 THEN lpad(lower(to_hex(u % 10)), 32, '0') END AS resource, CASE WHEN i % 3 = 1 THEN lpad(lower(to_hex(u % 25)), 32, '0') END AS flow,
    cast(round(value * 100) AS bigint) AS amount, hour_ns AS window_start, hour_ns + 3600000000000 AS window_end FROM ev),
src AS (SELECT * FROM (VALUES ('{py_hexid(0)}', 10, 'real'), ('{py_hexid(1)}', 5, 'synthetic'), ('{py_hexid(2)}', 5, 'replay'), ('{py_hexid(3)}', 7, 'real')) AS v(sid, authority, provenance)),
scopes AS (SELECT '{py_hexid(1000)}' AS id, NULL AS parent UNION ALL SELECT lpad(lower(to_hex(r_regionkey + 100)), 32, '0'), '{py_hexid(1000)}' FROM region
  UNION ALL SELECT lpad(lower(to_hex(n_nationkey)), 32, '0'), lpad(lower(to_hex(n_regionkey + 100)), 32, '0') FROM nation),
up AS (SELECT id AS leaf, id AS anc FROM scopes UNION ALL SELECT up.leaf, s.parent FROM up JOIN scopes s ON up.anc = s.id WHERE s.parent IS NOT NULL),
cand AS (SELECT *, concat_ws('|', origin, source, incarnation, epoch, sequence, generation, observed_at, measure, role, category, coalesce(resource, '-'), coalesce(flow, '-'), amount, window_start, window_end) AS content FROM obs WHERE window_start >= {T0} AND window_end <= {T1}),
fen AS (SELECT *, count(*) OVER (PARTITION BY id) > 1 AS id_clash,
    CASE WHEN min(content) OVER o <> max(content) OVER o THEN 'divergent' WHEN row_number() OVER (PARTITION BY origin ORDER BY id) > 1 THEN 'duplicate' END AS origin_fence,
    CASE WHEN min(content) OVER q <> max(content) OVER q THEN 'divergent' WHEN row_number() OVER (PARTITION BY source, incarnation, sequence ORDER BY id) > 1 THEN 'duplicate' END AS sequence_fence,
    max(epoch) OVER (PARTITION BY incarnation) AS peak
  FROM cand WINDOW o AS (PARTITION BY origin), q AS (PARTITION BY source, incarnation, sequence)),
judged AS (SELECT f.*, s.authority, s.provenance,
    CASE WHEN epoch < peak THEN 'fenced-epoch'
      WHEN resource IS NOT NULL AND generation = 'g2' AND (u_res % 2) = 1 THEN 'stale-generation' WHEN observed_at > received_at THEN 'clock-anomaly' END AS reason
  FROM (SELECT *, cast(right(resource, 1) AS bigint) AS u_res FROM fen WHERE NOT id_clash AND origin_fence IS NULL AND sequence_fence IS NULL) f LEFT JOIN src s ON f.source = s.sid),
placed AS (SELECT j.*, CASE WHEN resource IS NOT NULL THEN 'resource-direct' WHEN flow IS NOT NULL THEN 'flow-direct' ELSE 'unattributed' END AS basis,
    CASE WHEN resource IS NOT NULL THEN resource WHEN flow IS NOT NULL AND flow < '{py_hexid(23)}' THEN flow ELSE '{py_hexid(0)}' END AS scope, coalesce(resource IS NULL AND flow >= '{py_hexid(23)}', false) AS lost FROM judged j WHERE reason IS NULL),
entries AS (SELECT *, concat_ws('|', generation, scope, measure, category, basis, coalesce(resource, '-'), CASE WHEN resource IS NULL THEN coalesce(flow, '-') ELSE '-' END) AS ckey FROM placed WHERE role = 'contribution' AND NOT lost),
grp AS (SELECT ckey, window_start, window_end, count(DISTINCT amount) AS amounts, count(*) AS k, min(amount) AS lo, min(id) AS low FROM entries GROUP BY ALL),
contrib AS (SELECT e.* FROM entries e JOIN grp g ON e.ckey = g.ckey AND e.window_start = g.window_start AND g.amounts = 1 AND e.id = g.low),
claims AS (SELECT ckey, generation, scope, measure, category, basis, resource, CASE WHEN resource IS NULL THEN flow END AS flow, sum(amount) AS known_total, count(*) AS n FROM contrib GROUP BY ALL),
rej AS (
  SELECT id, source, generation, measure, 'conflicting-evidence' AS reason, 'id' AS why FROM fen WHERE id_clash
  UNION ALL SELECT id, source, generation, measure, CASE origin_fence WHEN 'duplicate' THEN 'duplicate-suppressed' ELSE 'conflicting-evidence' END, 'origin' FROM fen WHERE origin_fence IS NOT NULL
  UNION ALL SELECT id, source, generation, measure, CASE sequence_fence WHEN 'duplicate' THEN 'duplicate-suppressed' ELSE 'conflicting-evidence' END, 'sequence' FROM fen WHERE sequence_fence IS NOT NULL
  UNION ALL SELECT id, source, generation, measure, reason, 'admission' FROM judged WHERE reason IS NOT NULL
  UNION ALL SELECT id, source, generation, measure, 'attribution-failure', 'lost' FROM placed WHERE lost AND role = 'contribution'
  UNION ALL SELECT e.id, source, generation, measure, CASE WHEN g.amounts = 1 THEN 'duplicate-suppressed' ELSE 'conflicting-evidence' END, 'cell' FROM entries e JOIN grp g ON e.ckey = g.ckey AND e.window_start = g.window_start WHERE g.amounts > 1 OR e.id <> g.low),
tot AS (SELECT scope, generation, measure, window_start, window_end, CASE WHEN min(amount) = max(amount) THEN min(amount) END AS amount, count(*) AS k FROM placed WHERE role = 'total' GROUP BY ALL),
unk AS (SELECT DISTINCT '{py_hexid(0)}' AS scope, generation, measure, reason, 1 AS c FROM rej UNION SELECT scope, generation, measure, 'conflicting-evidence', k FROM tot WHERE amount IS NULL),
dom AS (SELECT scope, generation, measure, coalesce(sum(a), 0) AS attributed, sum(n) AS contributions, sum(u) AS unknown, sum(o) AS observed FROM (
    SELECT scope, generation, measure, amount AS a, 1 AS n, 0 AS u, NULL AS o FROM contrib UNION ALL SELECT scope, generation, measure, NULL, 0, c, NULL FROM unk
    UNION ALL SELECT scope, generation, measure, NULL, 0, 0, amount FROM tot WHERE amount IS NOT NULL) GROUP BY ALL),
status AS (SELECT *, CASE WHEN observed IS NULL THEN 'unverifiable' WHEN attributed = observed THEN 'consistent' WHEN attributed < observed THEN 'residual' ELSE 'excess' END AS status FROM dom)
"""
