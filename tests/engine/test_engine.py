"""Scenarios of one period: what goes in and what the period then claims."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evtally.functions import ids, times
from evtally.plans import derivation
from evtally.plans.ledger import Ledger
from evtally.policy import Policy
from evtally.sources.evidence import OBSERVATION, read_evidence, write_evidence
from evtally.sources.store import Store
from evtally.topology import Topology, ancestors, problems

T0, H, S = 1_700_000_000 * 10**9, 3600 * 10**9, 10**9
ID = ids.derive_text
A, B, X = (ID("source", "source", n) for n in ("switch-a", "probe-b", "vendor-x"))
G1, G0 = ID("generation", "generation", "g1"), ID("generation", "generation", "g0")
P1, P2 = ID("resource", "resource", "port-1"), ID("resource", "resource", "port-2")
SC = {n: ID("scope", "scope", n) for n in ("fabric", "pod-1", "switch-1", "port-1", "port-2")}
NAMES = [c.split(" ")[0] for c in OBSERVATION.split(", ")]


@pytest.fixture(scope="session")
def topo(spark):
    up = {"pod-1": "fabric", "switch-1": "pod-1", "port-1": "switch-1", "port-2": "switch-1"}
    return Topology.of(
        spark, source=[{"id": i, "authority": a, "provenance": p, "enabled": True} for i, a, p in ((A, 10, "real"), (B, 5, "synthetic"), (X, 100, "unsupported"))],
        incarnation=[{"id": i, "source": i, "boot_epoch": 1, "started_at": 0} for i in (A, B, X)], generation=[{"id": g, "ordinal": 1} for g in (G0, G1)],
        binding=[{"resource": r, "generation": G1, "valid_from": 0} for r in (P1, P2)], scope=[{"id": SC[n], "label": n, "parent": SC.get(up.get(n)), "members": []} for n in SC],
        resource=[{"id": P1, "scope": SC["port-1"]}, {"id": P2, "scope": SC["port-2"]}],
    )


def ob(n, amount, category="useful-delivered-work", **k):
    base = dict(id=f"{n:032x}", source=A, epoch=1, sequence=n, generation=G1, observed_at=T0 + 300 * S, received_at=T0 + 301 * S, measure="wire-bytes", role="contribution", category=category, resource=P1, amount=amount, window_start=T0 + n * S, window_end=T0 + 600 * S, metadata=[])
    base |= k
    base = {"origin": base["id"], "incarnation": base["source"]} | base
    return tuple(Decimal(base[c]) if c in ("epoch", "sequence", "amount") else base.get(c) for c in NAMES)


def run(spark, topo, rows, **policy):
    return derivation.derive(spark.createDataFrame(rows, OBSERVATION), topo, Policy(**policy), T0, T0 + H, T0 + H)


def total(d):
    return int(d.claims.agg(F.coalesce(F.sum("known_total"), F.lit(0))).head()[0])


def reasons(d):
    return sorted({r["reason"] for r in d.unknowns.collect()})


def test_identities(spark):
    got = spark.range(1).select(ids.derive(F.lit("scope"), F.lit("scope"), F.lit("port-1")), ids.accounting_identity(F.lit(G1), F.lit(SC["port-1"]), F.lit("wire-bytes"), F.lit("retransmission"), F.lit("resource-direct"), F.lit(P1), *[F.lit(None).cast("string")] * 3)).head()
    assert got[0] == "c9e0250e022235505639655ac89889b1" and got[1] == "7ff69199285fa422b5d3867823ba28633dfc594da760a51f85f3a02bfa3eb701"


def test_times(spark):
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(times.parse(F.col("t"))).head()[0]
    assert one("1970-01-01T00:00:01.5Z") == 1_500_000_000 and one("1970-01-01t01:00:00+01:00") == 0 and one("-") == 0
    for bad in ("1970-01-01", "1970-13-01T00:00:00Z", "1970-01-01T00:00:60Z"):
        with pytest.raises(Exception, match="InvalidTime"):
            one(bad)
    assert spark.range(1).select(times.show(F.lit(-1)), times.duration(F.lit(3_661 * 10**9))).head()[:] == ("1969-12-31T23:59:59.999Z", "PT1H1M1S")


def test_sums_and_empty(spark, topo):
    assert total(run(spark, topo, [ob(1, 1000), ob(2, 2500, resource=P2)])) == 3500
    d = run(spark, topo, [])
    assert total(d) == 0 and d.efficiency.count() == 6 and d.efficiency.filter("determinate").count() == 0


def test_ratio(spark, topo):
    e = run(spark, topo, [ob(1, 900000), ob(2, 40000, "retransmission"), ob(3, 10000, "control-overhead")]).efficiency.filter("measure = 'wire-bytes'").head()
    assert (int(e["ratio_numerator"]), int(e["ratio_denominator"]), e["permille"], e["coverage"]) == (18, 19, 947, "partial")


@pytest.mark.parametrize(("amount", "status"), [(1000, "consistent"), (600, "residual"), (1200, "excess")])
def test_conservation(spark, topo, amount, status):
    rows = [ob(1, amount), ob(2, 1000, "unknown-unattributed", role="total")]
    d = run(spark, topo, rows)
    assert d.conservation.head()["status"] == status
    if status != "consistent":
        with pytest.raises(Exception, match="ConservationViolation|OverAttribution"):
            run(spark, topo, rows, residual="strict-reject", excess="strict-reject").conservation.collect()


@pytest.mark.parametrize(
    ("rows", "policy", "want", "reason"),
    [
        ([ob(1, 9, source=X)], {}, 0, "unsupported-provenance"),
        ([ob(1, 9, generation=G0)], {}, 0, "stale-generation"),
        ([ob(1, 100, sequence=5), ob(2, 900, sequence=5)], {}, 0, "conflicting-evidence"),
        ([ob(1, 100), ob(1, 5000)], {}, 0, "conflicting-evidence"),
        ([ob(1, 1500, window_start=T0), ob(2, 1500, source=B, window_start=T0)], {}, 1500, "duplicate-suppressed"),
        ([ob(1, 8000, window_start=T0), ob(2, 100, source=B, window_start=T0)], {}, 0, "conflicting-evidence"),
        ([ob(1, 8000, window_start=T0), ob(2, 100, source=B, window_start=T0)], {"conflict": "prefer-higher-authority"}, 8000, None),
        ([ob(1, 100), ob(2, 400, epoch=7)], {}, 400, "fenced-epoch"),
        ([ob(1, 100, observed_at=T0 + 400 * S)], {}, 0, "clock-anomaly"),
        ([ob(1, 100, resource="f" * 32)], {}, 0, "stale-generation"),
        ([ob(1, 100, resource="f" * 32)], {"require_generation_binding": False}, 0, "attribution-failure"),
        ([ob(1, 1000), ob(2, 5000, observed_at=T0 - 30 * H)], {}, 1000, "stale-evidence"),
    ],
)
def test_fences_and_disputes(spark, topo, rows, policy, want, reason):
    d = run(spark, topo, rows, **policy)
    assert total(d) == want
    assert reason is None or reason in reasons(d)


def test_strict_conflict_and_overflow(spark, topo):
    with pytest.raises(Exception, match="ConflictingEvidence"):
        run(spark, topo, [ob(1, 1, window_start=T0), ob(2, 2, source=B, window_start=T0)], conflict="strict-fail").claims.collect()
    with pytest.raises(Exception, match="ArithmeticOverflow"):
        run(spark, topo, [ob(i, 2**64 - 1) for i in range(1, 5)]).claims.collect()


def test_order_does_not_matter(spark, topo):
    rows = [ob(i, 10 + i, source=A if i % 3 else B, resource=P1 if i % 2 else P2) for i in range(1, 60)]
    one = lambda x: (lambda d: derivation.digest(d.claims, d.conservation).head()[0])(run(spark, topo, x))
    assert one(rows) == one(rows[::-1])


def test_topology(spark, topo):
    assert problems(topo).count() == 0
    assert [r[0] for r in ancestors(topo.scope, SC["port-1"]).collect()] == [SC["switch-1"], SC["pod-1"], SC["fabric"]]


def test_life_cycle(spark, topo, tmp_path):
    led = Ledger(spark, Store(spark, f"file://{tmp_path}/s"), topo)
    pid = led.open_period(T0, T0 + H)
    rows = spark.createDataFrame([ob(1, 100), ob(2, 5, window_end=T0)], OBSERVATION)
    assert led.ingest(rows) == {"accepted": 1, "rejected-shape": 1}
    assert led.ingest(rows)["duplicate-suppressed"] == 1
    first = led.close(pid, T0 + H)
    late = spark.createDataFrame([ob(3, 250)], OBSERVATION)
    assert led.ingest(late) == {"late-evidence": 1}
    led.correct(pid, T0 + H)
    sums = [int(led.query(pid, r)[0].agg(F.sum("known_total")).head()[0]) for r in (1, 2)]
    assert sums == [100, 350] and led.revisions(pid).filter("revision = 2").head()["parent"] == first
    assert led.verify()["breaks"] == 0 and led.verify()["damaged"] == 0
    assert int(led.rollup(pid).filter(F.col("scope") == SC["fabric"]).head()["known_total"]) == 350
    cell = led.result(pid, "claims").head()["cell"]
    assert led.explain(pid, cell).filter("step = 'counted'").count() == 2
    led.export(pid, f"file://{tmp_path}/e", "csv")
    assert led.compact() == 2 and led.stats()["observations"] == 0
    with pytest.raises(ValueError, match="PeriodFolded"):
        led.correct(pid, T0 + H)


def test_documents(spark, tmp_path):
    obs = spark.createDataFrame([ob(1, 2**64 - 1), ob(2, 7, observed_at=T0 + 123_456_789)], OBSERVATION)
    write_evidence(obs, f"file://{tmp_path}/d")
    back = read_evidence(spark, f"file://{tmp_path}/d").select(*NAMES)
    assert sorted(back.collect(), key=str) == sorted(obs.collect(), key=str)
    (tmp_path / "bad.jsonl").write_text('{"id": "x", "surprise": 1}\n')
    with pytest.raises(Exception, match="UnknownField"):
        read_evidence(spark, f"file://{tmp_path}/bad.jsonl").collect()


def test_stream(spark, topo, tmp_path):
    from evtally.streaming.ingest import stream_evidence

    led = Ledger(spark, Store(spark, f"file://{tmp_path}/s"), topo)
    led.open_period(T0, T0 + H)
    spark.createDataFrame([ob(1, 100), ob(2, 7)], OBSERVATION).write.parquet(f"file://{tmp_path}/in")
    stream_evidence(led, f"file://{tmp_path}/in", f"file://{tmp_path}/cp").awaitTermination()
    assert led.stats()["observations"] == 2


def test_explain_gives_all_rejects(spark, monkeypatch):
    """The registered query has no row cap; an entry budget reports what it cuts."""
    from types import SimpleNamespace

    from evtally import queries
    from evtally.operators import serving

    claims = spark.createDataFrame([("c", "g", "m", "b", "s", 1, 1, ["e"])], "cell string, generation string, measure string, basis string, scope string, known_total long, known_contributions long, evidence array<string>")
    rejected = spark.range(50_001).select(F.lit("g").alias("generation"), F.lit("m").alias("measure"), F.lit("r").alias("reason"), F.lit("x").alias("source"), F.col("id").cast("string").alias("id"))
    monkeypatch.setattr(queries, "derived", lambda *_: SimpleNamespace(claims=claims, rejected=rejected))
    steps = lambda df: {r["step"]: r["count"] for r in df.groupBy("step").count().collect()}
    assert steps(queries.explain_steps(spark, "")) == {"basis": 1, "total": 1, "counted": 1, "excluded": 50_001}
    cut = serving.explain(claims, rejected, "c", 7)
    assert steps(cut)["excluded"] == 7 and [tuple(r) for r in cut.filter("step = 'truncated'").collect()] == [("truncated", "50001", "7")]
    assert "truncated" not in steps(serving.explain(claims, rejected, "c", 50_001))
