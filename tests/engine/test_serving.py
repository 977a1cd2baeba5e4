"""What is served: exports as published, buckets with filters and a limit, orders, and checks of what is stored."""

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evtally.operators import gates, serving
from evtally.plans.ledger import Ledger
from evtally.sources.evidence import OBSERVATION
from evtally.sources.store import Store

from .test_engine import G1, P1, P2, SC, T0, A, B, H, ob, topo  # noqa: F401

HEADER = "scope,generation,measure,unit,category,usefulness,basis,resource,flow,path,reservation,coverage,known_total,known_contributions,unknown_contributions"


@pytest.fixture
def led(spark, topo, tmp_path):  # noqa: F811
    x = Ledger(spark, Store(spark, f"file://{tmp_path}/s"), topo)
    x.pid = x.open_period(T0, T0 + H)
    rows = [ob(1, 2**63), ob(2, 5, resource=P2, category="retransmission"), ob(3, 7, source=B, category="control-overhead"), ob(4, 9, resource=SC["fabric"])]  # the last has no such resource
    x.ingest(spark.createDataFrame(rows, OBSERVATION))
    return x


def part(path):
    (own,) = Path(path).glob("part-*")
    return own.read_bytes()


def test_exports(led, tmp_path):
    led.close(led.pid, T0 + H)
    for form in ("csv", "jsonl", "canonical-json"):
        own = led.export(led.pid, f"file://{tmp_path}/{form}", form, evidence=True)
        assert own == hashlib.sha256(part(tmp_path / form)).hexdigest()
    lines = part(tmp_path / "csv").decode().split("\r\n")
    assert lines[0] == HEADER and lines[-1] == "" and len(lines) == 5
    direct = f"{SC['port-1']},{G1},wire-bytes,octets,useful-delivered-work,useful,resource-direct,{P1},-,-,-,known,{2**63},1,0"
    assert direct in lines
    rows = [json.loads(x) for x in part(tmp_path / "jsonl").decode().splitlines()]
    assert [list(r) for r in rows] == [sorted(r) for r in rows] and {r["known_total"] for r in rows} == {2**63, 5, 7}
    assert sorted(e for r in rows for e in r["evidence"]) == [f"{i:032x}" for i in (1, 2, 3)]
    assert json.loads(part(tmp_path / "canonical-json"))["rows"] == rows


def test_export_of_nothing(spark, topo, tmp_path):  # noqa: F811
    x = Ledger(spark, Store(spark, f"file://{tmp_path}/s"), topo)
    pid = x.open_period(T0, T0 + H)
    for form, want in (("csv", HEADER + "\r\n"), ("jsonl", ""), ("canonical-json", '{"rows":[\n],"schema":"export/1"}\n')):
        x.export(pid, f"file://{tmp_path}/{form}", form)
        assert part(tmp_path / form).decode() == want


def test_buckets(led):
    rows, note = led.buckets(led.pid, "category")
    got = {(r["category"], r["source"]): r for r in rows.collect()}
    assert note == {"truncated": False, "total_available": len(got), "returned": len(got)}
    useful = got["useful-delivered-work", A]
    assert int(useful["cells"][0]["known_total"]) == 2**63 and useful["proof_surfaces"] == "REAL" and useful["cells"][0]["coverage"] == "known"
    unknown = [r for r in got.values() if r["evidence_count"] == 0]
    assert unknown and all(r["proof_surfaces"] == "NONE" and r["cells"][0]["coverage"] == "unknown" and r["cells"][0]["reasons"] for r in unknown)
    cut, note = led.buckets(led.pid, "category", limit=1)
    assert [r["category"] for r in cut.collect()] == ["useful-delivered-work"] and note["truncated"] and note["returned"] == 1
    some, _ = led.buckets(led.pid, "scope", scope=SC["port-2"])
    assert [int(r["cells"][0]["known_total"]) for r in some.collect()] == [5]
    assert led.buckets(led.pid, "scope", measure="frame-count")[1]["total_available"] == 0
    with pytest.raises(ValueError, match="axis"):
        led.buckets(led.pid, "colour")
    with pytest.raises(ValueError, match="time axis"):
        led.buckets(led.pid, "time")


def test_buckets_count_a_reason_once(led, spark):
    """Disputed totals of one domain that differ in their evidence count give one reason."""
    lost = spark.createDataFrame([("s", G1, "wire-bytes", r, k) for r, k in (("a", 2), ("a", 3), ("b", 2))], "scope string, generation string, measure string, reason string, evidence_count long")
    rows, _ = serving.buckets(led.derive(led.pid).contributions.limit(0), lost, "category")
    (cell,) = rows.head()["cells"]
    assert (cell["unknown_contributions"], cell["reasons"], cell["known_contributions"], cell["coverage"]) == (2, ["a", "b"], 0, "unknown")


def test_orders(led):
    d = led.derive(led.pid)
    first = [r["category"] for r in serving.ordered("claims", d.claims.withColumn("scope", F.lit("x"))).collect()]
    assert first == ["useful-delivered-work", "retransmission", "control-overhead"]
    for name in ("unknowns", "rejected", "conflicts", "conservation"):
        rows = [tuple(r[c] for c in serving.ORDERS[name] if c != "measure") for r in serving.ordered(name, getattr(d, name)).collect()]
        assert rows == sorted(rows)


def test_forged_results_and_corrections_are_told(led, spark):
    led.close(led.pid, T0 + H)
    led.ingest(spark.createDataFrame([ob(5, 250)], OBSERVATION))
    led.correct(led.pid, T0 + H)
    good = led.verify()
    assert (good["lineages"], good["breaks"], good["forged"], good["unmatched"]) == (2, 0, 0, 0)
    claims = led.store.read("claims")
    led.store.replace(claims=claims.withColumn("known_total", F.when(F.col("revision") == 2, F.col("known_total") + 1).otherwise(F.col("known_total")).cast("decimal(20,0)")))
    assert led.verify()["forged"] == 1
    led.store.replace(corrections=led.store.read("corrections").withColumn("to_revision", F.lit(9)))
    assert led.verify()["unmatched"] == 2  # the link leads nowhere, and revision 2 has none


@pytest.mark.parametrize(("change", "fault"), [({"measure": "nope"}, "unknown name"), ({"category": "nope"}, "unknown name"), ({"role": "nope"}, "unknown name"), ({"window_end": T0}, "window"), ({}, None)])
def test_shape(spark, change, fault):
    row = spark.createDataFrame([ob(1, 1, **change)], OBSERVATION)
    assert row.select(gates.shape_fault()).head()[0] == fault
