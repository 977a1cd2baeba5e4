"""Command line: python -m evtally.cli STORE COMMAND ... with a topology and a policy document."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans.ledger import Ledger
from .policy import Policy, parse_policy
from .sources.evidence import read_evidence
from .sources.store import Store
from .topology import Topology


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="evtally")
    p.add_argument("store")
    p.add_argument("command", choices=("init", "open", "ingest", "close", "correct", "query", "aggregate", "rollup", "reconcile", "explain", "export", "verify", "stats", "compact"))
    p.add_argument("--topology", required=True)
    p.add_argument("--policy")
    for o in ("evidence", "period", "scope", "category", "measure", "generation", "axis", "cell", "out"):
        p.add_argument(f"--{o}")
    p.add_argument("--format", default="jsonl")
    for o in ("start", "end", "as-of", "width", "limit", "revision"):
        p.add_argument(f"--{o}", type=int)
    for o in ("descendants", "dry-run"):
        p.add_argument(f"--{o}", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with open(a.topology) as f:
        t = Topology.parse(spark, f.read())
    policy = parse_policy(open(a.policy).read()) if a.policy else Policy()
    ledger = Ledger(spark, Store(spark, a.store), t, policy)
    show = lambda df: [print(x) for x in df.toJSON().take(100_000)]
    c, ok = a.command, True
    if c == "open":
        print(ledger.open_period(a.start, a.end))
    elif c == "ingest":
        print(json.dumps(ledger.ingest(read_evidence(spark, a.evidence))))
    elif c == "close":
        print(ledger.close(a.period, a.as_of, a.dry_run))
    elif c == "correct":
        print(ledger.correct(a.period, a.as_of))
    elif c == "query":
        rows, note = ledger.query(a.period, a.revision, category=a.category, measure=a.measure, generation=a.generation, scope=a.scope, descendants=a.descendants, **({"limit": a.limit} if a.limit else {}))
        show(rows)
        print(json.dumps(note))
    elif c == "aggregate":
        rows, note = ledger.buckets(a.period, a.axis, a.width or 0, generation=a.generation, measure=a.measure, scope=a.scope, **({"limit": a.limit} if a.limit else {}))
        show(rows)
        print(json.dumps(note))
    elif c == "rollup":
        show(ledger.rollup(a.period))
    elif c == "reconcile":
        r = ledger.reconcile(a.period, a.scope)
        show(r)
        ok = r.head()["fully_consistent"]
    elif c == "explain":
        r = ledger.explain(a.period, a.cell)
        show(r)
        ok = bool(r.limit(1).count())
    elif c == "export":
        print(ledger.export(a.period, a.out, a.format))
    elif c == "verify":
        v = ledger.verify()
        print(json.dumps(v))
        ok = not (v["missing"] or v["damaged"] or v["breaks"] or v["forged"] or v["unmatched"])
    elif c == "stats":
        print(json.dumps(ledger.stats()))
    elif c == "compact":
        print(ledger.compact(a.dry_run))
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
