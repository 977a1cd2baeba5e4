"""The ledger: periods, ingest, closing, corrections and what is served from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import derive, derive_text
from ..operators import gates, serving
from ..policy import Policy
from ..sources.store import Store
from ..topology import Topology, problems
from . import derivation

RESULTS = ("claims", "conservation", "efficiency", "rejected", "conflicts", "unknowns")


class Ledger:
    """All state is in the store; every method reads it anew. Revisions are never changed."""

    def __init__(self, spark: SparkSession, store: Store, topology: Topology, policy: Policy | None = None):
        self.spark, self.store, self.topology, self.policy = spark, store, topology, policy or Policy()
        if bad := problems(topology).limit(1).collect():
            raise ValueError(f"InvalidTopology: {bad[0]['check']}")

    # periods
    def periods(self) -> DataFrame:
        """id, label, start, end, state (open, closed, superseded, folded), revision."""
        x = self.store.read("periods")
        if x is None:
            return self.spark.createDataFrame([], "id string, label string, start long, end long, state string, revision int")
        return x.groupBy("id").agg(F.max_by(F.struct("label", "start", "end", "state", "revision"), "at").alias("p")).select("id", "p.*").orderBy("start")

    def _period(self, pid: str):
        found = self.periods().filter(F.col("id") == pid).collect()
        if not found:
            raise KeyError("PeriodNotFound")
        return found[0]

    def _mark(self, p, state: str, revision: int) -> DataFrame:
        at = self.store.manifest()["revision"] + 1
        return self.spark.createDataFrame([(p["id"], p["label"], p["start"], p["end"], state, revision, at)], "id string, label string, start long, end long, state string, revision int, at long")

    def open_period(self, start: int, end: int, label: str = "") -> str:
        if not 1_000_000 <= end - start <= self.policy.max_period:
            raise ValueError("InvalidArgument: period span")
        if self.periods().filter((F.col("start") < end) & (F.col("end") > start)).limit(1).count():
            raise ValueError("PeriodOverlap")
        pid = derive_text("period", "period", str(start), str(end))
        self.store.append(periods=self._mark({"id": pid, "label": label, "start": start, "end": end}, "open", 0))
        return pid

    # ingest
    def observations(self) -> DataFrame | None:
        return self.store.read("observations")

    def ingest(self, obs: DataFrame) -> dict[str, int]:
        """Gate, drop what is already retained (same id and content at the same receive time), and append; counts by verdict."""
        record = F.sha2(F.to_json(F.struct(*sorted(obs.columns))), 256)
        if self.policy.batch_dedup:
            obs = obs.dropDuplicates(["id"]) if not obs.columns else obs.withColumn("record", record).dropDuplicates(["id", "record"]).drop("record")
        gated = gates.gate(obs, self.topology, self.periods()).withColumn("record", record)
        known = self.observations()
        if known is not None:
            same = known.select(F.col("id").alias("k_id"), F.col("record").alias("k_record")).distinct()
            gated = gated.join(same, (F.col("id") == F.col("k_id")) & (F.col("record") == F.col("k_record")), "left")
            retained = F.col("verdict").isin("accepted", "late-evidence") & F.col("k_id").isNotNull()
            gated = gated.withColumn("verdict", F.when(retained, "duplicate-suppressed").otherwise(F.col("verdict"))).drop("k_id", "k_record")
        counts = {r["verdict"]: r["n"] for r in gates.report(gated).collect()}
        keep = ["accepted"] + ["late-evidence"] * (self.policy.late == "requires-correction")
        mark = gated.filter(F.col("verdict").isin(keep))
        newest = mark.agg(F.max("received_at")).head()[0]
        if newest is not None:
            self.store.append(newest, observations=mark.drop("verdict", "p_state"))
        return counts

    # derivation
    def derive(self, pid: str, as_of: int | None = None) -> derivation.Derivation:
        p, obs = self._period(pid), self.observations()
        if obs is None:
            from ..sources.evidence import OBSERVATION

            obs = self.spark.createDataFrame([], OBSERVATION)
        as_of = as_of if as_of is not None else self.store.manifest()["watermark"]
        return derivation.derive(obs, self.topology, self.policy, p["start"], p["end"], as_of)

    def _publish(self, pid: str, as_of: int, revision: int, parent: str | None, state: str, corrected: int | None = None) -> str:
        """A revision, its results, its period's state and, of a correction, its link, in one manifest."""
        with self.derive(pid, as_of) as d:
            stamp = lambda df: df.withColumn("period", F.lit(pid)).withColumn("revision", F.lit(revision))
            claim, domains = d.claims.persist(), d.conservation.persist()
            try:
                own = derivation.digest(claim, domains).head()[0]
                own = derive_text("revision", pid, str(revision), parent or "-", own) + own[32:]
                head = self.spark.createDataFrame([(pid, revision, own, parent, as_of)], "period string, revision int, digest string, parent string, as_of long")
                new = {"revisions": head, "periods": self._mark(self._period(pid), state, revision)}
                new |= {n: stamp({"claims": claim, "conservation": domains}[n] if n in ("claims", "conservation") else getattr(d, n)) for n in RESULTS}
                if corrected is not None:
                    new["corrections"] = self.spark.createDataFrame([(pid, corrected, revision, own)], "period string, from_revision int, to_revision int, digest string")
                self.store.commit(new)
            finally:
                claim.unpersist()
                domains.unpersist()
        return own

    def close(self, pid: str, as_of: int, dry_run: bool = False):
        p = self._period(pid)
        if p["state"] != "open":
            raise ValueError("PeriodNotOpen")
        return self.derive(pid, as_of) if dry_run else self._publish(pid, as_of, 1, None, "closed")

    def correct(self, pid: str, as_of: int) -> str:
        p = self._period(pid)
        if p["state"] == "open":
            raise ValueError("PeriodOpen")
        if p["state"] == "folded":
            raise ValueError("PeriodFolded")
        if p["revision"] - 1 >= self.policy.max_corrections:
            raise ValueError("CorrectionLimitReached")
        parent = self.revisions(pid).orderBy(F.desc("revision")).head()["digest"]
        return self._publish(pid, as_of, p["revision"] + 1, parent, "superseded", corrected=p["revision"])

    # serving
    def revisions(self, pid: str) -> DataFrame:
        x = self.store.read("revisions")
        return x.filter(F.col("period") == pid) if x is not None else self.spark.createDataFrame([], "period string, revision int, digest string, parent string, as_of long")

    def result(self, pid: str, name: str, revision: int | None = None) -> DataFrame:
        """A result table of the wanted revision, else the latest, else of a live derivation."""
        last = revision or self._period(pid)["revision"]
        if not last:
            return getattr(self.derive(pid), name)
        return self.store.read(name).filter((F.col("period") == pid) & (F.col("revision") == last)).drop("period", "revision")

    def query(self, pid: str, revision: int | None = None, **filters):
        filters.setdefault("limit", self.policy.max_result_rows)
        return serving.rows(self.result(pid, "claims", revision), self.topology.ancestry(), self.result(pid, "conflicts", revision), **filters)

    def aggregate(self, pid: str, axis: str, width: int = 0, parity: bool = True) -> DataFrame:
        p = self._period(pid)
        if p["state"] == "folded" and axis in ("time", "source"):  # a folded cell keeps neither its windows nor each source's share
            raise ValueError("UnsupportedQuery")
        contrib = self.derive(pid).contributions if p["state"] != "folded" else self.result(pid, "claims").select("*", F.col("known_total").alias("amount"), F.element_at("sources", 1).alias("source"), F.lit(p["end"]).alias("window_end")).drop("provenance").withColumn("provenance", F.lit("real"))
        return (serving.aggregate if parity else serving.aggregate_axis)(contrib, axis, p["start"], width)

    def buckets(self, pid: str, axis: str, width: int = 0, **filters):
        """Buckets with their cells, unknowns and proof surfaces, and a report of what a limit cuts; for a folded period use aggregate."""
        p = self._period(pid)
        if p["state"] == "folded":
            raise ValueError("UnsupportedQuery")
        d = self.derive(pid)
        return serving.buckets(d.contributions, d.unknowns, axis, p["start"], width, **filters)

    def rollup(self, pid: str) -> DataFrame:
        return serving.rollup(self.result(pid, "claims"), self.topology.ancestry())

    def reconcile(self, pid: str, scope: str | None = None) -> DataFrame:
        return serving.reconcile(self.result(pid, "conservation"), scope)

    def explain(self, pid: str, cell: str) -> DataFrame:
        return serving.explain(self.result(pid, "claims"), self.result(pid, "rejected"), cell, self.policy.max_explanation_entries)

    def export(self, pid: str, path: str, form: str = "jsonl", evidence: bool = False) -> str:
        """All rows of the period in one file, and its digest; an export has no row limit."""
        return serving.export(self.query(pid, limit=2**31 - 1)[0], path, form, evidence)

    # integrity
    def verify(self) -> dict:
        """Files against the manifest, revisions against the ones before, their digests and their corrections.

        breaks: revisions out of line; forged: those whose digest is not that of the results in the
        store; unmatched: corrections that lead to no revision, and later revisions without a correction.
        """
        out = self.store.verify() | {"lineages": 0, "breaks": 0, "forged": 0, "unmatched": 0}
        x = self.store.read("revisions")
        if x is None or out["missing"] or out["damaged"]:
            return out
        ok = chain(x).agg(F.count("*"), F.count_if(~F.col("ok"))).head()
        claim, domains = self.store.read("claims"), self.store.read("conservation")
        mine = derivation.digests(claim, domains, ("period", "revision")).select(F.col("period").alias("p"), F.col("revision").alias("r"), "own")
        met = x.join(mine, (F.col("period") == F.col("p")) & (F.col("revision") == F.col("r")), "left")
        own = F.coalesce("own", F.lit(derivation.EMPTY))  # a revision without any result
        want = F.concat(derive(F.lit("revision"), F.col("period"), F.col("revision").cast("string"), F.coalesce("parent", F.lit("-")), own), own.substr(33, 32))
        out |= {"lineages": ok[0], "breaks": ok[1], "forged": met.filter(F.col("digest") != want).count()}
        link = self.store.read("corrections")
        later = x.filter("revision > 1").select("period", "revision", F.col("digest").alias("of"))
        if link is None:
            return out | {"unmatched": later.count()}
        same = (link["period"] == later["period"]) & (link["to_revision"] == later["revision"]) & (link["digest"] == later["of"]) & (link["from_revision"] + 1 == link["to_revision"])
        return out | {"unmatched": link.join(later, same, "full").filter(link["period"].isNull() | later["period"].isNull()).count()}

    def compact(self, dry_run: bool = False) -> int:
        """Drop retained evidence that the latest claims of closed periods already count."""
        obs, claim = self.observations(), self.store.read("claims")
        if obs is None or claim is None:
            return 0
        shut = self.periods().filter("state in ('closed', 'superseded')").select(F.col("id").alias("period"), "revision")
        used = claim.join(shut, ["period", "revision"], "left_semi").select(F.explode("evidence").alias("id")).distinct()
        n = obs.join(used, "id", "left_semi").count()
        if n and not dry_run:
            at = F.lit(self.store.manifest()["revision"] + 1).cast("long")
            folded = self.periods().filter("state in ('closed', 'superseded')").withColumn("state", F.lit("folded")).withColumn("at", at)
            self.store.commit({"periods": folded}, {"observations": obs.join(used, "id", "left_anti")})
        return n

    def stats(self) -> dict:
        obs, p = self.observations(), self.periods()
        return {"observations": obs.count() if obs is not None else 0, "periods": {r["state"]: r["count"] for r in p.groupBy("state").count().collect()}}


def chain(revisions: DataFrame) -> DataFrame:
    """Revisions with ok: numbered without gaps, each naming the digest before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("period").orderBy("revision")
    first = F.lag("revision").over(w).isNull()
    good = F.when(first, (F.col("revision") == 1) & F.col("parent").isNull()).otherwise((F.col("revision") == F.lag("revision").over(w) + 1) & F.col("parent").eqNullSafe(F.lag("digest").over(w)))
    return revisions.withColumn("ok", good)
