"""From retained observations to what a period claims: one lazy plan."""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import admission, attribution, disputes, fences, folds
from ..policy import Policy
from ..topology import Topology


def members(obs: DataFrame, start: int, end: int) -> DataFrame:
    return obs.filter((F.col("window_start") >= start) & (F.col("window_end") <= end))


class Derivation:
    """Fences, admission, attribution, disputes and folds of the records of [start, end), as lazy plans.

    A result is planned when it is first asked for, and only what it needs. What several branches of
    one result read is kept (parts that do not fit or are lost are computed anew) until release(),
    which also ends a with block.
    """

    def __init__(self, obs: DataFrame, t: Topology, policy: Policy, start: int, end: int, as_of: int):
        self._obs, self._t, self._policy, self._span, self._as_of = obs, t, policy, (start, end), as_of
        self._kept: list[DataFrame] = []

    def __enter__(self) -> Derivation:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def release(self) -> None:
        for x in self._kept:
            x.unpersist()
        self._kept.clear()

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist())
        return df

    # one chain, for results that need no rejects
    @cached_property
    def _fenced(self) -> DataFrame:
        return fences.fenced(members(self._obs, *self._span))

    def _placed_of(self, fenced: DataFrame) -> tuple[DataFrame, DataFrame]:
        judged = admission.assessed(fences.survivors(fenced), self._t, self._policy, self._as_of)
        return judged, attribution.attributed(judged.filter("reason is null").drop("reason"), self._t)

    @cached_property
    def placed(self) -> DataFrame:
        return self._placed_of(self._fenced)[1]

    @cached_property
    def resolved(self) -> DataFrame:
        return disputes.resolve(self._entries(self.placed), self._policy)

    @property
    def _plain(self) -> bool:
        return disputes.plain(self._policy)

    @staticmethod
    def _entries(placed: DataFrame) -> DataFrame:
        return placed.filter("role = 'contribution' and not lost")

    def _totals(self, placed: DataFrame) -> DataFrame:
        home = F.when(F.col("lost"), F.lit("0" * 32)).otherwise(F.col("scope"))
        return disputes.totals(placed.filter("role = 'total'").withColumn("scope", home))

    @cached_property
    def contributions(self) -> DataFrame:
        return disputes.contributions(disputes.settle(self._entries(self.placed)) if self._plain else self.resolved)

    @cached_property
    def conflicts(self) -> DataFrame:
        return disputes.conflicts(self.resolved)

    @cached_property
    def cells(self) -> DataFrame:
        return folds.cells(self.contributions)

    @cached_property
    def claims(self) -> DataFrame:
        return folds.claims(self.contributions)

    @cached_property
    def totals(self) -> DataFrame:
        return self._totals(self.placed)

    # branches that meet again read what is kept
    @cached_property
    def _shared(self) -> tuple[DataFrame, DataFrame]:
        """Rejects of fences and admission, and the placed records."""
        fenced = self._keep(self._fenced)
        judged, placed = self._placed_of(fenced)
        cols = ["id", "source", "generation", "measure", "reason", "detail"]
        refused = judged.filter("reason is not null").withColumn("detail", F.lit("admission")).select(cols)
        return fences.fence_rejects(fenced).unionByName(refused), self._keep(placed)

    @cached_property
    def _settled(self) -> DataFrame:
        entries = self._entries(self._shared[1])
        return self._keep(disputes.settle(entries) if self._plain else disputes.resolve(entries, self._policy))

    @cached_property
    def rejected(self) -> DataFrame:
        early, placed = self._shared
        lost = placed.filter("lost and role = 'contribution'").select("id", "source", "generation", "measure", F.lit("attribution-failure").alias("reason"), F.lit("subject is not declared").alias("detail"))
        return early.unionByName(lost).unionByName(disputes.dispute_rejects(self._entries(placed), self._settled))

    @cached_property
    def _folded(self) -> DataFrame:
        """All records folded in one pass, under a plain policy: rows by reason, or by cell and window, or totals by domain and window.

        Hashes alone fold them, before they are shuffled, so conservation keeps neither records nor lists of them.
        """
        nothing = F.lit(None).cast("string")
        judged = admission.assessed(self._fenced, self._t, self._policy, self._as_of)
        x = attribution.attributed(judged, self._t)
        own = F.when(F.col("reason").isNotNull(), F.array("reason")).when(F.col("lost") & (F.col("role") == "contribution"), F.array(F.lit("attribution-failure"))).when(F.col("role").isin("contribution", "total"), F.array(nothing))
        why = F.when(fences.passed(), own).otherwise(F.transform(fences.findings(), lambda r: r["reason"]))
        x = x.withColumn("reason", F.explode(why))
        kept, entry, nil = F.col("reason").isNull(), F.col("reason").isNull() & (F.col("role") == "contribution"), F.lit("0" * 32)
        columns = {c: F.when(entry, F.col(c)) for c in (*disputes.SUBJECTS, "category", "basis")} | {c: F.when(kept, F.col(c)) for c in ("role", "window_start", "window_end", "amount")}
        columns["scope"] = F.when(kept, F.when(F.col("lost"), nil).otherwise(F.col("scope")))
        x = x.select("reason", "generation", "measure", *[v.alias(c) for c, v in columns.items()])
        return self._keep(x.groupBy(*[c for c in x.columns if c != "amount"]).agg(*disputes.spread()))

    @cached_property
    def _folds(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What conservation is made of: contributions' amounts, one for each kind of reject, and totals."""
        if not self._plain:
            return disputes.contributions(self._settled), self.rejected, self._totals(self._shared[1])
        x, kind = self._folded, ["generation", "measure", "reason"]
        entries = x.filter("reason is null and role = 'contribution'").withColumns({"agreed": disputes.agreed(), "amount": F.when(disputes.agreed(), F.col("lo"))})
        again = F.when(F.col("agreed"), "duplicate-suppressed").when(F.col("amount").isNull(), "conflicting-evidence")
        kinds = x.filter("reason is not null").select(kind).unionByName(entries.filter("k > 1").withColumn("reason", again).select(kind)).distinct()
        totals = x.filter("reason is null and role = 'total'").withColumn("amount", F.when(F.col("lo") == F.col("hi"), F.col("lo")))
        return entries.filter("amount is not null"), kinds, totals

    @cached_property
    def _unknown(self) -> DataFrame:
        _, kinds, totals = self._folds
        return self._keep(folds.unknowns(kinds, totals.filter("amount is null")))

    @cached_property
    def conservation(self) -> DataFrame:
        contrib, _, totals = self._folds
        return folds.conservation(contrib, self._unknown, totals, self._policy)

    @cached_property
    def unknowns(self) -> DataFrame:
        late = self.conservation.filter("status in ('residual', 'excess')").select("scope", "generation", "measure", F.when(F.col("status") == "residual", "residual-unclassified").otherwise("over-attribution").alias("reason"), F.lit(1).cast("long").alias("evidence_count"))
        return self._unknown.unionByName(late).distinct()

    @cached_property
    def efficiency(self) -> DataFrame:
        return folds.efficiency(folds.known(self._folds[0]), self.conservation)


def derive(obs: DataFrame, t: Topology, policy: Policy, start: int, end: int, as_of: int) -> Derivation:
    """What the records of [start, end) come to under a topology and a policy."""
    return Derivation(obs, t, policy, start, end, as_of)


#: The digest of no results at all: that of an empty text.
EMPTY = hashlib.sha256(b"").hexdigest()


def digests(claim: DataFrame, domains: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Content digests, one for each value of by, that depend on neither order nor partitions: equal evidence, equal digest."""
    row = lambda df: df.select(*by, F.sha2(F.to_json(F.struct(*sorted(set(df.columns) - set(by)))), 256).alias("h"))
    fold = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    some = row(claim).unionByName(row(domains)).groupBy(*by, F.substring("h", 1, 4).alias("p")).agg(fold("h").alias("g"))
    return some.groupBy(*by).agg(fold(F.concat("p", "g")).alias("own"))  # at most 65,536 parts meet


def digest(claim: DataFrame, domains: DataFrame) -> DataFrame:
    """The one digest of a derivation's results."""
    return digests(claim, domains).select(F.col("own").alias("digest"))
