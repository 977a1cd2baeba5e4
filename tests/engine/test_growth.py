"""What lets a derivation grow with its input: what is shuffled, kept and folded, and that the results stay the same."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from evtally.operators import disputes, fences, folds
from evtally.policy import Policy
from evtally.sources.evidence import OBSERVATION

from .test_engine import P2, S, T0, A, B, ob, run, topo  # noqa: F401


def mixed():
    """Agreed, disputed and repeated records, clashes of each fence, totals that agree and that do not, and a lost subject."""
    rows = [ob(i, 10 + i % 4, source=A if i % 3 else B, resource=P2 if i % 5 else None, window_start=T0 + i % 7) for i in range(1, 60)]
    rows += [ob(60, 1), ob(60, 2), ob(61, 1, sequence=900), ob(62, 2, sequence=900), ob(63, 1, origin="o"), ob(64, 1, origin="o", sequence=63, window_start=T0 + 63 * S), ob(65, 1, resource="f" * 32)]
    return rows + [ob(i, 70 + i % 3, "unknown-unattributed", role="total", resource=None, window_start=T0 + i % 2) for i in range(70, 75)]


def test_fences_move_no_content(spark):
    x = fences.fenced(spark.createDataFrame(mixed(), OBSERVATION))
    assert "content" not in x.columns  # 64 digits that do not compress, in two shuffles
    found = {r["id"][-2:]: (r["id_clash"], r["origin_fence"], r["sequence_fence"]) for r in x.filter("id >= lpad('3c', 32, '0') and id <= lpad('41', 32, '0')").collect()}
    assert found == {"3c": (True, "divergent", "divergent"), "3d": (False, None, "divergent"), "3e": (False, None, "divergent"), "3f": (False, None, None), "40": (False, "duplicate", "duplicate"), "41": (False, None, None)}


def test_settle_is_resolve(spark, topo):  # noqa: F811
    entries = run(spark, topo, mixed() + [ob(80, 5, window_start=T0 + 9), ob(81, 5, window_start=T0 + 9)]).placed.filter("role = 'contribution' and not lost")
    for x in (entries, entries.withColumn("amount", F.when(~F.col("id").endswith("1"), F.col("amount")))):
        one, two = disputes.settle(x), disputes.resolve(x, Policy())
        assert sorted(map(str, one.collect())) == sorted(map(str, two.select(one.columns).collect()))


@pytest.mark.parametrize("tie", ["reject", "lowest-source-id-wins", "highest-source-id-wins"])
def test_authority_folds_once(spark, tie):
    def wanted(votes):
        best = None
        for v in sorted(votes):
            if best is None or v[2] > best[2]:
                best = v
            elif v[2] == best[2] and v[1] != best[1]:
                if tie == "reject":
                    return None
                best = min(best, v, key=lambda s: s[1]) if tie == "lowest-source-id-wins" else max(best, v, key=lambda s: s[1])
        own = [v for v in votes if v[1] == best[1]]
        return own[0][0] if len(own) == 1 else None

    rnd, rank = random.Random(5), {s: k // 2 for k, s in enumerate("abcdef")}
    groups = [sorted({(rnd.randrange(6), s := rnd.choice("abcdef"), rank[s]) for _ in range(rnd.randint(1, 5))}) for _ in range(200)]
    x = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "i int, v array<struct<amount:long,source:string,rank:long>>")
    x = x.withColumn("v", F.col("v").cast("array<struct<amount:decimal(20,0),source:string,rank:decimal(20,0)>>"))
    x = x.select("i", disputes.by_authority(F.col("v"), tie).alias("won"))
    assert {r["i"]: r["won"] for r in x.collect()} == {i: wanted(g) for i, g in enumerate(groups)}
    assert x._jdf.queryExecution().analyzed().toString().count("aggregate(array_sort") == 1  # in the filter it ran again for each vote


def test_conservation_keeps_folds_alone(spark, topo):  # noqa: F811
    d = run(spark, topo, mixed())
    kinds = folds.unknowns(d.rejected, d.totals.filter("amount is null"))
    other = folds.conservation(disputes.contributions(d.resolved), kinds, d.totals, Policy())
    e = run(spark, topo, mixed())
    assert sorted(map(str, e.conservation.collect())) == sorted(map(str, other.collect()))
    assert sorted(map(str, e.efficiency.collect())) == sorted(map(str, folds.efficiency(d.cells, other).collect()))
    names = reduce(set.union, [set(x.columns) for x in e._kept])
    assert not names & {"id", "observed_at", "id_clash"}  # neither records nor their rejects were kept
