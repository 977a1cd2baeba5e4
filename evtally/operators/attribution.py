"""Attribution of records to accounting cells: resource, then path, flow, reservation, else none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import NIL, accounting_identity
from ..topology import Topology


def attributed(obs: DataFrame, t: Topology) -> DataFrame:
    """Rows with basis, scope, the one subject of the cell, and lost (the named subject is not declared)."""
    x = obs
    scopes = t.joined("scope", F.col("id").alias("known_scope"))
    res = t.resource.join(scopes, F.col("scope") == F.col("known_scope")).select(F.col("id").alias("d_resource"), F.col("scope").alias("scope_resource"))
    dims = [("resource", F.broadcast(res) if t.small("resource") else res)]
    dims += [(n, t.joined(n, F.col("id").alias(f"d_{n}"), F.col("scope").alias(f"scope_{n}"))) for n in ("path", "flow", "reservation")]
    for n, d in dims:
        x = x.join(d, F.col(n) == F.col(f"d_{n}"), "left")
    order = ("resource", "path", "flow", "reservation")
    first = lambda value, other: "CASE " + " ".join(f"WHEN {n} IS NOT NULL THEN {value(n)}" for n in order) + f" ELSE {other} END"
    x = x.withColumns({
        "basis": F.expr(first(lambda n: f"'{n}-direct'", "'unattributed'")),
        "scope": F.expr(f"coalesce({first(lambda n: f'scope_{n}', 'null')}, '{NIL}')"),
        "lost": F.expr(first(lambda n: f"d_{n} IS NULL", "false")),
    })
    own = {n: f"CASE WHEN basis = '{n}-direct' THEN {n} END AS {n}" for n in order}
    return x.selectExpr(*[own.get(c, f"`{c}`") for c in x.columns if c not in {f"{p}_{n}" for p in ("d", "scope") for n in order}])


def identity() -> Column:
    """The identity of a row's cell; computed where cells are few, after they are folded."""
    return accounting_identity("generation", "scope", "measure", "category", "basis", "resource", "flow", "path", "reservation")
