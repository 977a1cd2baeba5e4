"""The declared topology as dimension frames, with its validation and closure."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "source": "id string, label string, kind string, authority decimal(20,0), provenance string, enabled boolean",
    "incarnation": "id string, source string, boot_epoch decimal(20,0), started_at long, retired_at long",
    "generation": "id string, ordinal long, label string, effective_from long, effective_to long, state string",
    "binding": "resource string, generation string, valid_from long, valid_to long",
    "scope": "id string, label string, kind string, parent string, members array<string>",
    "resource": "id string, label string, kind string, scope string",
    "flow": "id string, label string, scope string, generation string, path_hint array<string>",
    "path": "id string, label string, scope string, generation string, hops array<string>",
    "reservation": "id string, label string, scope string, generation string, resource string, reserved_capacity_nanos long, valid_from long, valid_to long",
}


#: Rows up to which a dimension, once counted, is broadcast, and the scope forest is closed on the driver.
SMALL = 100_000


def local(spark: SparkSession, rows: list[tuple] | list[dict], schema: str) -> DataFrame:
    """Few rows as a frame that the JVM makes from one literal: no Python in the plan, no job to build it."""
    names = [f.split()[0] for f in schema.split(", ")]
    given = [r if isinstance(r, dict) else dict(zip(names, r, strict=True)) for r in rows]
    text = json.dumps([{k: v for k, v in r.items() if v is not None} for r in given], default=str)
    fields_ = ",".join(f"`{n}`:{k}" for n, k in (f.split(" ", 1) for f in schema.split(", ")))
    one = spark.range(0, 1, 1, 1)
    return one.select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields_}>>", {"mode": "FAILFAST"})))


@dataclass
class Topology:
    source: DataFrame
    incarnation: DataFrame
    generation: DataFrame
    binding: DataFrame
    scope: DataFrame
    resource: DataFrame
    flow: DataFrame
    path: DataFrame
    reservation: DataFrame
    sizes: dict = field(default_factory=dict, repr=False)
    closed: DataFrame | None = field(default=None, repr=False)

    @classmethod
    def of(cls, spark: SparkSession, **rows) -> Topology:
        """From lists of dicts or frames; what is left out is empty."""
        sizes = {n: len(rows.get(n, [])) for n in SCHEMAS if not isinstance(rows.get(n), DataFrame)}

        def frame(name):
            x = rows.get(name, [])
            if isinstance(x, DataFrame):
                return x
            names = [f.split()[0] for f in SCHEMAS[name].split(", ")]
            return local(spark, [{n: r.get(n) for n in names} for r in x], SCHEMAS[name])

        return cls(**{n: frame(n) for n in SCHEMAS}, sizes=sizes)

    @classmethod
    def parse(cls, spark: SparkSession, text: str) -> Topology:
        """From a JSON document with one array a dimension; other keys, of the document or of a row, are refused."""
        j = json.loads(text)
        if extra := set(j) - set(SCHEMAS) - {"format_version"}:
            raise ValueError(f"UnknownField: {sorted(extra)}")
        for name, rows in j.items():
            if name in SCHEMAS:
                known = {f.split()[0] for f in SCHEMAS[name].split(", ")}
                if extra := {k for r in rows for k in r} - known:
                    raise ValueError(f"UnknownField: {name} {sorted(extra)}")
        return cls.of(spark, **{k: v for k, v in j.items() if k in SCHEMAS})

    def small(self, name: str) -> bool:
        """Whether the dimension has at most SMALL rows; frames are counted once."""
        if name not in self.sizes:
            self.sizes[name] = getattr(self, name).limit(SMALL + 1).count()
        return self.sizes[name] <= SMALL

    def joined(self, name: str, *columns) -> DataFrame:
        """The dimension's columns for a join with records: broadcast if it is small, else as it is."""
        x = getattr(self, name).select(*columns)
        return F.broadcast(x) if self.small(name) else x

    def ancestry(self) -> DataFrame:
        """closure() of the scopes, computed once; of a small forest on the driver."""
        if self.closed is None:
            if self.small("scope"):
                up = {r["id"]: r["parent"] for r in self.scope.select("id", "parent").collect()}
                self.closed = F.broadcast(local(self.scope.sparkSession, climbed(up), "leaf string, anc string, depth int"))
            else:
                self.closed = closure(self.scope)
        return self.closed


def climbed(up: dict[str, str | None]) -> list[tuple[str, str, int]]:
    """(leaf, ancestor, depth) of a forest given by its parents; a cycle is an error, an undeclared parent ends the climb as the last ancestor."""
    out = []
    for leaf in up:
        at, depth = leaf, 0
        while at is not None:
            if depth > len(up):
                raise ValueError("InvalidTopology: scopes form a cycle")
            out.append((leaf, at, depth))
            at, depth = up.get(at), depth + 1
    return out


def closure(scope: DataFrame) -> DataFrame:
    """(leaf, anc, depth) of the scope forest, each scope its own ancestor at depth 0; a cycle is an error."""
    up = scope.select(F.col("id").alias("child"), "parent").filter("parent is not null")
    level = scope.select(F.col("id").alias("leaf"), F.col("id").alias("anc"), F.lit(0).alias("depth"))
    out, depth = level, 0
    while True:  # one join a level of the forest
        depth += 1
        level = level.join(up, level["anc"] == up["child"]).select("leaf", F.col("parent").alias("anc"), F.lit(depth).alias("depth")).cache()
        if not level.limit(1).count():
            return out
        if depth > 10_000:
            raise ValueError("InvalidTopology: scopes form a cycle")
        out = out.unionByName(level)


def descendants(scope: DataFrame, node: str) -> DataFrame:
    return closure(scope).filter((F.col("anc") == node) & (F.col("depth") > 0)).select(F.col("leaf").alias("id")).orderBy("id")


def ancestors(scope: DataFrame, node: str) -> DataFrame:
    return closure(scope).filter((F.col("leaf") == node) & (F.col("depth") > 0)).orderBy("depth").select(F.col("anc").alias("id"))


def overlaps(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows whose interval touches the one before it under the same keys; an open end lasts."""
    w = Window.partitionBy(*keys).orderBy(start, F.coalesce(F.col(end), F.lit(2**63 - 1)))
    before = F.max(F.coalesce(F.col(end), F.lit(2**63 - 1))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before_end", before).filter(F.col("before_end") >= F.col(start))


def dangling(rows: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """Rows that name what is not declared; null names nothing."""
    return rows.filter(F.col(column).isNotNull()).join(to.select(F.col("id").alias("declared")), F.col(column) == F.col("declared"), "left_anti")


def problems(t: Topology) -> DataFrame:
    """(check, id) of every breach of the topology's rules."""
    named = lambda df, check, c="id": df.select(F.lit(check).alias("check"), F.col(c).alias("id"))
    links = [("incarnation", "source", "source"), ("binding", "resource", "resource"), ("binding", "generation", "generation"), ("scope", "parent", "scope"), ("resource", "scope", "scope"), ("flow", "scope", "scope"), ("flow", "generation", "generation"), ("path", "scope", "scope"), ("path", "generation", "generation"), ("reservation", "scope", "scope"), ("reservation", "resource", "resource")]
    out = [named(dangling(getattr(t, a), c, getattr(t, b)), f"{a}.{c}", c) for a, c, b in links]
    out += [named(getattr(t, a).groupBy("id").count().filter("count > 1"), f"{a} repeated") for a in SCHEMAS if a != "binding"]
    out.append(named(overlaps(t.incarnation, ["source"], "started_at", "retired_at"), "incarnation overlap"))
    out.append(named(overlaps(t.binding, ["resource", "generation"], "valid_from", "valid_to"), "binding overlap", "resource"))
    members = t.scope.select(F.explode("members").alias("id")).groupBy("id").count().filter("count > 1")
    out.append(named(members, "scope member twice"))
    out.append(named(t.scope.filter("id = parent"), "scope is its own parent"))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result
