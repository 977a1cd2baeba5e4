"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, content_key, durable

#: Weights by the sources' order, repeating; the most copies of a document; documents of a block, and of those kept for a source's last block.
WEIGHTS, MOST, BLOCK, RESERVE, SEED = (5, 2, 1), 3, 256, 128, 17


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.xxhash64("doc_id", content_key(F.col("text"))).alias("h"))


def targets(rows: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: shares of all sizes by weight, none above most times its source's size.

    The fixed point of cutting and resharing: target = min(cap, level * weight), where level is the
    one value at which targets add up to all sizes. One row a source is all that one task sees.
    """
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int")))
    s = durable(s.withColumns({"cap": (F.col("source_size") * most).cast("double"), "ratio": F.col("source_size") * most / F.col("w")}))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = s.select("ratio", ((total - before) / rest).alias("level")).filter("level <= ratio").agg(F.min_by("level", "ratio").alias("level"))
    return s.crossJoin(F.broadcast(level)).select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.lit(0.0))).alias("target"))


def duel(rows: DataFrame, by: list[str], step: int) -> DataFrame:
    """Pivotal rounding within each group, longest rows first: rows whose mass is 0 or all their words, one a group still open.

    Long rows are so decided while there are shorter ones to take up or give their mass, and what
    stays open is a short row.

    The mass of a row is its copy probability times its words. Of two open rows, mass goes to the
    one or the other, with the odds that keep both expectations, until one of them is integral;
    the other goes on. Their sum stays, so a group's words stay. Draws hash the rows' ids, so
    reruns agree. A source's last group (column last) keeps none open: its open row goes to the
    nearer end, and then, longest rows first, a row is taken or left after all wherever that
    brings the words nearer to the target.
    """
    fields = ["size", "h", "mass", "doc_id", "source", "source_size", "target", "whole"]
    group = rows.groupBy(*by).agg(F.first("last").alias("last"), F.sort_array(F.collect_list(F.struct(*fields)), asc=False).alias("a"))
    kind = group.schema["a"].dataType.elementType.simpleString()
    put = lambda x, m: "named_struct(" + ", ".join(f"'{c}', {m if c == 'mass' else f'{x}.{c}'}" for c in fields) + ")"
    end = lambda shut, m, goes, left: f"named_struct('out', concat(v.out, array({put(shut, m)})), 'cur', {put(goes, left)})"
    ma, mx, ca, cx = "v.cur.mass", "x.mass", "cast(v.cur.size as double)", "cast(x.size as double)"
    to_a, to_x = f"least({mx}, {ca} - {ma})", f"least({ma}, {cx} - {mx})"
    u = f"shiftrightunsigned(xxhash64(v.cur.h, x.h, {SEED + step}), 12) / 4503599627370496D"
    gains = f"if({mx} <= {ca} - {ma}, {end('x', '0D', 'v.cur', f'{ma} + {mx}')}, {end('v.cur', ca, 'x', f'{mx} - ({ca} - {ma})')})"
    gives = f"if({ma} <= {cx} - {mx}, {end('v.cur', '0D', 'x', f'{ma} + {mx}')}, {end('x', cx, 'v.cur', f'{ma} - ({cx} - {mx})')})"
    merge = f"if({u} * ({to_a} + {to_x}) < {to_x}, {gains}, {gives})"
    start = f"named_struct('out', cast(array() as array<{kind}>), 'cur', a[0])"
    folded = f"aggregate(slice(a, 2, size(a)), {start}, (v, x) -> {merge}, v -> concat(transform(v.out, y -> named_struct('row', y, 'open', false)), array(named_struct('row', v.cur, 'open', true))))"
    end_of = "if(y.row.mass * 2 > y.row.size, cast(y.row.size as double), 0D)"
    off = f"aggregate(f, 0D, (s, y) -> s + if(y.open, {end_of} - y.row.mass, 0D))"
    shut = f"sort_array(transform(f, y -> {put('y.row', f'if(y.open, {end_of}, y.row.mass)')}), false)"
    turn, turned = "if(x.mass > 0, -x.size, x.size)", put("x", "if(x.mass > 0, 0D, cast(x.size as double))")
    nearer = f"if(abs(v.off + {turn}) < abs(v.off), named_struct('off', v.off + {turn}, 'out', concat(v.out, array({turned}))), named_struct('off', v.off, 'out', concat(v.out, array(x))))"
    settled = f"aggregate({shut}, named_struct('off', {off}, 'out', cast(array() as array<{kind}>)), (v, x) -> {nearer}, v -> transform(v.out, y -> named_struct('row', y, 'open', false)))"
    done = group.select("last", F.expr(folded).alias("f")).select(F.expr(f"if(last, {settled}, f)").alias("f"))
    return done.select(F.explode("f").alias("e")).select("e.row.*", "e.open")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target and taken (words with repeats) of every row.

    Each row is copied floor(f) times, f its source's target over its size, and once more as
    pivotal rounding decides: a source's rows are dealt into blocks of about BLOCK by hash, in each
    block all but one are decided, and those left open meet in blocks again, up to a source's last
    block, which has about RESERVE rows besides that were kept for it, and settles all. A source's taken words so differ from its target by about a short
    row's words at most, unless it has but few or very uneven rows. Rows with null source are a source of their own, null
    and empty texts have size 0 and nothing taken; repeated rows are rounded each; further columns
    are ignored. With no words at all, targets are 0.
    """
    rows = durable(sized(docs))
    goal, _ = bounded(targets(rows, weights, most).withColumnRenamed("source", "src"), 10_000)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("src"))).drop("src").withColumn("f", share)
    rows = rows.withColumn("whole", F.floor(F.col("f") + 1e-12))
    rows = rows.withColumn("mass", F.greatest(F.col("f") - F.col("whole"), F.lit(0.0)) * F.col("size")).drop("f")
    idle = F.col("mass") <= 0
    done, live = [rows.filter(idle)], rows.filter(~idle)
    n = durable(live.groupBy(F.col("source").alias("src")).count())
    n, _ = bounded(n, 10_000)
    spare = F.pmod(F.xxhash64("h", F.lit("spare")), "count") < F.lit(RESERVE)
    live = live.join(n, F.col("source").eqNullSafe(F.col("src"))).withColumn("held", (F.col("count") > BLOCK) & spare).drop("src", "count")
    step = 0
    while live.limit(1).count():  # a source's open rows get fewer by a factor of BLOCK each time
        n, _ = bounded(durable(live.groupBy(F.col("source").alias("src")).agg(F.count_if(~F.col("held")).alias("count"))), 10_000)
        dealt = live.join(n, F.col("source").eqNullSafe(F.col("src"))).withColumn("last", F.col("count") <= BLOCK)
        dealt = dealt.withColumn("blk", F.when(F.col("last"), 0).otherwise(F.pmod(F.xxhash64("h", F.lit(step)), F.ceil(F.col("count") / BLOCK))))
        out = durable(duel(dealt.filter("last or not held"), ["source", "blk"], step))
        done.append(out.filter("not open").drop("open"))
        waiting = dealt.filter("not last and held").drop("src", "count", "last", "blk")
        live = durable(out.filter("open").drop("open").withColumn("held", F.lit(False)).unionByName(waiting))
        step += 1
    cols = ["doc_id", "size", "source_size", "target", "whole", "mass"]
    every = done[0].select(cols)
    for x in done[1:]:
        every = every.unionByName(x.select(cols))
    return every.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("whole") + F.round("mass")).cast("long").alias("taken"))
