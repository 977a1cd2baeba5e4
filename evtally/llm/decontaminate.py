"""Benchmark decontamination: a distributed positional inverted index of the training words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, bounded, content_key, durable, tokens

#: Rows that a join may broadcast once they are counted, and lists intersected before the exact check.
SMALL, LISTS = 50_000, 3
#: Places of items' rarest words that a join may broadcast once they are counted.
PLACES = 200_000


def windows(items: DataFrame, size: int) -> DataFrame:
    """(item, w): the distinct windows of each item as blank-joined words; null ids and texts have none."""
    words = items.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item"), tokens(F.col("text"), NOT_WORD).alias("words"))
    cut = F.expr(f"CASE WHEN size(words) < {size} THEN array(words) ELSE transform(sequence(1, size(words) - {size - 1}), i -> slice(words, i, {size})) END")
    return words.filter("size(words) > 0").select("item", F.explode(cut).alias("x")).select("item", F.array_join("x", " ").alias("w")).distinct()


def tokenized(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text) and words of every row, written once for all that reads them."""
    return durable(docs.select("doc_id", content_key(F.col("text")).alias("key"), tokens(F.col("text"), NOT_WORD).alias("words")))


def postings(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(h, k, pos) of the wanted terms in all texts: hashes of term and key, and the position."""
    found = rows.select("key", F.posexplode("words").alias("pos", "term")).join(bounded(terms, SMALL)[0], "term", "left_semi")
    return found.select(F.xxhash64("term").alias("h"), F.xxhash64("key").alias("k"), "pos")


def frequencies(rows: DataFrame, wins: DataFrame) -> DataFrame:
    """(term, n): how often all documents hold each word of the windows, if at all."""
    vocabulary, _ = bounded(wins.select(F.explode(F.split("w", " ")).alias("term")).distinct(), SMALL)
    words = rows.select(F.explode("words").alias("term"))
    return durable(words.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")))


def rarest(counts: DataFrame, wins: DataFrame, lists: int) -> DataFrame:
    """(w, at): the lists rarest words of each window as (term, offset), rarest first.

    A window with a word that no document has is gone.
    """
    spread = wins.select("w").distinct().select("w", F.posexplode(F.split("w", " ")).alias("o", "term"))
    known = spread.join(counts, "term", "left").groupBy("w").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "o", "term"))).alias("a"))
    return known.filter(F.get("a", F.lit(0))["n"] > 0).select("w", F.slice("a", 1, lists).alias("at"))


def listed(*rare: DataFrame) -> DataFrame:
    """The terms of all lists, each once."""
    terms = [r.select(F.explode("at.term").alias("term")) for r in rare]
    return reduce(DataFrame.unionByName, terms).distinct()


def candidates(rare: DataFrame, index: DataFrame) -> DataFrame:
    """(k, w, start): places where the rarest words of a window stand at their offsets.

    Rows carry hashes alone, of text, window and word; whoever asks compares the words.
    """

    def nth(i):  # windows of fewer words have fewer lists: they meet their first again
        x = F.coalesce(F.get("at", F.lit(i)), F.get("at", F.lit(0)))
        return bounded(rare.select("wid", F.xxhash64(x["term"]).alias("h"), x["o"].alias("o")), SMALL)[0]

    found = index.join(nth(0), "h").select("k", "wid", (F.col("pos") - F.col("o")).alias("start")).filter("start >= 0")
    for i in range(1, LISTS):
        more = found.join(nth(i), "wid").select("k", "h", (F.col("start") + F.col("o")).alias("pos"), "wid", "start")
        found = more.join(index, ["k", "h", "pos"], "left_semi").select("k", "wid", "start")
    return found.distinct().join(bounded(rare.select("wid", "w"), SMALL)[0], "wid").select("k", "w", "start")


def whole_items(items: DataFrame, slop: int) -> DataFrame:
    """(item, w, span): each item's distinct words, and in how many words of a text they all must stand."""
    words = tokens(F.col("text"), NOT_WORD)
    found = items.filter("item_id is not null").select(F.col("item_id").alias("item"), words.alias("words")).filter("size(words) > 0")
    return found.select("item", F.array_join(F.array_distinct("words"), " ").alias("w"), (F.size("words") + slop).alias("span"))


def nearby(rare: DataFrame, whole: DataFrame, index: DataFrame) -> DataFrame:
    """(k, w, span, mid): places of an item's rarest word with its next rarest ones within the span.

    Positions are compared in buckets of a span, so no list is paired with all of another, and few
    rows meet the index; whoever asks compares the other words.
    """
    known = rare.join(whole.select("w", "span").distinct(), "w").withColumn("wid", F.xxhash64("w", "span"))

    def nth(i):  # items of fewer words meet their first again
        x = F.coalesce(F.get("at", F.lit(i)), F.get("at", F.lit(0)))
        return bounded(known.select("wid", "span", F.xxhash64(x["term"]).alias("h")), SMALL)[0]

    widest = whole.agg(F.coalesce(F.max("span"), F.lit(1))).head()[0]
    found = index.join(nth(0), "h").select("k", "wid", F.col("pos").alias("mid"))
    bins = index.select("k", "h", "pos", F.floor(F.col("pos") / widest).alias("bin"))
    for i in range(1, LISTS):
        about = F.explode(F.array(*[F.floor(F.col("mid") / widest) + j for j in (-1, 0, 1)]))
        more = durable(found.join(nth(i), "wid").select("k", "h", "wid", "mid", "span", about.alias("bin")))
        found = bins.join(bounded(more, PLACES)[0], ["k", "h", "bin"]).filter(F.abs(F.col("mid") - F.col("pos")) < F.col("span")).select("k", "wid", "mid").distinct()
    return found.join(bounded(known.select("wid", "w", "span"), SMALL)[0], "wid").select("k", "w", "span", "mid")


def gathered(near: DataFrame) -> DataFrame:
    """(k, p): the places of each text, with the words that must stand about them."""
    return near.groupBy("k").agg(F.collect_set(F.struct("mid", "span", F.split("w", " ").alias("terms"))).alias("p"))


def about() -> Column:
    """Those of the places p about which a stretch of span words holds every word of the item; null if there are none.

    Such a stretch holds the rarest word, so it starts less than a span before a place of that word.
    """
    first = "greatest(0, x.mid - x.span + 1)"
    left = lambda at, n: f"size(array_except(x.terms, slice(words, {at} + 1, {n}))) = 0"
    return F.expr(f"filter(p, x -> CASE WHEN {left(first, f'x.mid - {first} + x.span')} THEN exists(sequence({first}, x.mid), s -> {left('s', 'x.span')}) ELSE false END)")


def held(found: DataFrame, whole: DataFrame, on: list[str]) -> DataFrame:
    """(key, ids): the items of the texts' windows (or spans), sorted, each once."""
    return found.join(bounded(whole, SMALL)[0], on).select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("ids"))


def checked(rows: DataFrame, places: DataFrame, columns: list[Column]) -> DataFrame:
    """key and the columns, from the words and the places (k, c, p) of each distinct text that has any.

    Only texts with places are shuffled, each distinct one once, whatever the number of its copies.
    """
    places = durable(places)
    few, _ = bounded(places.select("k"), PLACES)
    met = rows.withColumn("k", F.xxhash64("key")).join(few, "k", "left_semi")
    one = met.groupBy("key").agg(F.first("k").alias("k"), F.first("words").alias("words"))
    return one.join(bounded(places, PLACES)[0], "k").select("key", *columns)


def contaminated(docs: DataFrame, items: DataFrame, size: int = 10, slop: int | None = None) -> DataFrame:
    """doc_id, key (the text's content key), n_words, n_hit, n_items, items_sha256, contaminated of every row.

    A document word in any exact occurrence of an item's window of size words is hit. With slop,
    n_near and near_sha256 tell the items that proximity() finds, too. Null texts have no words,
    items without words or id none to find; an item of fewer words is one window. Repeated rows and
    null document ids keep a row each; further columns are ignored. Words leave their rows only
    for texts in which the lists meet; an item's or a passage's frequency only adds rows for the
    documents that hold it.
    """
    wins = durable(windows(items, size))
    rows = tokenized(docs)
    counts = frequencies(rows, wins)
    lists = [durable(rarest(counts, wins, LISTS).withColumn("wid", F.xxhash64("w")))]
    if slop is not None:
        whole = durable(whole_items(items, slop).withColumn("item", F.col("item").cast("string")))
        lists.append(durable(rarest(counts, whole, LISTS)))
    index = durable(postings(rows, listed(*lists)))
    places = candidates(lists[0], index).groupBy("k").agg(F.collect_set(F.struct("start", "w")).alias("c"))
    if slop is not None:
        places = places.join(gathered(nearby(lists[1], whole, index)), "k", "full")
    exact = F.expr("filter(c, x -> array_join(slice(words, x.start + 1, size(split(x.w, ' '))), ' ') = x.w)")
    found = checked(rows, places, [exact.alias("c"), *([] if slop is None else [about().alias("p")])])
    hit = F.expr("size(array_distinct(flatten(transform(c, x -> sequence(x.start, x.start + size(split(x.w, ' ')) - 1)))))")
    near = [] if slop is None else [F.expr("array_distinct(transform(p, x -> struct(array_join(x.terms, ' ') AS w, x.span AS span)))").alias("ps")]
    found = durable(found.select("key", F.when(F.size("c") > 0, hit).otherwise(0).cast("long").alias("n_hit"), F.when(F.size("c") > 0, F.array_distinct(F.col("c.w"))).alias("ws"), *near))
    told = lambda ids, n, sha: [F.size(ids).cast("long").alias(n), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias(sha)]
    facts = found.filter("n_hit > 0").select("key", "n_hit")
    facts = facts.join(held(found.filter("n_hit > 0").select("key", F.explode("ws").alias("w")), wins, ["w"]), "key")
    facts = facts.select("key", "n_hit", *told("ids", "n_items", "items_sha256"))
    if slop is not None:
        own = held(found.filter("size(ps) > 0").select("key", F.inline("ps")), whole, ["w", "span"])
        facts = facts.join(own.select("key", *told("ids", "n_near", "near_sha256")), "key", "full")
    facts, _ = bounded(durable(facts.withColumnRenamed("key", "of")), PLACES)
    out = rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words")).join(facts, F.col("key") == F.col("of"), "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    columns = ["doc_id", "key", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", empty).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")]
    return out.select(*columns, *([] if slop is None else [zero("n_near"), F.coalesce("near_sha256", empty).alias("near_sha256")]))


def proximity(docs: DataFrame, items: DataFrame, slop: int = 20) -> DataFrame:
    """doc_id, item_id where all of an item's words stand, in any order, in a stretch of slop words more than it has.

    Items without words match nothing; null texts have no words.
    """
    whole = durable(whole_items(items, slop))
    rows = tokenized(docs)
    rare = durable(rarest(frequencies(rows, whole), whole, LISTS))
    near = gathered(nearby(rare, whole, durable(postings(rows, listed(rare)))))
    found = checked(rows, near, [about().alias("p")]).select("key", F.explode("p").alias("x"))
    found = found.select("key", F.array_join("x.terms", " ").alias("w"), F.col("x.span").alias("span")).distinct()
    found = rows.select("doc_id", "key").join(bounded(durable(found), PLACES)[0], "key").drop("key").distinct()
    return found.join(bounded(whole, SMALL)[0], ["w", "span"]).select("doc_id", F.col("item").alias("item_id")).distinct()
