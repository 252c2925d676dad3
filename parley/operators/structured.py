"""Soft-constraint ranking: materials, colours, a budget and the store name score products; nothing is excluded.

A product's score depends on which words of the vocabulary its text has, its store and its price alone. Products are
therefore in four sorted lists: by the words that they have, by words and store, by store, and all together. A list is
cut by price into a tree of nodes, each with its first k products by place and its first k by price, so the products
within a budget, those above it and those without a price are a few dozen nodes of the list, in the order in which
they score.

A query meets the lists of its words and stores by equal keys. For each node its least and greatest score are known
beforehand; the nodes are taken in order of the least until they hold k products, and nodes whose greatest score is
below that are not read. What is read is scored exactly. Queries with the same constraints share one scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..sources.staging import bounded, written
from .names import names_in

#: Prices in hundredths have DIGITS digits of BASE; what is above shares the last leaf.
BASE, DIGITS = 16, 6
LAST = BASE**DIGITS - 1
#: Levels of the nodes that hold products without a price, and all of a list.
UNPRICED, ALL = -1, DIGITS + 1


def constraints(text: Column) -> Column:
    return F.struct(X.all_in_order(text, V.MATERIALS).alias("materials"), X.all_in_order(text, V.COLORS).alias("colors"), X.budget(text).alias("budget"), F.lower(text).alias("low"))


def has_any(c: Column) -> Column:
    return (F.size(c.materials) > 0) | (F.size(c.colors) > 0) | c.budget.isNotNull()


def budget_score(price: Column, budget: Column) -> Column:
    """+0.5 within the budget, down to -0.5 as the price goes over it; 0 without either. A budget of 0 has no measure."""
    over = F.least(F.try_divide(price - budget, budget), F.lit(1.0))
    return F.when(price <= budget, 0.5).when(price > budget, -0.5 * over).otherwise(0.0)


def score(text: Column, store: Column, price: Column, c: Column) -> Column:
    hits = F.size(F.filter(F.concat(c.materials, c.colors), lambda t: F.contains(text, t)))
    return hits.cast("double") + budget_score(price, c.budget) + F.when((store != "") & F.contains(c.low, store), 1.0).otherwise(0.0)


def marked(products: DataFrame) -> DataFrame:
    """id, ord, marks (the words of the vocabulary in its text), store_text, price and the place of the price among the leaves."""
    marks = F.array_compact(F.array(*(F.when(F.contains("match_text", F.lit(t)), F.lit(t)) for t in dict.fromkeys((*V.MATERIALS, *V.COLORS)))))
    return products.select("id", "ord", marks.alias("marks"), "store_text", "price", leaf(F.col("price")).alias("leaf"))


def leaf(price: Column) -> Column:
    return F.when(price * 100 >= LAST, F.lit(LAST)).when(price > 0, F.floor(price * 100)).when(price.isNotNull(), F.lit(0)).cast("long")


def nodes_of(leaf_: Column) -> Column:
    """The nodes (level, node) that hold a product: one of each level above its leaf, or the unpriced one; and that of all."""
    at = lambda level, node: F.struct(F.lit(level).alias("level"), node.cast("long").alias("node"))
    levels = [at(i, F.shiftright(leaf_.cast("long"), 4 * i)) for i in range(DIGITS + 1)]
    return F.when(leaf_.isNull(), F.array(at(UNPRICED, F.lit(0)), at(ALL, F.lit(0)))).otherwise(F.array(*levels, at(ALL, F.lit(0))))


def segments(budget: Column, c: Column) -> Column:
    """The ranges of a list whose products score c but for the budget: (kind of order, level, low, high, least, most).

    A range is of leaves, high left out, if level is null, and else a node of that level.
    """
    here, twice = leaf(budget), leaf(2 * budget)

    def one(kind: str, low: Column, high: Column, least: Column, most: Column, level: int | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(level).cast("int").alias("level"), low.cast("long").alias("low"), high.cast("long").alias("high"), least.alias("least"), most.alias("most"))

    zero, end = F.lit(0), F.lit(LAST + 1)
    within, leaf_of_budget = one("place", zero, here, c + 0.5, c + 0.5), one("leaf", here, here + 1, c - 0.5, c + 0.5)
    over, leaf_of_twice = one("price", here + 1, twice, c - 0.5, c), one("leaf", F.greatest(twice, here + 1), twice + 1, c - 0.5, c)
    far, unpriced = one("place", twice + 1, end, c - 0.5, c - 0.5), one("place", zero, zero, c, c, UNPRICED)
    return F.when(budget.isNull(), F.array(one("place", zero, zero, c, c, ALL))).otherwise(F.array(within, leaf_of_budget, over, leaf_of_twice, far, unpriced))


def nodes_in(ranges: DataFrame) -> DataFrame:
    """ranges (level, low, high) as the fewest nodes that together hold their leaves: level, node in place of these."""
    c = F.col
    levels = F.when(c("level").isNull(), F.sequence(F.lit(0), F.lit(DIGITS))).otherwise(F.array("level"))
    each = ranges.withColumn("ranged", c("level").isNull()).withColumn("level", F.explode(levels))
    size = F.expr("shiftleft(1L, 4 * greatest(level, 0))")
    each = each.withColumn("a", F.floor((c("low") + size - 1) / size)).withColumn("b", F.floor(c("high") / size))
    each = each.withColumn("up", F.ceil(c("a") / BASE) * BASE).withColumn("down", F.floor(c("b") / BASE) * BASE)
    whole = (c("up") < c("down")) & (c("level") < DIGITS)
    run = lambda low, high: F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
    nodes = F.concat(run(c("a"), F.when(whole, c("up")).otherwise(c("b"))), F.when(whole, run(c("down"), c("b"))).otherwise(F.array().cast("array<bigint>")))
    told = F.when(c("ranged"), nodes).otherwise(F.array(F.lit(0).cast("long")))
    return each.withColumn("node", F.explode(told)).drop("ranged", "a", "b", "up", "down", "low", "high")


LIST = ["words", "store", "kind", "level", "node"]


@dataclass(frozen=True)
class Shelf:
    """What searches to the k-th place need of products, whatever is asked, written down.

    rows: of those with the same words, store and price the first k; words: word, words of each list that has it;
    stores; priced: whether any has a price above 0.
    """

    rows: DataFrame
    words: DataFrame
    stores: DataFrame
    priced: bool
    k: int


def shelf(products: DataFrame, k: int) -> Shelf:
    alike = Window.partitionBy("marks", "store_text", "price").orderBy("ord")
    rows = written(marked(products).withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k).drop("n"), "marked")
    words = rows.select("marks").distinct().select(F.concat(F.lit("="), F.array_join("marks", "|")).alias("words"), F.explode("marks").alias("word"))
    stores = rows.select("store_text").distinct().where("store_text <> ''")
    return Shelf(rows, written(words, "words"), written(stores, "stores"), rows.where("price > 0").limit(1).count() > 0, k)


def lists(first: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The first k products of each asked node of each list. first: rows of a shelf; asked: LIST, distinct and written down."""
    any_ = F.lit("*")
    words, store = F.concat(F.lit("="), F.array_join("marks", "|")), F.concat(F.lit("="), "store_text")
    keys = F.array(*(F.struct(w.alias("words"), s.alias("store")) for w, s in ((words, any_), (words, store), (any_, store), (any_, any_))))
    wanted = bounded(written(asked.select("words", "store").distinct(), "lists"), 100)
    dealt = first.select("*", F.explode(keys).alias("key")).select("*", "key.*").drop("key").join(wanted, ["words", "store"], "left_semi")
    placed = dealt.select("*", F.explode(nodes_of(F.col("leaf"))).alias("at")).select("*", "at.*").drop("at")
    asked = bounded(asked, 120)
    found = None
    for kind, order in (("place", ["ord"]), ("price", ["price", "ord"]), ("leaf", ["ord"])):
        own = placed.withColumn("kind", F.lit(kind)).join(asked, LIST, "left_semi")
        by = Window.partitionBy(*LIST, *(["price"] if kind == "leaf" else [])).orderBy(*order)
        top = own.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k).drop("n")
        found = top if found is None else found.unionByName(top)
    return written(found.select(*LIST, "id", "ord", "marks", "store_text", "price"), "listed")


def bars(counted: DataFrame, k: int) -> DataFrame:
    """key, bar: a score that k products of a query reach. counted: key, store, least, n, of lists that share no product.

    The lists by words share none, nor do those by words and store; either may give the higher bar.
    """
    kind = (F.col("store") == "*").alias("kind")
    each = counted.select("key", kind, "least", "n").groupBy("key", "kind", "least").agg(F.sum("n").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("key", "kind").orderBy(F.desc("least")))
    return each.withColumn("so_far", so_far).where(F.col("so_far") >= k).groupBy("key").agg(F.max("least").alias("bar"))


def search(products: DataFrame, queries: DataFrame, k: int, made: Shelf | None = None) -> DataFrame:
    """query_id, id, score, rank. products: id, ord, match_text, store_text, price; queries: query_id, text.

    made: the shelf of the products to k, if there is one from an earlier search.

    A query without material, colour and budget has no rows. Ties go by ord. A budget of 0 against a priced product
    has no answer: such a query has no rows either.
    """
    c = F.col
    asked = queries.select("query_id", constraints(c("text")).alias("c")).where(has_any(c("c"))).select("query_id", "c.*")
    made = made if made is not None and made.k == k else shelf(products, k)
    named = names_in(asked, made.stores).groupBy("query_id").agg(F.array_sort(F.collect_set("store_text")).alias("stores"))
    keyed = asked.drop("low").join(named, "query_id", "left").withColumn("stores", F.coalesce("stores", F.array().cast("array<string>")))
    priced = F.lit(made.priced)
    keyed = keyed.where(~(F.coalesce(c("budget") == 0, F.lit(False)) & priced)).withColumn("key", F.sha2(F.to_json(F.struct("materials", "colors", "budget", "stores")), 256))
    keyed = written(keyed, "constraints")
    sets = keyed.select("key", F.concat("materials", "colors").alias("asked_words"), "budget", "stores").distinct()
    by_words = sets.select("key", F.explode("asked_words").alias("word")).join(made.words, "word").groupBy("key", "words").agg(F.count("*").cast("double").alias("c"))
    every = by_words.unionByName(sets.select("key", F.lit("*").alias("words"), F.lit(0.0).alias("c")))
    told = every.join(sets.select("key", "budget", "stores"), "key")
    any_store = F.array(F.struct(F.lit("*").alias("store"), c("c").alias("c")))
    each = told.select("key", "words", "budget", F.explode(F.concat(any_store, F.transform("stores", lambda s: F.struct(F.concat(F.lit("="), s).alias("store"), (c("c") + 1).alias("c"))))).alias("l"))
    ranges = each.select("key", "words", "l.store", F.explode(segments(c("budget"), c("l.c"))).alias("s")).select("key", "words", "store", "s.*").where("most > 0")
    parts = written(nodes_in(ranges), "segments")
    listed = lists(made.rows, written(parts.select(*LIST).distinct(), "nodes"), k)
    counts = listed.groupBy(*LIST).agg(F.count("*").alias("n"))
    met = parts.join(counts, LIST)
    bar = bars(met.where("words <> '*' and least > 0"), k)
    read = met.join(bar, "key", "left").where(c("bar").isNull() | (c("most") >= c("bar"))).select("key", *LIST)
    value = F.size(F.array_intersect("asked_words", "marks")).cast("double") + budget_score(c("price"), c("budget")) + F.when(F.array_contains("stores", c("store_text")), 1.0).otherwise(0.0)
    scored = read.join(listed, LIST).select("key", "id", "ord", "marks", "store_text", "price").distinct().join(sets, "key").select("key", "id", "ord", value.alias("score")).where("score > 0")
    by = Window.partitionBy("key").orderBy(F.desc("score"), "ord")
    top = scored.withColumn("rank", F.row_number().over(by)).where(c("rank") <= k)
    return keyed.select("query_id", "key").join(top, "key").select("query_id", "id", "score", "rank")
