"""Rank fusion, exclusion, normalising of recommendations and the covering re-rank of a fused list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fuse(routes: Sequence[DataFrame], weights: Sequence[float], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: query_id, id, score, rank. routes: query_id, id, rank.

    Routes of no weight are left out of the plan. Terms are added in the order of the routes; ties go to the id that
    appears first, by route and then by rank.
    """
    if len(routes) != len(weights):
        raise ValueError("routes and weights must be as many")
    used = [(i, r, w) for i, (r, w) in enumerate(zip(routes, weights, strict=True)) if w > 0]
    if not used:
        return routes[0].select("query_id", "id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    every = None
    for i, route, w in used:
        part = route.select("query_id", "id", F.lit(i).alias("route"), "rank", (F.lit(float(w)) / (k + F.col("rank"))).alias("s"))
        every = part if every is None else every.unionByName(part)
    of_route = [F.max(F.when(F.col("route") == i, F.col("s"))).alias(f"s{i}") for i, _, _ in used]
    one = every.repartition("query_id").groupBy("query_id", "id").agg(*of_route, F.min(F.struct("route", "rank")).alias("seen"))
    total = sum((F.coalesce(f"s{i}", F.lit(0.0)) for i, _, _ in used[1:]), F.coalesce(f"s{used[0][0]}", F.lit(0.0)))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    return one.select("query_id", "id", total.alias("score"), "seen").withColumn("rank", F.row_number().over(by)).drop("seen")


def exclude(ranked: DataFrame, shown: DataFrame) -> DataFrame:
    """ranked without the (query_id, id) that were shown, ranks counted anew."""
    left = ranked.join(shown.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def top(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def normalize(items: DataFrame, catalog_ids: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, rank: the first k known ids of a payload, trimmed, each once. items: query_id, pos, id."""
    known = items.select("query_id", "pos", F.trim("id").alias("id")).where("id <> ''").join(catalog_ids.select("id"), "id", "left_semi")
    first = known.groupBy("query_id", "id").agg(F.min("pos").alias("pos"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "id"))).where(F.col("rank") <= k).drop("pos")


def diversity_weight(turn: Column, schedule: bool | Column) -> Column:
    return F.when(F.lit(schedule) if isinstance(schedule, bool) else schedule, F.greatest(F.lit(0.1), F.least(F.lit(0.6), 0.65 - 0.05 * turn))).otherwise(F.lit(0.35))


def prune_pool(ranked: DataFrame, k: int, group: Sequence[str] = ("query_id",)) -> DataFrame:
    """The rows of a fused list that a covering re-rank can pick, with their ranks in the whole list.

    For one set of values the score falls with the rank, so no more than k of them can be picked, in rank order.
    """
    order = Window.partitionBy(*group, "values").orderBy("rank")
    return ranked.withColumn("__n", F.row_number().over(order)).where((F.col("__n") <= k) | (F.col("rank") == 1)).drop("__n")


def cover(pool: Column, counts: Column, weight: Column, k: int) -> Column:
    """The covering re-rank as an expression over one list: an array of ids.

    pool: array of (rank, id, values) in rank order, possibly pruned; counts: map of rejected values; weight: that of
    novelty. The first stays; then, again and again, the best of 1/place * (1 - w) + w * new values - 0.3 * rejected
    share, where place counts what remains before it. Equal scores go to the earlier place.
    """
    most = F.greatest(F.coalesce(F.array_max(F.map_values(counts)), F.lit(0)), F.lit(1)).cast("double")
    first = F.get(pool, F.lit(0))

    def penalty(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(F.try_element_at(counts, v), F.lit(0)).cast("double")) / most

    rest = F.transform(F.slice(pool, 2, F.greatest(F.size(pool) - 1, F.lit(0))), lambda x: F.struct(x.rank.cast("long").alias("rank"), x.id.alias("id"), x.values.alias("values"), penalty(x.values).alias("p")))
    start = F.struct(rest.alias("left"), F.array(first.id).alias("ids"), first.values.alias("seen"), F.array(first.rank.cast("long")).alias("ranks"))

    def step(state: Column, _: Column) -> Column:
        def valued(x: Column) -> Column:
            place = x.rank - F.size(F.filter(state.ranks, lambda r: r < x.rank))
            value = (F.lit(1.0) / place) * (1 - weight) + weight * F.size(F.array_except(x["values"], state.seen)) - 0.3 * x.p
            return F.struct(value.alias("s"), (-x.rank).alias("minus"), x.id.alias("id"), x["values"].alias("values"))

        def picked(best: Column) -> Column:
            return F.struct(
                F.filter(state.left, lambda x: x.rank != -best.minus).alias("left"),
                F.concat(state.ids, F.array(best.id)).alias("ids"),
                F.array_union(state.seen, best["values"]).alias("seen"),
                F.concat(state.ranks, F.array(-best.minus)).alias("ranks"),
            )

        # best is the variable of a lambda, so that it is worked out once and not wherever it is named
        best = F.array(F.array_max(F.transform(state.left, valued)))
        return F.when(F.size(state.left) > 0, F.get(F.transform(best, picked), F.lit(0))).otherwise(state)

    steps = F.sequence(F.lit(2), F.lit(k)) if k >= 2 else F.array().cast("array<int>")
    return F.when(F.size(pool) > 0, F.aggregate(steps, start, step, lambda s: s.ids)).otherwise(F.array().cast("array<string>"))


def repair(raw: Column, ids: Column) -> Column:
    """A re-ranker's answer made whole: known ids in its order (repeats kept), then the missing in their own order."""
    return F.concat(F.filter(raw, lambda x: F.array_contains(ids, x)), F.array_except(ids, raw))


def rerank(requests: DataFrame, memo: DataFrame, scorer=None) -> DataFrame:
    """requests (key, ids) with ranked (null: keep your order), prompt_tokens and completion_tokens.

    memo: key, ranked, prompt_tokens, completion_tokens. A scorer maps a DataFrame of (key, ids) to memo rows for the
    keys it can answer; without one, or where it has no answer, the result is null and costs nothing.
    """
    found = requests.join(memo, "key", "left")
    if scorer is not None:
        asked = requests.where(F.size("ids") > 0).join(memo, "key", "left_anti")
        answers = asked.select("key", "ids").join(scorer(asked), "key").select("key", repair(F.col("ranked"), F.col("ids")).alias("ranked"), "prompt_tokens", "completion_tokens")
        found = requests.join(memo.unionByName(answers), "key", "left")
    empty = F.size("ids") == 0
    zero = lambda c: F.when(empty, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return found.select("key", "ids", F.when(~empty, F.col("ranked")).alias("ranked"), zero("prompt_tokens"), zero("completion_tokens"))
