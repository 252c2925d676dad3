"""Session state as windows over a table of messages, and the choice of the next question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V

SLOT_OF = {"material": X.material, "color": X.color, "size": X.size, "budget": X.budget}


def _so_far(session: str, turn: str, last: int = Window.currentRow):
    return Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, last)


def build_query(messages: Column, tags: Column | None = None) -> Column:
    """latest latest earlier tags; no messages give an empty query."""
    n = F.size(messages)
    latest = F.get(messages, n - 1)
    earlier = F.array_join(F.slice(messages, 1, F.greatest(n - 1, F.lit(0))), " ")
    told = F.array_join(tags, " ") if tags is not None else F.lit(None).cast("string")
    query = F.trim(F.concat_ws(" ", *(F.nullif(x, F.lit("")) for x in (latest, latest, earlier, told))))
    return F.when(n > 0, query).otherwise("")


def dialog_queries(turns: DataFrame, session: str = "session_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """session, turn, query after each turn. Empty messages are not kept."""
    said = F.collect_list(F.when(F.col(text) != "", F.col(text))).over(_so_far(session, turn))
    return turns.select(session, turn, build_query(said).alias("query"))


def slot_turns(turns: DataFrame, session: str = "session_id", turn: str = "turn", text: str = "text", strict_size: bool = False) -> DataFrame:
    """session, turn, the slots after each turn and overridden: the attributes that this turn contradicts."""
    new = {a: f(F.col(text), strict_size) if a == "size" else f(F.col(text)) for a, f in SLOT_OF.items()}
    each = turns.select(session, turn, *(c.alias(f"new_{a}") for a, c in new.items()))
    held = [F.last(f"new_{a}", ignorenulls=True).over(_so_far(session, turn)).alias(a) for a in V.SLOTS]
    before = [F.last(f"new_{a}", ignorenulls=True).over(_so_far(session, turn, -1)).alias(f"old_{a}") for a in V.SLOTS]
    both = each.select("*", *held, *before)
    gone = F.array_compact(F.array(*(F.when(F.col(f"old_{a}") != F.col(f"new_{a}"), F.lit(a)) for a in V.SLOTS)))
    return both.select(session, turn, *V.SLOTS, gone.alias("overridden"))


def query_terms(turns: DataFrame, session: str = "session_id", turn: str = "turn", text: str = "text", strict_size: bool = False) -> DataFrame:
    """session, turn, terms: the slots' values as words after each turn, in the order in which they were first filled."""
    each = turns.select(session, turn, *((f(F.col(text), strict_size) if a == "size" else f(F.col(text))).alias(f"new_{a}") for a, f in SLOT_OF.items()))
    so_far = _so_far(session, turn)
    held = [
        F.struct(F.min(F.when(F.col(f"new_{a}").isNotNull(), F.col(turn))).over(so_far).alias("first"), F.lit(i).alias("place"), F.last(f"new_{a}", ignorenulls=True).over(so_far).cast("string").alias("value"))
        for i, a in enumerate(V.SLOTS)
    ]
    filled = F.array_sort(F.filter(F.array(*held), lambda x: x.value.isNotNull()))
    return each.select(session, turn, F.transform(filled, lambda x: x.value).alias("terms"))


def rejection_counts(shown: DataFrame, products: DataFrame, session: str = "session_id") -> DataFrame:
    """session, value, n: how often shown items had each value. shown: session, id; products: id, values."""
    return shown.join(products.select("id", F.explode("values").alias("value")), "id").groupBy(session, "value").agg(F.count("*").alias("n"))


def shown_after(batches: DataFrame, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """session, id still shown after the last override. batches: session, turn, id, override (of that turn).

    An override clears what was shown in earlier turns; what its own turn shows stays.
    """
    last = F.max(F.when(F.col("override"), F.col(turn))).over(Window.partitionBy(session))
    kept = batches.withColumn("__from", last).where(F.col("__from").isNull() | (F.col(turn) >= F.col("__from")))
    return kept.select(session, "id").distinct()


def entropy(pool: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """group, attribute, entropy (base 2) of the non-null values of each attribute; fewer than two give 0.

    All attributes go through one aggregation by (group, attribute, value).
    """
    long = pool.select(*group, F.explode(F.array(*(F.struct(F.lit(i).alias("order"), F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for i, a in enumerate(values)))).alias("x")).select(*group, "x.*")
    counts = long.groupBy(*group, "order", "attribute", "value").agg(F.count("value").alias("c"))
    totals = counts.groupBy(*group, "order", "attribute").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("c") > 0, F.col("c") * F.log2("c"))).alias("s"))
    return totals.select(*group, "order", "attribute", F.when(F.col("n") > 1, F.log2("n") - F.col("s") / F.col("n")).otherwise(0.0).alias("entropy"))


def _fallback(filled: Column, order: Sequence[str]) -> Column:
    return F.get(F.array_except(F.array(*map(F.lit, order)), filled), 0)


def choose_attribute(pool: DataFrame, filled: DataFrame, session: str = "session_id", top: int = 50) -> DataFrame:
    """session, attribute: the unfilled slot of most entropy in the pool's first rows, or else one of the fallbacks.

    pool: session, rank, material, color, size, budget (its bucket); filled: session, filled (array). Entropies are
    compared at twelve places, so that equal ones do not depend on the order of sums; earlier slots win ties.
    """
    found = entropy(pool.where(F.col("rank") <= top), [session], V.SLOTS)
    best = found.join(filled, session).where(~F.array_contains("filled", F.col("attribute"))).groupBy(session).agg(F.max(F.struct(F.round("entropy", 12).alias("e"), (-F.col("order")).alias("o"), "attribute")).alias("b"))
    return filled.join(best, session, "left").select(session, F.when(F.col("b.e") > 0.1, F.col("b.attribute")).otherwise(_fallback(F.col("filled"), V.FALLBACK)).alias("attribute"))


def fixed_question(filled: Column) -> Column:
    return _fallback(filled, V.FIXED_ORDER)


def question_text(attribute: Column) -> Column:
    return F.when(attribute.isNotNull(), F.format_string("Do you have a %s preference?", attribute)).otherwise("Here are some options based on what you've told me so far.")


def unfilled(filled: Column, attributes: Sequence[str] = V.ATTRIBUTES) -> Column:
    return F.array_except(F.array(*map(F.lit, attributes)), F.concat(filled, F.array(*map(F.lit, V.NEVER_ASKED))))
