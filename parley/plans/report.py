"""Reports: table rows of a metric record and a dump of missed sessions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V


def format_row(name: str, record: Mapping) -> str:
    shown = [f"{record[k]:.4f}" for k in ("hit_rate_at_10", "mrr", "mttc", "efficiency", "recommended_technical_score")]
    return f"| {' | '.join([name, *shown, str(record['sample_count'])])} |"


def format_scenario_row(name: str, scenarios: Mapping[str, Mapping]) -> str:
    shown = [f"{scenarios[s]['hit_rate_at_10']:.4f}" if scenarios.get(s) else "-" for s in V.SCENARIOS]
    return f"| {' | '.join([name, *shown])} |"


def product_line(title: Column, price_text: Column, categories: Column, features: Column) -> Column:
    cut = F.when(F.size(categories) > 2, F.slice(categories, -2, 2)).otherwise(categories)
    tail = F.coalesce(F.nullif(F.array_join(cut, " > "), F.lit("")), F.lit("-"))
    head = F.coalesce(F.nullif(F.array_join(F.slice(features, 1, 2), "; "), F.lit("")), F.lit("-"))
    return F.concat(F.lit("**"), F.coalesce(title, F.lit("None")), F.lit("** ($"), F.coalesce(price_text, F.lit("None")), F.lit(") ["), tail, F.lit("] -- "), head)


def turn_line(turn: Column, asked: Column, said: Column, user: Column, shown: Column) -> Column:
    clip = lambda x: F.replace(F.left(x, F.lit(80)), F.lit("\n"), F.lit(" "))
    top = F.coalesce(F.nullif(F.array_join(F.slice(shown, 1, 5), ", "), F.lit("")), F.lit("-"))
    return F.concat(F.lit("  - turn "), turn.cast("string"), F.lit(": asked=`"), F.coalesce(asked, F.lit("-")), F.lit('` said="'), clip(said), F.lit('" user="'), clip(user), F.lit('" top5=['), top, F.lit("]"))


def failures(results: DataFrame, transcript: DataFrame, catalog: DataFrame) -> DataFrame:
    """sample_id and block (markdown) of each session that missed."""
    c = F.col
    lines = transcript.groupBy(c("session_id").alias("sample_id")).agg(F.array_sort(F.collect_list(F.struct("turn", turn_line(c("turn"), c("ask_attribute"), c("message"), c("user_message"), c("recommendations_shown")).alias("line")))).alias("t"))
    facts = catalog.select(c("parent_asin").alias("target"), product_line(c("title"), c("price_text"), c("categories"), c("features")).alias("line"))
    missed = results.where("not hit").join(lines, "sample_id").join(facts, "target", "left")
    head = F.concat(F.lit("## "), "sample_id", F.lit(" ("), "scenario_type", F.lit(") -- target `"), "target", F.lit("`\n- target: "), F.coalesce("line", F.lit("*(target parent_asin not found in catalog)*")), F.lit("\n"))
    return missed.select("sample_id", F.concat(head, F.array_join(F.transform("t", lambda x: x.line), "\n"), F.lit("\n")).alias("block"))
