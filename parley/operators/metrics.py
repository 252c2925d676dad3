"""Aggregates of session results, unrounded; metric_record() rounds on the driver, as scores are made of rounded parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V


def _summary() -> list[Column]:
    """Sessions: hit (boolean), reciprocal_rank, first_hit_turn (null: missed, which counts as one turn too many)."""
    return [F.count("*").alias("sample_count"), F.avg(F.col("hit").cast("double")).alias("hit_rate_at_10"), F.avg("reciprocal_rank").alias("mrr"), F.avg(F.coalesce("first_hit_turn", F.lit(V.MAX_TURNS + 1)).cast("double")).alias("mttc")]


def metric_summary(sessions: DataFrame) -> DataFrame:
    """One row; of no sessions the rates are 0 and mttc is null."""
    return sessions.agg(*_summary()).select("sample_count", F.coalesce("hit_rate_at_10", F.lit(0.0)).alias("hit_rate_at_10"), F.coalesce("mrr", F.lit(0.0)).alias("mrr"), "mttc")


def scenario_metrics(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("scenario_type").agg(*_summary())


def grouping_sets(sessions: DataFrame) -> DataFrame:
    """All sessions (scenario null) and each scenario, in one pass."""
    return sessions.rollup("scenario_type").agg(*_summary())


def with_scores(metrics: DataFrame) -> DataFrame:
    efficiency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (11.0 - F.col("mttc")) / 10.0))
    return metrics.withColumn("efficiency", efficiency).withColumn("technical_score", 0.5 * F.col("hit_rate_at_10") + 0.3 * F.col("mrr") + 0.2 * F.col("efficiency"))


def token_usage(responses: DataFrame) -> DataFrame:
    """Sums of counts that are not negative."""
    part = lambda c: F.coalesce(F.sum(F.when(F.col(c) >= 0, F.col(c))), F.lit(0)).cast("long")
    sums = responses.agg(part("prompt_tokens").alias("prompt_tokens"), part("completion_tokens").alias("completion_tokens"))
    return sums.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def recall_probe(sessions: DataFrame) -> DataFrame:
    """Misses parted into those whose target the deep pool never held and those that were only ranked too low."""
    n = lambda c: F.count(F.when(c, 1))
    hit, deep = F.col("hit"), F.col("recall_hit")
    counts = sessions.agg(F.count("*").alias("sample_count"), n(hit).alias("hits"), n(deep).alias("recalled"), n(~hit).alias("miss_count"), n(~hit & ~deep).alias("retrieval_failure_count"), n(~hit & deep).alias("ranking_failure_count"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return counts.select(
        "sample_count",
        share("hits", "sample_count").alias("official_hit_rate_at_10"),
        share("recalled", "sample_count").alias("recall_at_k"),
        "miss_count",
        "retrieval_failure_count",
        share("retrieval_failure_count", "miss_count").alias("retrieval_failure_fraction_of_misses"),
        "ranking_failure_count",
        share("ranking_failure_count", "miss_count").alias("ranking_failure_fraction_of_misses"),
    )


def metric_record(sessions: DataFrame, responses: DataFrame | None = None) -> dict:
    """The whole record on the driver: a row for each scenario at most is collected."""
    rows = {r["scenario_type"]: r.asDict() for r in grouping_sets(sessions.where("scenario_type is not null")).collect()}
    rounded = lambda r: {k: r[k] if k == "sample_count" or r[k] is None else round(r[k], 6) for k in ("sample_count", "hit_rate_at_10", "mrr", "mttc")}
    empty = {"sample_count": 0, "hit_rate_at_10": 0.0, "mrr": 0.0, "mttc": None}
    overall = rounded(rows[None]) if rows.get(None, empty)["sample_count"] else empty
    efficiency = max(0.0, min(1.0, (11.0 - overall["mttc"]) / 10.0)) if overall["mttc"] is not None else None
    score = 0.5 * overall["hit_rate_at_10"] + 0.3 * overall["mrr"] + 0.2 * efficiency if efficiency is not None else None
    usage = token_usage(responses).first().asDict() if responses is not None else {"prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0}
    return overall | {
        "efficiency": None if efficiency is None else round(efficiency, 6),
        "recommended_technical_score": None if score is None else round(score, 6),
        "reported_token_usage": usage,
        "scenario_metrics": {k: rounded(rows[k]) for k in sorted(x for x in rows if x is not None)},
    }
