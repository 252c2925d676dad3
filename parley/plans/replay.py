"""Replaying labelled sessions with a simulated customer, for anything that can take a turn of all live sessions at once.

A stepper has start(sessions), which gives the state of fresh sessions, and step(state, turn, top_k), which gives the
state with `final` (an array of ids), ask_attribute, reply, prompt_tokens and completion_tokens. Each turn is written
down in the shared folder; sessions that hit leave the loop.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import metrics
from ..sources.staging import scratch, written
from . import simulator


class Stepper(Protocol):
    def start(self, sessions: DataFrame) -> DataFrame: ...

    def step(self, state: DataFrame, turn: int, top_k: int) -> DataFrame: ...


def replay(stepper: Stepper, catalog: DataFrame, samples: DataFrame, top_k: int = V.TOP_K) -> tuple[DataFrame, DataFrame]:
    """(session results, transcript) of all samples, up to ten turns each; hits count within the first ten places."""
    c = F.col
    hidden = written(simulator.hidden_fields(samples, catalog), "hidden")
    opened = hidden.withColumn("o", simulator.initial_message(c("scenario_type"), c("category"), c("card"), c("override.old_value")))
    state = stepper.start(opened.withColumnRenamed("sample_id", "session_id").select("session_id", "scenario_type", "target", "tags", "profile", "card", "override", c("o.message").alias("message"), c("o.disclosed").alias("disclosed"), F.lit(False).alias("boundary_used"), (c("scenario_type") != "intent_override").alias("applied")))
    keep, transcript = state.columns, None
    for turn in range(1, V.MAX_TURNS + 1):
        place = F.array_position(c("final"), c("target"))
        with scratch():
            done = written(stepper.step(state, turn, top_k).withColumn("turn", F.lit(turn)).withColumn("place", F.when(c("applied") & (place > 0), place)), "turn", lasting=True)
        said = done.select("session_id", "scenario_type", "target", "turn", c("message").alias("user_message"), c("reply").alias("message"), "ask_attribute", F.slice("final", 1, V.TOP_K).alias("recommendations_shown"), F.size("final").alias("candidate_pool_size"), (place > 0).alias("target_in_candidate_pool"), F.array_contains(F.slice("final", 1, V.TOP_K), c("target")).alias("target_in_shown_top10"), "place", "prompt_tokens", "completion_tokens")
        transcript = said if transcript is None else transcript.unionByName(said)
        live = done.where(c("place").isNull() | (c("place") > V.TOP_K))
        if turn == V.MAX_TURNS or live.limit(1).count() == 0:
            break
        switch = ~c("applied") & (F.coalesce(c("override.turn"), F.lit(3)) == turn + 1)
        answered = simulator.customer_reply(c("scenario_type"), c("card"), c("ask_attribute"), c("disclosed"), c("boundary_used"))
        switched = F.struct(c("override.message").alias("message"), F.array_union("disclosed", F.array_compact(F.array(F.nullif(c("override.new_value"), F.lit(""))))).alias("disclosed"), c("boundary_used").alias("boundary_used"))
        live = live.withColumn("r", F.when(switch, switched).otherwise(answered)).withColumn("applied", c("applied") | switch)
        state = live.withColumns({"message": c("r.message"), "disclosed": c("r.disclosed"), "boundary_used": c("r.boundary_used")}).select(*keep)
    first = Window.partitionBy("session_id")
    hit = F.col("place") <= V.TOP_K
    results = transcript.groupBy(c("session_id").alias("sample_id"), "scenario_type", "target").agg(
        F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit"),
        F.min(F.when(hit, c("turn"))).alias("first_hit_turn"),
        F.min(F.when(hit, c("place"))).alias("best_rank"),
        F.min(F.when(c("place").isNotNull(), c("turn"))).alias("first_recall_turn"),
    )
    results = results.withColumn("reciprocal_rank", F.coalesce(1.0 / c("best_rank"), F.lit(0.0))).withColumn("recall_hit", c("first_recall_turn").isNotNull())
    return written(results, "results"), transcript.withColumn("turns", F.max("turn").over(first))


def evaluate(stepper: Stepper, catalog: DataFrame, samples: DataFrame) -> dict:
    """The metric record of all samples."""
    return metrics.metric_record(*replay(stepper, catalog, samples))
