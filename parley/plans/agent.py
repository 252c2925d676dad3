"""Agents: one session and one turn at a time, as thin calls of the set-oriented plans; and a registry of them."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import fusion, lexical
from ..sources.catalog import read_catalog
from ..sources.staging import scratch, written
from .config import Config
from .engine import Engine

NO_USAGE = {"prompt_tokens": 0, "completion_tokens": 0}


class Agent:
    """reset(session_id, user_profile), then respond(session_id, user_message, turn, top_k) turn by turn."""

    def __init__(self, spark: SparkSession, catalog_path: str, config: Config | str | None = None, **parts):
        settings = Config.read(config) if isinstance(config, str) else config or Config()
        self.spark, self.engine, self.states = spark, Engine(read_catalog(spark, catalog_path), settings, **parts), {}

    def reset(self, session_id: str, user_profile: Mapping | None = None) -> None:
        tags = [str(t) for t in (user_profile or {}).get("preference_tags") or []]
        fresh = self.spark.createDataFrame([(session_id, tags)], "session_id string, tags array<string>")
        self.states[session_id] = self.engine.start(fresh)

    def respond(self, session_id: str, user_message: str, turn: int, top_k: int = V.TOP_K) -> dict:
        if session_id not in self.states:
            raise RuntimeError("reset must come before respond")
        state = self.states[session_id]
        with scratch():
            done = written(self.engine.step(state.withColumn("message", F.lit(user_message or "")), turn, top_k), "reply", lasting=True)
        self.states[session_id] = done.select(*state.columns)
        row = done.first()
        return {
            "message": row.reply,
            "ask_attribute": row.ask_attribute,
            "recommendations": [{"parent_asin": x} for x in row.final],
            "usage": {"prompt_tokens": row.prompt_tokens, "completion_tokens": row.completion_tokens},
        }


class FieldedAgent:
    """Stateless: each message alone is a search over weighted fields. Diacritics are folded, as in the queries' own words."""

    def __init__(self, spark: SparkSession, catalog_path: str | DataFrame):
        self.catalog = catalog = read_catalog(spark, catalog_path) if isinstance(catalog_path, str) else catalog_path
        told = F.transform(F.map_entries("details"), lambda e: F.concat_ws(" ", e.key, e.value))
        columns = {"title": F.coalesce("title", F.lit("")), "categories": X.joined(F.col("categories")), "features": X.joined(F.col("features")), "details": X.joined(told), "store": F.coalesce("store", F.lit("")), "description": X.joined(F.col("description"))}
        tokens = {n: F.regexp_extract_all(X.folded(F.lower(c)), F.lit(r"(?U)([\p{L}\p{N}]+)"), 1) for n, c in columns.items()}
        self.spark, self.sessions = spark, set()
        self.postings = written(lexical.field_postings(catalog, "parent_asin", {n: (t, V.FIELD_WEIGHTS[n]) for n, t in tokens.items()}), "postings")
        self.stats = written(lexical.corpus_stats(catalog, F.concat(*tokens.values())), "stats")

    def search(self, queries: DataFrame, top_k: int) -> DataFrame:
        """queries: query_id, text. query_id, id, score, rank."""
        return lexical.search(self.postings, self.stats, lexical.terms_of(queries, "query_id", X.unique_terms(F.col("text"))), top_k, lexical.FIELDED)

    def start(self, sessions: DataFrame) -> DataFrame:
        return sessions

    def step(self, state: DataFrame, turn: int, top_k: int = V.TOP_K) -> DataFrame:
        """A turn of all live sessions."""
        found = self.search(state.select(F.col("session_id").alias("query_id"), F.col("message").alias("text")), top_k)
        final = found.groupBy(F.col("query_id").alias("session_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x.id).alias("final"))
        answers = {"final": F.coalesce("final", F.array().cast("array<string>")), "ask_attribute": F.lit(None).cast("string"), "reply": F.lit(V.CLOSEST), "prompt_tokens": F.lit(0).cast("long"), "completion_tokens": F.lit(0).cast("long")}
        return state.join(final, "session_id", "left").withColumns(answers)

    def reset(self, session_id: str, user_profile: Mapping | None = None) -> None:
        self.sessions.add(session_id)

    def respond(self, session_id: str, user_message: str, turn: int, top_k: int = V.TOP_K) -> dict:
        if session_id not in self.sessions:
            raise RuntimeError("reset must come before respond")
        asked = self.spark.createDataFrame([(0, user_message or "")], "query_id long, text string")
        found = self.search(asked, top_k).orderBy("rank").collect()
        return {"message": V.CLOSEST, "ask_attribute": None, "recommendations": [{"parent_asin": r.id} for r in found], "usage": dict(NO_USAGE)}


class Plugged:
    """A stepper around any object with reset and respond, called on the driver for each live session of a turn.

    Such an object keeps its sessions in its own memory, so it has one place to live. What it is asked and what it
    answers goes through in pieces of a fixed number of sessions; customers, checks and scores are plans over all. An
    answer that fails or is malformed is an empty turn.
    """

    ANSWER = "session_id string, reply string, ask_attribute string, ids array<string>, prompt_tokens long, completion_tokens long"

    def __init__(self, agent, catalog: DataFrame, piece: int = 1000):
        self.agent, self.ids, self.piece = agent, catalog.select(F.col("parent_asin").alias("id")), piece

    @staticmethod
    def parsed(response: object) -> tuple:
        """reply, ask_attribute, recommended ids and the two counts of tokens."""
        if not isinstance(response, dict) or not isinstance(response.get("message"), str):
            return "", None, [], 0, 0
        listed = response.get("recommendations")
        ids = [str(x.get("parent_asin", "") if isinstance(x, dict) else x) for x in listed] if isinstance(listed, list) else []
        usage = response.get("usage") if isinstance(response.get("usage"), dict) else {}
        tokens = [x if isinstance(x, int) and x >= 0 else 0 for x in (usage.get("prompt_tokens"), usage.get("completion_tokens"))]
        asked = response.get("ask_attribute")
        return response["message"], None if asked is None else str(asked), ids, *map(int, tokens)

    def _ask(self, session_id: str, message: str, turn: int, top_k: int) -> tuple:
        try:
            return self.parsed(self.agent.respond(session_id, message, turn, top_k))
        except Exception:  # whatever a plug-in raises
            return self.parsed(None)

    def start(self, sessions: DataFrame) -> DataFrame:
        sessions = written(sessions, "sessions")
        for row in sessions.select("session_id", "profile").toLocalIterator():
            self.agent.reset(row.session_id, row.profile.asDict(True) if row.profile else {})
        return sessions

    def step(self, state: DataFrame, turn: int, top_k: int = V.TOP_K) -> DataFrame:
        spark, answers, held = state.sparkSession, [], []

        def put() -> None:
            answers.append(written(spark.createDataFrame(held, self.ANSWER), "answers"))
            held.clear()

        for row in state.select("session_id", "message").toLocalIterator():
            held.append((row.session_id, *self._ask(row.session_id, row.message, turn, top_k)))
            if len(held) >= self.piece:
                put()
        if held or not answers:
            put()
        given = reduce(DataFrame.unionByName, answers)
        items = given.select(F.col("session_id").alias("query_id"), F.posexplode("ids").alias("pos", "id"))
        final = fusion.normalize(items, self.ids, top_k).groupBy(F.col("query_id").alias("session_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x.id).alias("final"))
        done = state.join(given.drop("ids"), "session_id").join(final, "session_id", "left")
        return done.withColumn("final", F.coalesce("final", F.array().cast("array<string>")))


def load(name: str) -> Callable:
    """A builder by "module:Class"."""
    module, _, attribute = name.partition(":")
    if not module or not attribute:
        raise ValueError(f"not of the form module:Class: {name!r}")
    return getattr(importlib.import_module(module), attribute)
