"""Conversational retrieval over all sessions at once: retrieve, step, re-rank.

A turn is one plan over every live session; its state is written down in the shared folder, so plans do not grow with
turns and a lost executor costs one turn. Sessions that hit leave the loop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import dialog, fusion, lexical, structured, vectors
from ..sources.catalog import with_features
from ..sources.memo import SCHEMA, Memo
from ..sources.staging import lasting, spread, written
from .config import Config
from .replay import evaluate, replay

Embed = Callable[[list[str]], list[list[float]]]
NONE = "array<string>"


@dataclass
class Engine:
    """catalog: as read_catalog gives it. embeddings: id, embedding, and embed for queries, where a dense route is on.

    scorer re-ranks, where the configuration has a depth for it: it maps requests (key, ids, prompt) to answers (key,
    ranked, prompt_tokens, completion_tokens) for those that it can answer. memo is the path of a table of answers.
    """

    catalog: DataFrame
    config: Config
    embeddings: DataFrame | None = None
    embed: Embed | None = None
    scorer: Callable[[DataFrame], DataFrame] | None = None
    memo: str | None = None
    model: str = "default"
    bm25: lexical.Bm25 = lexical.PLAIN

    def __post_init__(self) -> None:
        if "dense" in self.config.routes and (self.embeddings is None or self.embed is None):
            raise ValueError("the dense route needs embeddings and an embedder")
        self.products = written(with_features(spread(self.catalog)).withColumn("id", F.col("parent_asin")), "products")
        self.shelf = None
        tokens = X.words(F.col("lexical_text"))
        if "lexical" in self.config.routes:
            self.index = lexical.index(lexical.postings(self.products, "id", tokens), lexical.corpus_stats(self.products, tokens), self.bm25)
        if "dense" in self.config.routes:
            self.cells = vectors.cells(self.embeddings.select("id", F.col("embedding").alias("v")))

    def routes(self, queries: DataFrame, depth: int) -> list[DataFrame]:
        """queries: query_id, text. A ranked list for each enabled route of some weight; their jobs run side by side."""
        asked = queries.where(F.trim("text") != "")
        if "structured" in self.config.routes and (self.shelf is None or self.shelf.k != depth):
            with lasting():
                self.shelf = structured.shelf(self.products, depth)

        def ranked(name: str) -> DataFrame:
            if name == "lexical":
                return lexical.top_k(self.index, lexical.terms_of(asked, "query_id", X.words(F.col("text"))), depth)
            if name == "dense":
                return vectors.search(self.embeddings.select("id", F.col("embedding").alias("v")), written(self._embedded(asked), "embedded"), depth, self.cells)
            return structured.search(self.products, asked, depth, self.shelf)

        with ThreadPoolExecutor() as pool:
            return [x.select("query_id", "id", "rank") for x in pool.map(ranked, self.config.routes)]

    def _embedded(self, queries: DataFrame) -> DataFrame:
        embed = self.embed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(embed(b.column(1).to_pylist()), pa.list_(pa.float64()))], ["query_id", "v"])

        return queries.select("query_id", "text").mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, v array<double>")

    def retrieve(self, queries: DataFrame, top_k: int = V.TOP_K) -> DataFrame:
        """query_id, id, score, rank: the fused list, each route to the depth of candidate_k. Equal texts are searched once."""
        told = written(queries.select(F.col("query_id").alias("asker"), F.sha2("text", 256).alias("query_id"), "text"), "told")
        texts = told.select("query_id", "text").dropDuplicates(["query_id"])
        fused = fusion.fuse(self.routes(texts, max(self.config.candidate_k, top_k)), list(self.config.routes.values()), self.config.rrf_k)
        return told.select("asker", "query_id").join(fused, "query_id").select(F.col("asker").alias("query_id"), "id", "score", "rank")

    def start(self, sessions: DataFrame) -> DataFrame:
        """Fresh state for sessions: session_id, tags."""
        empty = F.array().cast(NONE)
        slots = [F.lit(None).cast("double" if a == "budget" else "string").alias(f"slot_{a}") for a in V.SLOTS]
        return sessions.select("*", empty.alias("messages"), *slots, empty.alias("shown"), empty.alias("last_shown"), empty.alias("rejected"))

    def step(self, state: DataFrame, turn: int, top_k: int = V.TOP_K) -> DataFrame:
        """One turn: state with message in, and out with final (ids), ask_attribute, reply, and the state after it."""
        cfg, c, empty = self.config, F.col, F.array().cast(NONE)
        new = {a: f(c("message"), cfg.strict_size) if a == "size" else f(c("message")) for a, f in dialog.SLOT_OF.items()}
        contradicted = F.lit(False)
        for a in V.SLOTS:
            contradicted = contradicted | F.coalesce(c(f"slot_{a}") != c(f"new_{a}"), F.lit(False))
        s = state.select("*", *(v.alias(f"new_{a}") for a, v in new.items())).withColumn("overridden", contradicted)
        rejected = F.concat("rejected", "last_shown") if cfg.posterior_downweight else empty
        s = s.withColumn("rejected", F.when(c("overridden"), empty).otherwise(rejected)).withColumn("shown", F.when(c("overridden"), empty).otherwise(c("shown")))
        s = s.withColumn("messages", F.when(c("message") != "", F.concat("messages", F.array("message"))).otherwise(c("messages")))
        s = s.withColumns({f"slot_{a}": F.coalesce(f"new_{a}", f"slot_{a}") for a in V.SLOTS}).drop(*(f"new_{a}" for a in V.SLOTS))
        filled = F.array_compact(F.array(*(F.when(c(f"slot_{a}").isNotNull(), F.lit(a)) for a in V.SLOTS)))
        # without exclusions and rejections of its own, all that a session is shown and asked hangs on its query and slots
        own = cfg.proven_negative_filter or cfg.posterior_downweight
        s = s.withColumn("query", dialog.build_query(c("messages"), c("tags"))).withColumn("filled", filled)
        s = written(s.withColumn("alike", c("session_id") if own else F.sha2(F.to_json(F.struct("query", "filled")), 256)), "state")
        one = s if own else s.select(c("alike").alias("session_id"), "query", "filled").dropDuplicates(["session_id"])
        fused = self.retrieve(one.select(c("session_id").alias("query_id"), c("query").alias("text")), top_k).withColumnRenamed("query_id", "session_id")
        if cfg.proven_negative_filter:
            ranked = fused.withColumnRenamed("session_id", "query_id")
            fused = fusion.exclude(ranked, s.select(c("session_id").alias("query_id"), F.explode("shown").alias("id"))).withColumnRenamed("query_id", "session_id")
        facts = self.products.select("id", "title", "values", "material", "color", "size", c("bucket").alias("budget"))
        pool = spread(written(fused.join(facts, "id"), "pool"), 50_000, "session_id")
        if cfg.portfolio_ranking:
            lists = fusion.prune_pool(pool, top_k, ["session_id"]).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "values"))).alias("pool"))
            weight = fusion.diversity_weight(F.lit(turn), cfg.explore_exploit)
            if cfg.posterior_downweight:
                rejections = s.select("session_id", F.explode("rejected").alias("id"))
                counts = dialog.rejection_counts(rejections, facts).groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("value", c("n").cast("int").alias("n")))).alias("counts"))
                lists = lists.join(counts, "session_id", "left")
            else:
                lists = lists.withColumn("counts", F.lit(None).cast("map<string,int>"))
            lists = lists.withColumn("counts", F.coalesce("counts", F.create_map().cast("map<string,int>")))
            final = lists.select("session_id", fusion.cover(c("pool"), c("counts"), weight, top_k).alias("final"))
        else:
            final = pool.where(c("rank") <= top_k).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x.id).alias("final"))
        told = one.select("session_id", "query", "filled").join(final, "session_id", "left").withColumn("final", F.coalesce("final", empty)).withColumn("prompt_tokens", F.lit(0).cast("long")).withColumn("completion_tokens", F.lit(0).cast("long"))
        if cfg.rerank_depth and (self.scorer is not None or self.memo):
            answers = self.reranked(one, pool).select("session_id", F.slice("ranked", 1, top_k).alias("ranked"), c("prompt_tokens").alias("p"), c("completion_tokens").alias("q"))
            told = told.join(answers, "session_id", "left").withColumn("final", F.coalesce("ranked", "final")).withColumn("prompt_tokens", F.coalesce("p", "prompt_tokens")).withColumn("completion_tokens", F.coalesce("q", "completion_tokens")).drop("ranked", "p", "q")
        if cfg.question_policy == "eig":
            asked = dialog.choose_attribute(pool, one.select("session_id", "filled")).withColumnRenamed("attribute", "ask_attribute")
            told = told.join(asked, "session_id")
        else:
            told = told.withColumn("ask_attribute", dialog.fixed_question(c("filled")) if cfg.question_policy == "fixed" else F.lit(None).cast("string"))
        s = s.drop("filled").join(told.drop("query", "filled").withColumnRenamed("session_id", "alike"), "alike").drop("alike")
        return s.withColumns({"shown": F.array_union("shown", "final"), "last_shown": c("final"), "reply": dialog.question_text(c("ask_attribute"))})

    def reranked(self, state: DataFrame, pool: DataFrame) -> DataFrame:
        """session_id, ranked (null: keep the order), tokens: from the memo, or else from the scorer.

        What the scorer answers is added to the memo, so the same request is never asked twice and a second run gives
        the same ranks. A scorer that fails leaves the order as it is.
        """
        c, spark = F.col, state.sparkSession
        deep = pool.where(c("rank") <= self.config.rerank_depth).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "title"))).alias("candidates"))
        ids = F.transform("candidates", lambda x: x.id)
        asked = state.select("session_id", "query").join(deep, "session_id").select("session_id", X.cache_key(F.lit(self.model), c("query"), ids).alias("key"), ids.alias("ids"), X.prompt(c("query"), c("candidates")).alias("prompt"))
        asked = written(asked, "asked")
        requests = asked.drop("session_id").dropDuplicates(["key"])
        kept = Memo(spark, self.memo) if self.memo else None
        memo = kept.read() if kept else spark.createDataFrame([], SCHEMA)
        fresh = None
        if self.scorer is not None:
            unknown = requests.where(F.size("ids") > 0).join(memo.select("key"), "key", "left_anti")
            try:
                fresh = written(self.scorer(unknown).dropDuplicates(["key"]), "scored")
            except Exception:  # whatever a plug-in raises; nothing but its own rows is worked out here
                fresh = None
        answers = written(fusion.rerank(requests, memo, None if fresh is None else lambda _: fresh), "answers")
        if kept and fresh is not None:
            kept.add(answers.where("ranked is not null").join(fresh.select("key"), "key", "left_semi"))
        return asked.select("session_id", "key").join(answers, "key")

    def run(self, samples: DataFrame, top_k: int = V.TOP_K) -> tuple[DataFrame, DataFrame]:
        """(session results, transcript) of all samples: see replay."""
        return replay(self, self.catalog, samples, top_k)

    def evaluate(self, samples: DataFrame) -> dict:
        """The metric record of all samples, with one entry for each session."""
        return evaluate(self, self.catalog, samples)
