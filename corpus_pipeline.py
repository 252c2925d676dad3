"""The training-data pipeline: quality rules, line dedup, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and reads it back as the next stage's docs. The table before is then deleted.

Defined cases: null and empty texts fail the quality rules; texts of any length are worked on whole; of lines and of
documents that are alike, equal ones among them, that of the least doc_id stays, nulls last, then that of the first row;
an empty table gives an empty table; all stages but the last pass all columns on, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import lines, ngram_join, packing, quality, shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines near-alike to earlier ones; those of which no line is left go.

    n_chars is that of the new text. A document without any line with a word stays as it is.
    """
    told = shared.free_name(docs, "__lines")
    done = lines.dedup_lines(docs, out=told)
    left = done.where(f"{told}.removed < {told}.lines or {told}.lines = 0").drop(told)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class linked by five-word shingles at 0.8 or more."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its sequence of at most 2048 tokens and its place there."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("best-fit packing", best_fit_packing)]

#: The stages use robust estimates, tokenizers and packing, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = shared.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = shared.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            shared.release(last)
        last = docs
    return docs
