"""Sources and sinks: catalogs and sessions as JSON lines, embedding tables, result files, report tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nested
from ..functions import text as X
from .staging import bounded, written


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TEXT, TEXTS, NUMBER = T.StringType(), T.ArrayType(T.StringType()), T.DoubleType()
CATALOG = _struct(
    parent_asin=TEXT, title=TEXT, features=TEXTS, details=TEXT, description=TEXTS, categories=TEXTS, store=TEXT, average_rating=NUMBER, rating_number=T.LongType(), price=TEXT
)
PROFILE = _struct(purchase_frequency=TEXT, average_prior_rating=NUMBER, rating_style=TEXT, preference_tags=TEXTS, summary=TEXT)
CARD = _struct(target_category=TEXT, hard_constraints=TEXTS, soft_preferences=TEXTS)
BEHAVIOR = _struct(scenario_type=TEXT, override=_struct(turn=T.IntegerType(), old_value=TEXT, new_value=TEXT, message=TEXT))
SAMPLES = _struct(sample_id=TEXT, scenario_type=TEXT, category_bucket=TEXT, difficulty_bucket=TEXT, ground_truth=_struct(parent_asin=TEXT), user_profile=PROFILE, intent_card=CARD, behavior=BEHAVIOR)


class BadLines(ValueError):
    """Lines of JSON files that are no records."""


def read_json_lines(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, key: str | None = None) -> DataFrame:
    """Records with ord, their place in the files: in the order of paths, then of file names, then of lines.

    Blank lines are skipped; the schema is fixed, never inferred; a field of another type is null. A line that is no
    JSON, or that lacks the key, raises BadLines with the number of such lines and the first of them.
    """
    broken, at = "__broken", ["__source", "__file", "__block"]
    with_broken = T.StructType([*schema.fields, T.StructField(broken, TEXT)])
    named = [paths] if isinstance(paths, str) else list(paths)
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    parts = [spark.read.schema(with_broken).option("columnNameOfCorruptRecord", broken).json(p).select("*", F.lit(i).alias("__source"), *place) for i, p in enumerate(named)]
    rows = reduce(DataFrame.unionByName, parts).withColumn("__row", F.monotonically_increasing_id())
    bad = F.col(broken).isNotNull() & F.try_parse_json(broken).isNull()
    bad = bad | F.col(key).isNull() if key else bad
    some = F.count(F.col(schema.fields[0].name)).alias("__some")  # Spark does not read the column of broken lines alone
    told = [some, F.min("__row").alias("__first"), F.count("*").alias("__n"), F.count_if(bad).alias("__bad"), F.min(F.when(bad, F.coalesce(broken, F.lit("a record without its key")))).alias("__text")]
    blocks = written(rows.groupBy(*at).agg(*told), "blocks")
    found = blocks.agg(F.sum("__bad").alias("n"), F.min("__text").alias("text")).first()
    if found.n:
        raise BadLines(f"{found.n} lines of {', '.join(named)} are no records, one of them: {found.text[:200]}")
    before = Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of a file
    starts = written(blocks.select(*at, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")), "starts")
    numbered = rows.join(bounded(starts, 200), at).withColumn("ord", F.col("__before") + F.col("__row") - F.col("__first"))
    return numbered.select("ord", *(f.name for f in schema.fields))


def last_wins(rows: DataFrame, key: str = "parent_asin", order: Column | None = None) -> DataFrame:
    """One row for each key: the values of its last record at the place (ord) of its first. order: the rows' ord unless told."""
    at = rows.withColumn("__at", F.col("ord") if order is None else order)
    rest = [c for c in rows.columns if c not in (key, "ord")]
    kept = at.groupBy(key).agg(F.min("__at").alias("ord"), F.max_by(F.struct(*rest), "__at").alias("r"))
    return kept.select("ord", key, "r.*")


def read_catalog(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The catalog with ord, price_text as written and price as a number (null if it is none), details as text by key."""
    rows = last_wins(read_json_lines(spark, paths, CATALOG, "parent_asin"))
    return rows.withColumn("details", nested.items(F.col("details"))).withColumn("price_text", F.col("price")).withColumn("price", F.expr("try_cast(price as double)"))


def read_samples(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return read_json_lines(spark, paths, SAMPLES).drop("ord")


def with_features(catalog: DataFrame) -> DataFrame:
    """Derived columns, once for each product: text views, slots, price bucket and feature values."""
    c = F.col
    text = X.feature_text(c("title"), c("features"))
    return catalog.select(
        "*",
        X.lexical_text(c("title"), c("description"), c("categories")).alias("lexical_text"),
        X.dense_text(c("title"), c("description"), c("features"), c("categories")).alias("dense_text"),
        F.lower(text).alias("match_text"),
        F.lower(F.coalesce("store", F.lit(""))).alias("store_text"),
        X.material(text).alias("material"),
        X.color(text).alias("color"),
        X.size(text).alias("size"),
        X.price_bucket(c("price")).alias("bucket"),
        X.feature_values(c("title"), c("features"), c("price")).alias("values"),
    )


class IndexMissing(RuntimeError):
    """An embedding table is absent or is not that of the catalog."""


#: A Mersenne prime, and the number whose powers tell the places of a sequence apart.
PRIME, RADIX = 2**61 - 1, 1_000_003


def joined_digest(left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """(length, digest) of one sequence after another."""
    return left[0] + right[0], (left[1] * pow(RADIX, right[0], PRIME) + right[1]) % PRIME


def sequence_digest(rows: DataFrame, key: str, order: str = "ord") -> tuple[int, int]:
    """Length and polynomial digest of the keys in their order, whatever the numbers that give it or the partitions.

    Ranges of the order are digested apart and joined in turn; a line for each range reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, digest = None, 0, 0
        for batch in batches:
            for at, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = at if first is None else first
                n, digest = n + 1, (digest * RADIX + code % PRIME) % PRIME
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([digest], pa.int64())], ["first", "n", "digest"])

    coded = rows.select(F.col(order).cast("long").alias("at"), F.xxhash64(F.col(key).cast("string")).alias("code"))
    ranges = coded.repartitionByRange("at").sortWithinPartitions("at", "code").mapInArrow(run, "first long, n long, digest long").collect()
    return reduce(joined_digest, [(r.n, r.digest) for r in sorted(ranges, key=lambda r: r["first"])], (0, 0))


def read_embeddings(spark: SparkSession, path: str, catalog: DataFrame | None = None) -> DataFrame:
    """id, ord, embedding; with a catalog, the ids of the table must be those of the catalog, in its order."""
    try:
        index = spark.read.parquet(path)
    except Exception as e:
        raise IndexMissing(f"no embeddings at {path}") from e
    if catalog is not None and sequence_digest(index, "id") != sequence_digest(catalog, "parent_asin"):
        raise IndexMissing("the embeddings are of another catalog, or of another order of it")
    return index


def write_embeddings(catalog: DataFrame, path: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 256, tasks: int | None = None) -> None:
    """Embed dense_text of each product in batches, on the executors, and write id, ord, embedding.

    tasks: in how many tasks, as many as the catalog has unless told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(embed(part.column(2).to_pylist()), pa.list_(pa.float32()))], ["id", "ord", "embedding"])

    texts = catalog.select(F.col("parent_asin").alias("id"), F.col("ord").cast("long").alias("ord"), "dense_text")
    texts = texts.repartition(tasks) if tasks else texts
    texts.mapInArrow(run, "id string, ord long, embedding array<float>").write.mode("overwrite").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new has not."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_markdown(existing: str, header: tuple[str, str], row: str, name: str) -> str:
    """A markdown text whose table under header has row for name, in place of an earlier one or after the last."""
    lines = existing.splitlines()
    if header[0] not in lines:
        start = existing.rstrip("\n")
        return (f"{start}\n\n" if start else "") + "\n".join([*header, row]) + "\n"
    begin = lines.index(header[0]) + 2
    end = next((i for i in range(begin, len(lines)) if not lines[i].startswith("|")), len(lines))
    at = next((i for i in range(begin, end) if lines[i].startswith(f"| {name} |")), end)
    lines[at : at + (at < end)] = [row]
    return "\n".join(lines) + "\n"


def write_record(path: str | Path, record: dict, sessions: DataFrame) -> None:
    """A JSON file of the record with the rows of sessions under `sessions`, which stream through the driver one by one."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(json.dumps(record, indent=2).rstrip()[:-1].rstrip() + ',\n  "sessions": [')
        for i, row in enumerate(sessions.toJSON().toLocalIterator()):
            out.write((",\n    " if i else "\n    ") + row)
        out.write("\n  ]\n}\n")


def write_json(path: str | Path, value: object) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2) + "\n", encoding="utf-8")
