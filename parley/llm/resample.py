"""Importance resampling toward a target: hashed n-grams of a position table, gains of their buckets, Gumbel draws.

posexplode lays every word of a document at its place; for runs of several words a window over the document's places
lets lead() fetch the words that follow, which are concatenated for each order. Runs are hashed into buckets and the
buckets alone are written down, with the document's row: counts, gains and sums are aggregations of that table, and the
only thing that is ever joined to it are the gains of the buckets, a table whose size is a parameter.

A document is dealt out whole, before its words are laid out, so the window needs no shuffle of words. Draws are exact
ranks over all documents: rows are dealt by ranges of the score and numbered inside the ranges.

Defined cases: null and empty texts, and those without words, have no features, weight 0, and are never drawn; a text of
any length is read whole; repeated rows count and are scored each; a null id is hashed as an empty one and comes last among equal
scores; of equal scores and ids an arbitrary row comes first; an empty table gives an empty table, an empty target
gains of counts of 0; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Runs of ASCII digits, lower-case letters and all that is not ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of one partition, of which monotonically_increasing_id counts 2^33 before the next partition's.
PLACES = 33


def features(docs: DataFrame, id_col: str, text_col: str, orders: tuple[int, int], buckets: int) -> DataFrame:
    """row, id, n_words, bucket: a row for each run of orders[0] to orders[1] words, and one without bucket if there is none."""
    least, most = orders
    if not 1 <= least <= most:
        raise ValueError("orders must be two numbers from 1 up, the lesser first")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if most > 1:
        rows = rows.repartition("row")
    low = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    told = rows.select("row", "id", F.regexp_extract_all(low, F.lit(WORDS), F.lit(0)).alias("words"))
    placed = told.select("row", "id", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    if most > 1:
        on = Window.partitionBy("row").orderBy("pos")
        following = placed.select("row", "id", "n_words", "pos", "word", *(F.lead("word", i).over(on).alias(f"w{i}") for i in range(1, most)))
        words = ["word", *(f"w{i}" for i in range(1, most))]
        runs = [F.array_join(F.array(*words[:k]), " ") for k in range(least, most + 1)]
        whole = [F.when(F.col(words[k - 1]).isNotNull(), run) for k, run in zip(range(least, most + 1), runs, strict=True)]
        exploded = following.select("row", "id", "n_words", "pos", F.explode_outer(F.array_compact(F.array(*whole))).alias("run"))
        placed = exploded.where(F.col("run").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True)))
    else:
        placed = placed.withColumnRenamed("word", "run")
    return placed.select("row", "id", "n_words", F.pmod(F.crc32(F.col("run").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))


def gains(found: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain of each bucket that `found` has: thousands of the logarithm of its share in the target over that in all documents."""
    counted = lambda x, name: shared.stage(x.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name)), name)
    ours, theirs = counted(found, "s"), counted(target, "t")
    total = lambda x, name: x.agg(F.coalesce(F.sum(name), F.lit(0))).first()[0]
    s, t = total(ours, "s"), total(theirs, "t")
    share = (F.coalesce("t", F.lit(0)).cast("double") + 1) * float(s + buckets) / ((F.col("s").cast("double") + 1) * float(t + buckets))
    return shared.stage(ours.join(theirs, "bucket", "left").select("bucket", F.floor(1000 * F.log(share)).alias("gain")), "gains")


def noise(seed: int):
    """Gumbel noise in thousandths by the hash of seed and id: the same for the same id in every run."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, orders: tuple[int, int] = (1, 2), buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight, score, rank of every document.

    rank counts from 1 the drawn `percent` of the documents that have least_words, by falling score; null if not drawn.
    """
    found = shared.stage(features(docs, id_col, text_col, orders, buckets), "features")
    wanted = features(target.withColumn("__none", F.lit(None).cast("long")), "__none", target_col, orders, buckets)
    gained = gains(found, wanted, buckets)
    weighed = found.join(shared.maybe_broadcast(gained, 24), "bucket", "left").groupBy("row", "id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    scored = shared.stage(weighed.withColumn("score", F.col("weight") + noise(seed)), "scored")
    shared.release(found)
    drawn = percent * scored.where(F.col("n_words") >= least_words).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    sorted_ = scored.where(F.col("n_words") >= least_words).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = shared.stage(sorted_.withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", PLACES)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row for each partition
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << PLACES) - 1) + 1)
    columns = ["id", "n_words", "n_features", "weight", "score"]
    eligible = numbered.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    return eligible.unionByName(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
