"""An index that grows by segments: postings of the documents that came together, never changed, merged by size.

A segment holds the postings and the ids and lengths of its documents, and the version that names it their number and
the sum of their lengths, so adding documents reads nothing else. A deletion names (segment, id) pairs and what they
take from the sums. When FANOUT segments are of one size tier, a commit merges them into one and drops what was deleted;
so there are a few segments of each size, and each posting is rewritten once for each tier.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import bounded, written
from ..sources.versions import Versions
from . import lexical

FANOUT = 4


class Segments:
    """postings() and stats() are those of all live documents, as the searches of `lexical` take them."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long"):
        self.spark, self.versions, self.id_type = spark, Versions(spark, path), id_type
        self.posted, self.held, self.gone = f"id {id_type}, term string, dl long, tf double", f"id {id_type}, dl long", f"segment string, id {id_type}"

    def _read(self, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.versions.path}/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def _live(self, segments: list[dict], table: str, schema: str) -> DataFrame:
        """A table of the segments without what was deleted from each."""
        parts = []
        for s in segments:
            rows = self._read([s[table]], schema)
            if s["deleted"]:
                rows = rows.join(bounded(written(self._read(s["deleted"], self.gone).where(F.col("segment") == s["postings"]).select("id").distinct(), "gone"), 40), "id", "left_anti")
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def _segment(self, postings: DataFrame, docs: DataFrame) -> dict:
        posted, held = self.versions.write(postings.selectExpr("id", "term", "cast(dl as long) as dl", "cast(tf as double) as tf")), self.versions.write(docs.select("id", F.col("dl").cast("long").alias("dl")))
        return {"postings": posted, "docs": held, "deleted": []} | self._sums(self._read([held], self.held))

    @staticmethod
    def _sums(docs: DataFrame) -> dict:
        """Documents, those that have a text, and their tokens."""
        r = docs.agg(F.count("*").alias("n"), F.count("dl").alias("texts"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        return r.asDict()

    def _commit(self, change, tries: int = 20) -> int:
        """Commit what change makes of the latest segments; it is made again if another writer came first."""
        for _ in range(tries):
            version = self.versions.latest()
            if self.versions.commit(version + 1, change(self.versions.parts(version))):
                return version + 1
        raise RuntimeError(f"no version of {self.versions.path} could be committed in {tries} tries")

    def add(self, docs: DataFrame, id_col: str, tokens: Column) -> int:
        """A segment of docs, whose ids no live document has."""
        lengths = docs.select(F.col(id_col).cast(self.id_type).alias("id"), F.size(tokens).alias("dl"))
        posted = lexical.postings(docs, id_col, tokens).withColumn("id", F.col("id").cast(self.id_type))
        made = self._segment(posted, lengths)
        version = self._commit(lambda segments: [*segments, made])
        self.merge()
        return version

    def delete(self, ids: DataFrame) -> int:
        """ids: a column id. Documents that are not there are left out."""
        ids = written(ids.select(F.col("id").cast(self.id_type).alias("id")).distinct(), "deleted")

        def change(segments: list[dict]) -> list[dict]:
            out = []
            for s in segments:
                hit = written(self._live([s], "docs", self.held).join(bounded(ids, 40), "id", "left_semi"), "hit")
                less = self._sums(hit)
                name = [self.versions.write(hit.select(F.lit(s["postings"]).alias("segment"), "id"))] if less["n"] else []
                out.append(s | {k: s[k] - v for k, v in less.items()} | {"deleted": s["deleted"] + name})
            return out

        return self._commit(change)

    def merge(self) -> None:
        """Merge segments of one tier while there are FANOUT of one."""
        while True:
            version = self.versions.latest()
            segments, tiers = self.versions.parts(version), {}
            for s in segments:
                tiers.setdefault(int(math.log(max(s["n"], 1), FANOUT)), []).append(s)
            full = next((t for _, t in sorted(tiers.items()) if len(t) >= FANOUT), None)
            if full is None:
                return
            made = self._segment(self._live(full, "postings", self.posted), self._live(full, "docs", self.held))
            self.versions.commit(version + 1, [s for s in segments if s not in full] + [made])

    def postings(self) -> DataFrame:
        return self._live(self.versions.parts(self.versions.latest()), "postings", self.posted)

    def stats(self) -> DataFrame:
        """One row: n documents and mean tokens, from what the version tells."""
        segments = self.versions.parts(self.versions.latest())
        n, texts, tokens = (sum(s[k] for s in segments) for k in ("n", "texts", "tokens"))
        return self.spark.createDataFrame([(n, tokens / texts if texts else None)], "n long, mean double")
