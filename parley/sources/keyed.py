"""A table of rows by key whose upserts rewrite only the files that hold a key of theirs.

Files hold ranges of keys, and their Parquet footers the least and greatest key and a Bloom filter of all. An upsert
leaves out the files whose range the new keys do not meet, finds by the key column alone which of the others hold one
of them, and writes those anew without the old rows and with the new ones; all other files stay as they are and are
named again by the next version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import bounded, scratch, written
from .versions import Versions


class KeyedTable:
    """Rows of `schema` at path; a version names its files, each with the least and greatest key and the number of rows."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema):
        self.spark, self.key, self.schema, self.versions = spark, key, schema, Versions(spark, path)

    def read(self, version: int | None = None) -> DataFrame:
        return self._of([f["file"] for f in self.versions.parts(self.versions.latest() if version is None else version)])

    def _of(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.versions.path}/{f}" for f in files)) if files else self.spark.createDataFrame([], self.schema)

    def _written(self, rows: DataFrame, files: int) -> list[dict]:
        """rows in about so many files by ranges of the key, with what the version tells of each."""
        ordered = rows.select(*rows.columns).repartitionByRange(max(1, files), F.col(self.key)).sortWithinPartitions(self.key)
        name = self.versions.write(ordered, **{f"parquet.bloom.filter.enabled#{self.key}": "true"})
        back = self.spark.read.schema(self.schema).parquet(f"{self.versions.path}/{name}")
        told = back.groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")).agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count("*").alias("n"))
        return [{"file": f"{name}/{r.file}", "low": r.low, "high": r.high, "n": r.n} for r in told.collect()]

    def create(self, rows: DataFrame, file_rows: int = 1_000_000) -> int:
        """The first version; keys are integers or strings."""
        with scratch():
            held = written(rows, "created")
            made = self._written(held, -(-held.count() // file_rows))
        if not self.versions.commit(1, made):
            raise RuntimeError(f"there is a table at {self.versions.path}")
        return 1

    def touched(self, files: list[dict], keys: DataFrame) -> list[dict]:
        """The files that hold a key of keys (written down): by ranges first, then by their key columns."""
        ends = keys.agg(F.min(self.key), F.max(self.key)).first()
        near = [f for f in files if ends[0] is not None and f["low"] is not None and f["low"] <= ends[1] and f["high"] >= ends[0]]
        if not near:
            return []
        held = self._of([f["file"] for f in near]).select(self.key, F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
        hit = {r.file for r in held.join(bounded(keys, 40), self.key, "left_semi").select("file").distinct().collect()}
        return [f for f in near if f["file"].rpartition("/")[2] in hit]

    def upsert(self, new: DataFrame, file_rows: int = 1_000_000, tries: int = 20) -> tuple[int, int]:
        """Rows of new, and those of the table whose key new has not: the next version and how many files it rewrote."""
        with scratch():
            new = written(new.select(*(f.name for f in self.read().schema)), "upserted")
            return self._upserted(new, written(new.select(self.key).distinct(), "keys"), file_rows, tries)

    def _upserted(self, new: DataFrame, keys: DataFrame, file_rows: int, tries: int) -> tuple[int, int]:
        for _ in range(tries):
            version = self.versions.latest()
            files = self.versions.parts(version)
            old = self.touched(files, keys)
            left = self._of([f["file"] for f in old]).join(bounded(keys, 40), self.key, "left_anti")
            made = self._written(reduce(DataFrame.unionByName, [left, new]), -(-(sum(f["n"] for f in old) + new.count()) // file_rows))
            stay = {f["file"] for f in old}
            if self.versions.commit(version + 1, [f for f in files if f["file"] not in stay] + made):
                return version + 1, len(old)
        raise RuntimeError(f"no version of {self.versions.path} could be committed in {tries} tries")
