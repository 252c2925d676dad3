"""A re-ranker's answers as a table with versions: writers commit by a rename, readers see whole versions, a key has one row.

A version is a file that names the folders of the table. A writer writes the answers whose keys the latest version has
not into a folder of their own, and commits by renaming a file to the next number, which only one writer can do; the
one that comes late leaves out what the other has brought and tries again. Of equal keys the first stays. After
FOLDERS folders a commit writes the table anew as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .versions import Versions

SCHEMA = "key string, ranked array<string>, prompt_tokens long, completion_tokens long"
FOLDERS = 16


class Memo:
    """The table at path; none is there before the first commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def latest(self) -> int:
        return self.versions.latest()

    def read(self, version: int | None = None) -> DataFrame:
        """A whole version, the latest unless told."""
        return self._of(self.versions.parts(self.latest() if version is None else version))

    def _of(self, named: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.versions.path}/{n}" for n in named)) if named else self.spark.createDataFrame([], SCHEMA)

    def add(self, answers: DataFrame, tries: int = 20, before: Callable[[], None] = lambda: None) -> int:
        """Commit the answers whose keys are new; the number of the version that has them. before: called before each commit."""
        own = answers.select(*(x.split()[0] for x in SCHEMA.split(", "))).dropDuplicates(["key"])
        held = self.versions.write(own)
        for _ in range(tries):
            version = self.latest()
            named, new = self.versions.parts(version), held
            if named:
                fresh = self._of([held]).join(self._of(named).select("key"), "key", "left_anti")
                if not fresh.limit(1).count():
                    return version
                if len(named) >= FOLDERS:
                    named, fresh = [], self._of(named).unionByName(fresh)
                new = self.versions.write(fresh)
            before()
            if self.versions.commit(version + 1, [*named, new]):
                return version + 1
        raise RuntimeError(f"no version of {self.versions.path} could be committed in {tries} tries")
