"""Tables with versions: a version is a file that names the table's parts, and committing one is a rename that only one writer can do."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """The versions of the table at path, numbered from 1; the parts are folders and files below path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, hadoop = spark, path.rstrip("/"), spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self._path, self._system = hadoop.Path, hadoop.Path(self.path).getFileSystem(conf)
        self._files = hadoop.FileContext.getFileContext(self._system.getUri(), conf)

    def latest(self) -> int:
        """The number of the latest version, 0 before the first."""
        at = self._path(f"{self.path}/versions")
        names = [f.getPath().getName() for f in self._system.listStatus(at)] if self._system.exists(at) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def parts(self, version: int) -> list[Any]:
        """What the version's file names."""
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version:012d}", wholetext=True).first()[0]) if version else []

    def write(self, rows: DataFrame, **options: str) -> str:
        """The name of a new folder with rows as Parquet; it belongs to no version yet."""
        name = f"data-{uuid.uuid4().hex}"
        rows.write.options(**options).parquet(f"{self.path}/{name}")
        return name

    def commit(self, version: int, parts: list[Any]) -> bool:
        """Whether version was free and is now this one: a rename that gives way to a file that is there."""
        draft, final = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._path(f"{self.path}/versions/{version:012d}")
        out = self._system.create(draft)
        out.write(json.dumps(parts).encode())
        out.close()
        kind = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self._files.rename(draft, final, options)
        except Exception as e:
            self._system.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True
