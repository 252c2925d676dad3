"""Many names in many texts: every name that a text holds anywhere, by automata that read each text once.

Names are dealt into parts of about NAMES, texts into slices. A task has one part of the names as an Aho-Corasick
automaton, whose states fit its memory whatever the number of names, and streams the texts of one slice through it;
each text is read once for each part. Names that begin alike share states, so no beginning is a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of one automaton.
NAMES = 50_000


def automaton(names: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for name in names:
        made.add_word(name, name)
    made.make_automaton()
    return made


def held(made: ahocorasick.Automaton, text: str) -> list[str]:
    """The names that a text holds, each once, in order."""
    return sorted({name for _, name in made.iter(text)}) if len(made) else []


def names_in(texts: DataFrame, names: DataFrame, id_col: str = "query_id", text_col: str = "low", name_col: str = "store_text", part_names: int = NAMES) -> DataFrame:
    """id_col, name_col: each name that a text contains, once. Empty and null names and texts have none; case counts."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = names.select(F.col(name_col).alias("text")).where("text <> ''").distinct()
    parts = max(1, -(-known.count() // part_names))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    kind = texts.schema[id_col].dataType.simpleString()
    given = known.select(of("text", parts).alias("part"), each(tasks).alias("slice"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("id"), "text")
    asked = texts.where(F.col(text_col) != "").select(each(parts).alias("part"), of(id_col, tasks).alias("slice"), F.lit(1).alias("kind"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made, waiting = None, None, []
        for batch in batches:
            ids, found = [], []
            for part, piece, is_text, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, piece) != at:
                    at, made, waiting = (part, piece), None, []
                if not is_text:
                    waiting.append(text)
                    continue
                if made is None:
                    made = automaton(waiting)
                own = held(made, text)
                ids += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(3).type), pa.array(found, pa.string())], [id_col, name_col])

    met = given.unionByName(asked).repartition("part", "slice").sortWithinPartitions("part", "slice", "kind")
    return met.mapInArrow(run, f"`{id_col}` {kind}, `{name_col}` string")
