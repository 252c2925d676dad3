"""Best-fit packing by patterns: few-document length patterns fitted to the histogram by non-negative least squares.

1. Each document is tokenised, ended by end_id, and cut into pieces of capacity tokens if longer (the first piece
   takes the remainder). Pieces are written down with their rank among the pieces of like length of their task.
2. The histogram of lengths (at most capacity entries) goes to the driver. Patterns of two and three lengths that
   fill a sequence exactly are enumerated; non-negative least squares fits how often each repeats; counts are
   rounded within what the histogram has, and what remains is packed best-fit, longest first.
3. The plan says, for each length, which ranks go to which sequences at which offset. It is bounded by the capacity,
   not by the data. Ranks are made global by adding counts of earlier tasks, so a length that holds a third of all
   pieces is no larger a task than any other.

Defined cases: a null text is empty and gives one piece of the end id alone; repeated rows are packed each; a null
doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .tokens import encoder

PIECES = pa.schema([("task", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("rank", pa.int64())])


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n ids: one if it fits, else the remainder first and then full ones."""
    return [n] if n <= capacity else [n % capacity] * bool(n % capacity) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, ranks = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                rows, part = [], batch.slice(i, 1000)
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder(tokenizer_path).encode(texts), strict=True):
                    ids, start = ids + end, 0
                    for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                        rows.append((task, doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), ranks[n]))
                        ranks[n] += 1
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    two = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return two.mapInArrow(cut, "task long, doc_id long, piece int, start long, length long, ids_crc32 long, rank long")


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All twos and threes of the given ascending lengths that sum to capacity; a row each, 0 for no third."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    found = [np.empty((0, 3), np.int64)]
    a = lengths[lengths <= capacity // 2]
    a = a[have[capacity - a]]
    found.append(np.stack([a, capacity - a, np.zeros_like(a)], 1))
    for a in lengths[lengths <= capacity // 3]:
        b = lengths[(lengths >= a) & (lengths <= (capacity - a) // 2)]
        b = b[have[capacity - a - b]]
        found.append(np.stack([np.full_like(b, a), b, capacity - a - b], 1))
    return np.concatenate(found)


def fit(rows: np.ndarray, histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Non-negative least squares: how often each pattern repeats, by multiplicative steps, which never turn negative."""
    target = histogram.astype(float)
    target[0] = 0.0

    def gather(v: np.ndarray) -> np.ndarray:
        return v[rows[:, 0]] + v[rows[:, 1]] + v[rows[:, 2]]

    wanted = gather(target)
    x = np.minimum.reduce([np.where(rows[:, i] > 0, target[rows[:, i]], np.inf) for i in range(3)])
    for _ in range(rounds):
        made = sum(np.bincount(rows[:, i], x, len(target)) for i in range(3))
        made[0] = 0.0
        x *= wanted / np.maximum(gather(made), 1e-12)
    return x


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) such that every piece of the histogram is in exactly one sequence."""
    left, out = histogram.astype(np.int64).copy(), []
    left[0] = 0
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    rows = patterns(np.flatnonzero(left), capacity)
    if len(rows):
        x = fit(rows, left)
        order = np.argsort(-x, kind="stable")
        counts = np.zeros(len(rows), np.int64)
        for up in (0.0, 0.5, 1.0):  # whole repeats first, then those that round up, then any that still fit
            for p in order:
                want = int(x[p] + up) - int(counts[p]) if up < 1.0 else 1 << 62
                if want <= 0:
                    if up < 0.5:
                        break
                    continue
                parts = [int(v) for v in rows[p] if v]
                fits = min(int(left[v]) // parts.count(v) for v in parts)
                if n := min(want, fits):
                    counts[p] += n
                    for v in parts:
                        left[v] -= n
        out += [(tuple(int(v) for v in sorted(rows[p], reverse=True) if v), int(counts[p])) for p in np.flatnonzero(counts)]
    return out + best_fit(left, capacity)


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest sequence that has room; sequences alike are kept as one with a count."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    free: list[int] = []  # ascending keys of room
    for length in range(capacity, 0, -1):
        todo, at = int(histogram[length]), 0
        while todo:
            while at < len(free) and (free[at] < length or not room[free[at]]):
                at += 1
            if at == len(free):
                if fits := capacity // length:
                    most = min(fits, todo)
                    n = todo // most
                    _put(room, free, capacity - most * length, ((length,) * most, n))
                    todo -= n * most
                    at = 0 if todo else at
                continue
            r = free[at]
            held, n = room[r].pop()
            used = min(n, todo)
            if n > used:
                room[r].append((held, n - used))
            _put(room, free, r - length, (held + (length,), used))
            todo -= used
            at = 0
    return [x for found in room.values() for x in found]


def _put(room: dict, free: list[int], key: int, group: tuple) -> None:
    if key not in room:
        insort(free, key)
    room[key].append(group)


def slots(made: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, intervals of ranks: where each begins, the sequence of its first rank, the offset."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for lengths, n in made:
        offset = 0
        for v in lengths:
            out[v].append((used[v], base, offset))
            used[v] += n
            offset += v
        base += n
    return {v: tuple(np.array(c, np.int64) for c in zip(*x, strict=True)) for v, x in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = shared.stage(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    each = shared.stage(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        histogram[r.length] = r.n
    where = slots(plan(histogram, capacity), capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = shared.stage(each.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")), "earlier")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("earlier").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                begin, base, place_ = where[int(length[at[0]])]
                k = np.searchsorted(begin, rank[at], side="right") - 1
                sequence[at], offset[at] = base[k] + rank[at] - begin[k], place_[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    joined = cut.join(shared.maybe_broadcast(earlier, 24), ["length", "task"])
    return joined.select(*names, "rank", "earlier").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
