"""SentencePiece encoding and decoding by a streaming Viterbi search over the pieces of a model file.

The lattice is walked one character at a time. Only the last `longest piece` boundaries are held, each with its best
backpointer; whenever the backpointer paths of all of them run through one boundary, the ids up to it are committed
and dropped. So a text of any length takes a window of bounded size plus what is not yet agreed.

One boundary is known beforehand to be such a meeting point: that before a space mark, if no piece of the model has a
mark after another character (checked when a model is read). Every path runs through it, so what lies between two of
them is a stream of its own, committed whole at its end, and the ids of such a segment do not depend on what is around
it: they are remembered by its text, in a memo of bounded size. A segment longer than the window (a text without spaces) moves
the window and commits inside. `whole` gives the one stream over a text without this cut; the ids are the same.

Two kinds of model give two meanings of best:
- Unigram: the path of greatest total score.
- BPE: the path that merging gives. A path of pieces is what BPE gives for a text exactly if each neighbouring pair
  is what BPE gives for the pair alone, and every prefix has just one such path. So a boundary's backpointer is the one
  piece that is compatible with the last piece of the path before it, and the search needs no scores along the path.

Characters of no piece become their UTF-8 bytes if the model has byte pieces, or else the unknown piece.

Defined cases: a null or empty text has no ids; repeated rows are encoded each; an empty table gives an empty table;
further columns pass through. Texts in which normalisation is not the identity are not changed: models with a
normalisation table are refused.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Memo(dict):
    """What make gave for a key, in two generations: the older goes when the younger is full, but for what was used."""

    def __init__(self, make: Callable[[str], bytes], entries: int):
        super().__init__()
        self.make, self.entries, self.older = make, entries, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


class PieceModel:
    """Pieces and scores of a model file; encode, decode and a streaming form of encode."""

    def __init__(self, path: str, memo_entries: int = 700_000):
        import sentencepiece.sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with identity normalisation are read")
        self.is_bpe = proto.trainer_spec.model_type == 2
        self.dummy_prefix = spec.add_dummy_prefix
        self.texts = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)}
        self.scores = [p.score for p in proto.pieces]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        self.longest = max(map(len, self.ids), default=1)
        self.by_word = all(MARK not in x.lstrip(MARK) for x in self.ids)
        self.good = {x: i for x, i in self.ids.items() if not self.is_bpe or len(x) == 1 or self.merged(list(x)) == [x]}
        #: The good pieces as a tree, read from their ends: (children by character, [piece] or none, what compatible told).
        self.tree: tuple[dict, list[str], dict[str, bool]] = ({}, [], {})
        for x in self.good:
            node = self.tree
            for c in reversed(x):
                node = node[0].setdefault(c, ({}, [], {}))
            node[1].append(x)
        self.worst = min(self.scores, default=0.0) - 10
        #: What each id adds to a text's bytes.
        self.raw = [bytes([int(x[1:-1], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" if k == CONTROL else x.encode() for x, k in zip(self.texts, self.kinds, strict=True)]
        self.memo = Memo(self._segment, memo_entries)
        self._told: list[dict[str, bool]] = []

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the neighbours whose joined piece scores best are joined, leftmost first, while there are any."""
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                piece = self.ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def compatible(self, left: str, right: str, told: dict[str, bool]) -> bool:
        """Whether BPE gives just these two pieces for the two together; told, of the node of right, then has it too."""
        if len(self._told) > 1_000_000:
            for known in self._told:
                known.clear()
            self._told.clear()
        self._told.append(told)
        found = told[left] = not left or self.merged(list(left + right)) == [left, right]
        return found

    def step(self, recent: str, at: int, window) -> tuple[int, str, float]:
        """The entry of boundary at, after the characters recent: (backpointer, last piece, score).

        Of the pieces that end here BPE has just one that is compatible with the path before it; Unigram takes the best.
        """
        node, best = self.tree, None
        for size in range(1, len(recent) + 1):
            node = node[0].get(recent[-size])
            if node is None:
                break
            if not node[1]:
                continue
            piece, before = node[1][0], window[at - size]
            if self.is_bpe:
                known = node[2].get(before[1])
                if known or known is None and self.compatible(before[1], piece, node[2]):
                    return at - size, piece, 0.0
            elif best is None or before[2] + self.scores[self.ids[piece]] > best[2]:
                best = (at - size, piece, before[2] + self.scores[self.ids[piece]])
        if best is None or recent[-1] not in self.ids and window[at - 1][2] + self.worst > best[2]:
            best = (at - 1, recent[-1], window[at - 1][2] + self.worst)
        return best

    def stream(self, chars: Iterable[str], watch: Callable[[int, int], None] | None = None) -> Iterator[tuple[str, int | None]]:
        """(piece, id) in order, as soon as all surviving paths agree; id is None for a character of no piece.

        window holds, for each boundary that a later piece can start from or a backpointer passes, (backpointer, piece,
        score); boundaries are numbered from the beginning of the text. watch is told the window's size and the number
        of pieces at each commit.
        """
        recent, window, n, done = "", {0: (-1, "", 0.0)}, 0, 0
        longest, limit, step = self.longest, 4 * self.longest, self.step
        for c in chars:
            recent, n = (recent + c)[-longest:], n + 1
            window[n] = step(recent, n, window)
            if len(window) > limit:
                size, found = len(window), self._commit(window, n, done)
                if watch:
                    watch(size, len(found))
                for piece in found:
                    yield piece
                    done += len(piece[0])
        rest = self._path(window, n, done)
        if watch:
            watch(len(window), len(rest))
        yield from rest

    def whole(self, text: str, watch: Callable[[int, int], None] | None = None) -> array:
        """The ids of a text by one stream from its first character to its last."""
        return self._ids(self.stream((" " + text if self.dummy_prefix else text).replace(" ", MARK), watch)) if text else array("i")

    def _path(self, window, at: int, done: int) -> list[tuple[str, int | None]]:
        out = []
        while at > done:
            back, piece, _ = window[at]
            out.append((piece, self.ids.get(piece)))
            at = back
        return out[::-1]

    def _commit(self, window: dict, n: int, done: int) -> list[tuple[str, int | None]]:
        """What all paths from boundaries in reach agree on; drops boundaries that nothing needs any more."""
        alive = {n - i for i in range(min(self.longest, n - done + 1))}
        alive = {x for x in alive if x >= done and window.get(x) is not None}
        while len(alive) > 1:
            far = max(alive)
            alive.remove(far)
            alive.add(window[far][0] if far > done else done)
        meet = alive.pop()
        out = self._path(window, meet, done)
        needed, stack = {meet}, [n - i for i in range(self.longest)]
        for x in stack:
            while x > meet and x not in needed:
                needed.add(x)
                x = window[x][0]
        for x in [x for x in window if x not in needed]:
            del window[x]
        return out

    def _ids(self, found: Iterable[tuple[str, int | None]]) -> array:
        out = array("i")
        for piece, i in found:
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _segment(self, word: str) -> bytes:
        text = MARK + word
        return self._ids(self._held(text) if self.is_bpe and len(text) <= 4 * self.longest else self.stream(text)).tobytes()

    def _held(self, text: str) -> list[tuple[str, int | None]]:
        """What stream gives for a BPE text no longer than its window, by the same search: nothing is committed before its end."""
        last, n = [""], 0
        for c in text:
            node, start = self.tree[0].get(c), n
            while node is not None:
                if node[1]:
                    known = node[2].get(last[start])
                    if known or known is None and self.compatible(last[start], node[1][0], node[2]):
                        c = node[1][0]
                        break
                if not start:
                    break
                start -= 1
                node = node[0].get(text[start])
            last.append(c)
            n += 1
        out = []
        while n:
            out.append((last[n], self.ids.get(last[n])))
            n -= len(last[n])
        return out[::-1]

    def encode(self, text: str | None) -> array:
        """The ids of a text, committed segment by segment where the model allows it."""
        if not text:
            return array("i")
        words = (" " + text if self.dummy_prefix else text).replace(" ", MARK).split(MARK)
        if not self.by_word or "" in words[1:]:  # a run of marks may be one piece, so it is no boundary
            return self.whole(text)
        first = self._ids(self.stream(words[0])) if words[0] else array("i")
        first.frombytes(b"".join(map(self.memo.__getitem__, words[1:])))
        return first

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model for each Python worker."""
    return PieceModel(path)


def _mapped(docs: DataFrame, column: str, out: str, kind: T.DataType, arrow: pa.DataType, convert: Callable) -> DataFrame:
    at, names = docs.columns.index(column), [c for c in docs.columns if c != out]
    places = [docs.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                values = [convert(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(p) for p in places), pa.array(values, arrow)], [*names, out])

    return shared.map_rows(docs, run, T.StructType([docs.schema[c] for c in names] + [T.StructField(out, kind)]))


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of each text; a column of the name out is replaced."""
    return _mapped(docs, text_col, out, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), lambda x: memoryview(model(path).encode(x)).tolist())


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text of each array of ids; null ids give an empty text."""
    return _mapped(docs, ids_col, out, T.StringType(), pa.string(), lambda x: model(path).decode(x or ()))


def digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs without the text but with n_pieces, ids_crc32 and round_trip, in one pass that keeps no ids.

    round_trip says whether the decoded ids are the text, where space marks in a text read as spaces.
    """

    def one(text: str | None) -> tuple[int, int, bool]:
        ids = model(path).encode(text)
        return len(ids), zlib.crc32(ids.tobytes()), model(path).decode(ids) == (text or "").replace(MARK, " ")

    kind = T.StructType([T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    arrow = pa.struct([("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])
    found = _mapped(docs, text_col, "__digest", kind, arrow, lambda x: dict(zip(kind.names, one(x), strict=True)))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), "__digest.*")
