"""Byte-level BPE ids of whole texts, through the tokenizers library, with a memo of the chunks between words.

A byte-level BPE tokenizer first cuts a text into pre-tokens and merges inside each alone. Where every white space of
a text is one space or one line feed between two other characters, each of them starts a new pre-token, so the text
may be cut before them and the chunks encoded apart. Each distinct chunk goes through the library once while it is in
the memo, whose size is bounded; the ids are those of the whole text. Other texts are encoded whole, and so are those
that hold an added token (such as <|endoftext|>), which the library finds before it cuts.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np

OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
ASCII_SPACES = [c for c in OTHER_SPACES if c.isascii()]


class Memo(dict):
    """Ids of chunks. A chunk that is not held is None, and is noted in missed."""

    def __init__(self):
        self.missed: list[str] = []

    def __missing__(self, chunk: str) -> None:
        self.missed.append(chunk)


class ChunkEncoder:
    """encode(texts): for each text, its ids as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer_path: str, memo_entries: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = [""] if any(c.isspace() for x in added for c in x) else added  # one across chunks: no text is cut
        self.memo_entries, self.memo = memo_entries, Memo()
        pieces = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(pieces.values()) + 1, np.int64)
        for piece, i in pieces.items():
            self.n_bytes[i] = len(piece)  # byte-level pieces are spelt with one character a byte

    def _learn(self, chunks: list[str]) -> None:
        """Encode many chunks as one text, since a call costs more than a chunk, and part its ids at their places.

        A chunk is a word after a space, unless it begins with its line feed.
        """
        groups = [[x if x[0] == "\n" else " " + x for x in chunks[i : i + 200]] for i in range(0, len(chunks), 200)]
        memo, n_bytes = self.memo, self.n_bytes
        for k, (group, found) in enumerate(zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True)):
            ids = array("I", found.ids)
            cuts = (np.searchsorted(np.cumsum(n_bytes[ids]), np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in group])) * 4 + 4).tolist()
            raw, a = ids.tobytes(), 0
            for chunk, b in zip(chunks[k * 200 : k * 200 + 200], cuts, strict=True):
                memo[chunk] = raw[a:b]
                a = b

    def encode(self, texts: list[str]) -> list[bytes]:
        cut, whole = [], []
        for text in texts:
            parts = text.replace("\n", " \n").split(" ")
            regular = "" not in parts and "\n" not in parts and not any(x in text for x in (ASCII_SPACES if text.isascii() else OTHER_SPACES)) and not any(x in text for x in self.added)
            cut.append(parts if regular else None)
            whole.append(parts[0] if regular else text)
        begun = self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)
        memo = self.memo
        if len(memo) > self.memo_entries:
            memo.clear()
        get, bodies, waiting, new = memo.__getitem__, [], [], set()
        for parts in cut:
            memo.missed = []
            pieces = list(map(get, parts[1:])) if parts else []
            if memo.missed:
                waiting.append((len(bodies), pieces, memo.missed))
                new.update(memo.missed)
            bodies.append(b"" if memo.missed else b"".join(pieces))
        if new:
            self._learn(list(new))
        for k, pieces, missed in waiting:
            at = -1
            for chunk in missed:
                at = pieces.index(None, at + 1)
                pieces[at] = memo[chunk]
            bodies[k] = b"".join(pieces)
        return [array("I", x.ids).tobytes() + body for x, body in zip(begun, bodies, strict=True)]


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str) -> ChunkEncoder:
    """One encoder for each Python worker."""
    return ChunkEncoder(tokenizer_path)
