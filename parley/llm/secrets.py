"""Secrets in texts: assignments, access keys and hex strings by pattern, other random strings by how badly they tokenize.

A vocabulary of byte pairs spells words and names in few tokens and random strings in many. Among runs of letters,
digits and the signs of base64, those of at least `least` characters that mix letters with digits, or cases inside a
word, are cut into tokens; a run with fewer than `ratio` characters to a token is random. Known digests (hex of the
length of a usual hash, base64 after the name of one), UUIDs, ULIDs, bank account numbers whose checksum is right and runs that
hold a date are named by what they are, so they are no secrets, and neither is what overlaps a span found by pattern.
Of random strings of 32 characters of base64 all fall below 2.0 and of hex 99 of 100;
joined, hyphenated or camel-cased words have 2.4 and more.

Every text is read whole, one at a time; a run of any length is cut into tokens in pieces of PIECE characters, so the
memory it takes is bounded by the text.

Defined cases: a null or empty text has no spans; a null text stays null when redacted; repeated rows are read each; an
empty table gives an empty table; spans are in code points, ends exclusive; further columns of any name pass through.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Name, pattern, the group that is measured and its least length. Letters of assignments are in either case.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
RANDOM = "random"
KINDS = (*(p[0] for p in PATTERNS), RANDOM)

RUN = r"[A-Za-z0-9+/_-]{%d,}={0,2}"
MIXED = re.compile(r"(?=.*[A-Za-z])(?=.*[0-9])|(?:.*?[a-z][A-Z]){3}", re.S)
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_DIGITS = (32, 40, 56, 64, 96, 128)
HEX = re.compile(r"(?:0x)?([0-9a-fA-F]+)")
NAMED_DIGEST = re.compile(r"(?:md5|sha1|sha224|sha256|sha384|sha512)[-_/+][A-Za-z0-9+/_-]+={0,2}", re.I | re.A)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
ULID = re.compile(r"[0-7][0-9A-HJKMNP-TV-Z]{25}")
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
DATE = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}([-_/]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])(?![0-9])")
PIECE = 4096

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@lru_cache(2)
def vocabulary(path: str):
    """The tiktoken encoding of a file of ranks, once for each worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_pattern(text: str) -> list[tuple[str, int, int]]:
    """Spans of PATTERNS: the leftmost matches of each kind that do not overlap, of these the ones long enough."""
    return [(kind, *m.span()) for kind, pattern, group, least in PATTERNS for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def sound_account(run: str) -> bool:
    """Whether the check digits of an international bank account number are right."""
    return bool(ACCOUNT.fullmatch(run)) and int("".join(str(int(c, 36)) for c in run[4:] + run[:4])) % 97 == 1


def known(run: str) -> bool:
    """Whether a run is a digest or an identifier of a known form."""
    digits = HEX.fullmatch(run)
    if digits and len(digits[1]) in DIGEST_DIGITS:
        return True
    return bool(NAMED_DIGEST.fullmatch(run) or UUID.fullmatch(run) or ULID.fullmatch(run) or DATE.search(run)) or sound_account(run)


def chars_per_token(run: str, vocab_path: str) -> float:
    encode = vocabulary(vocab_path).encode_ordinary
    return len(run) / sum(len(encode(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def find(text: str | None, vocab_path: str, least: int = 20, ratio: float = 2.0) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then by KINDS."""
    if not text:
        return []
    spans = by_pattern(text)
    held, found = merged([s[1:] for s in spans]), []
    for m in re.finditer(RUN % least, text):
        start, end = m.span()
        after = bisect.bisect_left(held, (end, 0))
        if after and held[after - 1][1] > start:
            continue
        run = m[0]
        if MIXED.match(run) and not known(run) and chars_per_token(run, vocab_path) < ratio:
            found.append((RANDOM, start, end))
    return sorted(spans + found, key=lambda s: (s[1], KINDS.index(s[0])))


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """text with <kind> in place of each span; spans that overlap are one, by the name of the first."""
    if text is None:
        return None
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"<{kind}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def scan(docs: DataFrame, vocab_path: str, text_col: str = "text", least: int = 20, ratio: float = 2.0, out: str | None = None, redact: bool = False, drop_text: bool = False) -> DataFrame:
    """docs with the spans (kind, start, end) of each text as the last column, by a name that docs has not unless told.

    With redact the text has its secrets replaced by their kinds; with drop_text it is left out.
    """
    out = out or shared.free_name(docs, "__spans")
    keep = [c for c in docs.columns if not (drop_text and c == text_col)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, SPANS)])
    at = docs.columns.index(text_col)
    places = [docs.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = part.column(at).to_pylist()
                found = [find(t, vocab_path, least, ratio) for t in texts]
                spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found], SPANS_ARROW)
                columns = [part.column(p) for p in places]
                if redact and not drop_text:
                    columns[places.index(at)] = pa.array([redacted(t, f) for t, f in zip(texts, found, strict=True)], part.column(at).type)
                yield pa.RecordBatch.from_arrays([*columns, spans], [*keep, out])

    return shared.map_rows(docs, run, schema)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
