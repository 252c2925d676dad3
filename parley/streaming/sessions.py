"""Dialogues as streams: the state of each session kept by Structured Streaming."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import vocabulary as V

SIZE = re.compile(V.SIZE, re.I)
AMOUNT = re.compile(V.BUDGET_AMOUNT, re.A)
OUT = "session_id string, turn long, query string, material string, color string, size string, budget double, overridden array<string>"
STATE = "messages array<string>, material string, color string, size string, budget double"


def slots(text: str) -> dict[str, object]:
    low, size, amount = text.lower(), SIZE.search(text), AMOUNT.search(text)
    first = lambda words: next((w for w in words if w in low), None)
    return {"material": first(V.MATERIALS), "color": first(V.COLORS), "size": size[1].lower() if size else None, "budget": float(amount[1]) if amount else None}


def advance(messages: list[str], held: dict[str, object], text: str) -> tuple[str, list[str]]:
    """Take one message into a session's state; its query and what it contradicts."""
    if text:
        messages.append(text)
    new = slots(text)
    gone = [a for a in V.SLOTS if new[a] is not None and held[a] is not None and held[a] != new[a]]
    held |= {a: v for a, v in new.items() if v is not None}
    query = " ".join(x for x in (messages[-1], messages[-1], " ".join(messages[:-1])) if x).strip() if messages else ""
    return query, gone


def _run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, expire_ms: int | None = None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    messages, *values = state.get if state.exists else ([], None, None, None, None)
    messages, held, out = list(messages), dict(zip(V.SLOTS, values, strict=True)), []
    for row in pd.concat(list(batches)).sort_values("turn").itertuples():
        query, gone = advance(messages, held, row.text or "")
        out.append((key[0], row.turn, query, *(held[a] for a in V.SLOTS), gone))
    state.update((messages, *(held[a] for a in V.SLOTS)))
    if expire_ms:
        state.setTimeoutDuration(expire_ms)
    yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])


def session_stream(messages: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """messages: a stream of session_id, turn, text. A row for each message with its session's state after it.

    Turns of a session that come in one batch are taken in order; a later batch goes on from the state kept. A session
    that says nothing for expire_ms of processing time is forgotten, so the state of an endless stream does not grow with
    it; without expire_ms it is kept, as streams that run until their input is read need (a timeout keeps them going).
    """
    keyed = messages.selectExpr("cast(session_id as string) as session_id", "cast(turn as long) as turn", "text").groupBy("session_id")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire_ms else GroupStateTimeout.NoTimeout
    return keyed.applyInPandasWithState(functools.partial(_run, expire_ms=expire_ms), OUT, STATE, "append", timeout)
