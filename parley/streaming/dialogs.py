"""Dialogues as streams with the whole state of a session: messages, slots, what was shown, what was rejected.

A row says what a customer wrote at a turn and what they were then shown. Rows wait, as state, until the watermark has
passed their time, and are then taken in the order of their times by an event-time timer, so rows that come late, but
within the watermark's delay, give the rows that an ordered table gives. A second timer forgets a session that was idle
for idle_ms of event time; at most `most` messages of a session are held. So the state is bounded by the sessions of
the last idle_ms, on any endless stream.

At each turn the values of what was shown last count as rejected, the message fills the slots, and a slot that it
contradicts clears what was shown and rejected before.

Timers of event time and expiry by processing time (a state's own TTL) exclude each other in one operator; the timers
do both.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import vocabulary as V
from .sessions import advance

OUT = "session_id string, turn long, query string, material string, color string, size string, budget double, overridden array<string>, shown array<string>, rejected array<string>"
NAMES = [x.split()[0] for x in OUT.split(", ")]


class Dialogs(StatefulProcessor):
    def __init__(self, idle_ms: int, most: int):
        self.idle_ms, self.most = idle_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, turn long, text string, shown string")
        self.slots = handle.getValueState("slots", "material string, color string, size string, budget double, last long")
        self.messages = handle.getListState("messages", "text string")
        self.shown = handle.getMapState("shown", "id string", "turn long")
        self.rejected = handle.getMapState("rejected", "value string", "n long")
        self.last = handle.getListState("last", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.at_ms), int(r.turn), r.text or "", r.shown or "[]") for part in rows for r in part.itertuples()]
        self.waiting.appendList(new)
        for at in {r[0] for r in new}:
            self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due, left = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        if due:
            yield pd.DataFrame(self.taken(key[0], due), columns=NAMES)
            self.handle.registerTimer(due[-1][0] + self.idle_ms)
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        elif self.slots.exists() and self.slots.get()[4] + self.idle_ms <= now:
            for state in (self.slots, self.messages, self.shown, self.rejected, self.last):
                state.clear()

    def taken(self, session: str, due: list[tuple]) -> list[tuple]:
        """The session's rows after each message; state is read before the first and written after the last."""
        held = dict(zip(V.SLOTS, self.slots.get()[:4], strict=True)) if self.slots.exists() else dict.fromkeys(V.SLOTS)
        messages = [m[0] for m in self.messages.get()] if self.messages.exists() else []
        last = [v[0] for v in self.last.get()] if self.last.exists() else []
        shown = {k[0]: v[0] for k, v in self.shown.iterator()} if self.shown.exists() else {}
        rejected = Counter({k[0]: v[0] for k, v in self.rejected.iterator()} if self.rejected.exists() else {})
        out = []
        for _, turn, text, items in due:
            rejected.update(last)
            query, gone = advance(messages, held, text)
            if gone:
                shown, rejected = {}, Counter()
            del messages[: -self.most]
            items = json.loads(items)
            last = [v for x in items for v in x.get("values") or []]
            shown |= {x["id"]: turn for x in items}
            out.append((session, turn, query, *(held[a] for a in V.SLOTS), gone, sorted(shown), [f"{v}:{n}" for v, n in sorted(rejected.items())]))
        self.slots.update((*(held[a] for a in V.SLOTS), due[-1][0]))
        for state, values in ((self.messages, messages), (self.last, last)):
            if values:
                state.put([(v,) for v in values])
            else:
                state.clear()
        for state, values in ((self.shown, shown), (self.rejected, rejected)):
            state.clear()
            for k, v in values.items():
                state.updateValue((k,), (v,))
        return out


def dialog_stream(messages: DataFrame, delay: str = "10 minutes", idle_ms: int = 86_400_000, most: int = 200) -> DataFrame:
    """messages: a stream of session_id, turn, at (a timestamp), text, shown (an array of (id, values), or null).

    A row for each message once the watermark, `delay` behind the latest, has passed it; messages that come later than
    that are dropped. shown and rejected are those after the turn, in order, rejected as value:count.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = messages.withWatermark("at", delay)
    keyed = timed.select(F.col("session_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("turn"), "at", F.unix_millis("at").alias("at_ms"), "text", F.to_json("shown").alias("shown"))
    return keyed.groupBy("session_id").transformWithStateInPandas(Dialogs(idle_ms, most), OUT, "Append", "EventTime")
