"""Streams of dialogues against loops over ordered messages."""

import json
import os
import random

from pyspark.sql import functions as F

from parley import queries
from parley.functions import vocabulary as V
from parley.operators import dialog
from parley.streaming.dialogs import dialog_stream
from parley.streaming.sessions import advance

def run(spark, folder, name, batches, most=200, idle_ms=86_400_000, delay="60 seconds"):
    """Rows of the stream that reads the batches one by one; the last one only moves the watermark."""
    at = folder / name
    at.mkdir()
    for i, rows in enumerate([*batches, [("~", 0, 10_000_000, None, None)], [("~", 1, 10_000_001, None, None)]]):
        lines = [json.dumps({"session_id": s, "turn": t, "sec": sec, "text": x, "shown": shown}) for s, t, sec, x, shown in rows]
        (at / f"{i}.json").write_text("\n".join(lines))
        os.utime(at / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in the order of their times
    stream = spark.readStream.schema("session_id string, turn long, sec long, text string, shown array<struct<id:string,values:array<string>>>").option("maxFilesPerTrigger", 1).json(str(at))
    made = dialog_stream(stream.withColumn("at", F.timestamp_seconds(F.col("sec") + 1000)), delay, idle_ms, most)
    query = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / f"{name}-cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = [r for r in spark.table(name).collect() if r.session_id != "~"]
    return rows, query.recentProgress


def plain(rows):
    out, states = {}, {}
    for s, t, _, text, items in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        held, messages, last, shown, rejected = states.setdefault(s, (dict.fromkeys(V.SLOTS), [], [], {}, {}))
        for v in last:
            rejected[v] = rejected.get(v, 0) + 1
        query, gone = advance(messages, held, text or "")
        if gone:
            shown.clear()
            rejected.clear()
        last[:] = [v for x in items or [] for v in x["values"]]
        shown |= {x["id"]: t for x in items or []}
        out[s, t] = (query, *(held[a] for a in V.SLOTS), gone, sorted(shown), [f"{v}:{n}" for v, n in sorted(rejected.items())])
    return out


def talk(rng, sessions, turns):
    words = ["leather", "wool", "red", "black", "navy", "size 9", "xx-large", "under $50", "at $19.98", "please", "shoes"]
    item = lambda: {"id": f"p{rng.randrange(30)}", "values": rng.sample(["leather", "red", "mid", "wool"], rng.randint(0, 3))}
    return [(f"s{s}", t, 10 * t + s % 7, rng.choice([None, "", " ".join(rng.sample(words, 3))]) if t else "hello shoes", [item() for _ in range(rng.randint(0, 3))] or None) for s in range(sessions) for t in range(turns)]


def told(rows):
    return {(r.session_id, r.turn): (r.query, *(r[a] for a in V.SLOTS), r.overridden, r.shown, r.rejected) for r in rows}


def test_late_messages_within_the_watermark_are_taken_in_order(spark, tmp_path):
    rng = random.Random(3)
    rows = talk(rng, 12, 8)
    late = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 50))
    got, _ = run(spark, tmp_path, "late", [late[:30], late[30:60], late[60:]])
    assert len(got) == len(rows) and told(got) == plain(rows) and any(r.overridden for r in got)


def test_what_is_too_late_is_dropped_and_idle_sessions_are_forgotten(spark, tmp_path):
    batches = [[("a", 0, 0, "red wool", None), ("b", 0, 0, "black", None)], [("b", 1, 1000, "x", None)], [("c", 0, 1001, "y", None)], [("a", 1, 5, "late", None)], [("a", 2, 2000, "navy", None), ("b", 2, 2000, "navy", None)]]
    got, progress = run(spark, tmp_path, "idle", batches, idle_ms=1_500_000, delay="10 seconds")
    rows = told(got)
    assert set(rows) == {("a", 0), ("b", 0), ("b", 1), ("c", 0), ("a", 2), ("b", 2)}
    assert rows["a", 2][0] == "navy navy" and rows["a", 2][2] == "navy" and rows["a", 2][1] is None and rows["a", 2][5] == []
    assert rows["b", 2][5] == ["color"]
    states = [s["numRowsTotal"] for p in progress for s in p["stateOperators"]]
    assert states[-1] < max(states) and states[-1] <= 8


def test_messages_held_are_bounded(spark, tmp_path):
    rows = [("a", t, t, f"m{t}", None) for t in range(30)]
    got, _ = run(spark, tmp_path, "most", [rows[:15], rows[15:]], most=3)
    assert told(got)["a", 29][0] == "m29 m29 m26 m27 m28"


def test_stream_of_conversations_is_the_batch(spark):
    folder = "/root/testdata/sf0.001"
    said = spark.read.parquet(f"{folder}/conversations.parquet").where("role = 'user'")
    want = {(r.conv_id, r.turn): r for r in dialog.slot_turns(said, "conv_id", "turn", "text").join(dialog.dialog_queries(said, "conv_id", "turn", "text"), ["conv_id", "turn"]).collect()}
    got = queries.QUERIES["streamed_dialogs"](spark, folder).collect()
    assert len(got) == len(want) > 0
    for r in got:
        w = want[r.conv_id, r.turn]
        assert (r.query, r.material, r.color, r.size, r.budget, r.overridden) == (w.query, w.material, w.color, w.size, w.budget, "|".join(w.overridden))
