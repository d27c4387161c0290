"""Streams over several runs: late and repeated rows, restarts from the checkpoint, replays of a batch, bad files."""

import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.streaming import buffer, watch
from skein.streaming.sessions import session_schema, session_turns, stream_session_outcomes
from skein.streaming.outcomes import run_available
from skein.streaming.sink import commit_once, committed

TURNS = "conv_id long, turn long, role string, text string, ts timestamp"


def put_turns(spark, rows, folder):
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, at long")
    df.select("conv_id", "turn", F.lit("user").alias("role"), "text", F.timestamp_seconds(F.col("at") + 100_000).alias("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def known_turns(rows, gap, watermark):
    """What is known of all turns up to a watermark: (conv, turn, next text or None, closed)."""
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((at, turn, text) for c, turn, text, at in rows if c == conv)
        for k, (at, turn, _) in enumerate(own):
            following = own[k + 1] if k + 1 < len(own) and own[k + 1][0] - at <= gap else None
            if following and following[0] < watermark:
                out.append((conv, turn, following[2], False))
            elif not following and at + gap < watermark:
                out.append((conv, turn, None, True))
    return sorted(out, key=str)


def test_sessions_close_whatever_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, t, f"text {c} {t}", 1_000_000 + c * 97 + t * rng.choice((50, 61, 500, 4001)) + t) for c in range(12) for t in range(8)]
    # Runs see the rows by time, disordered by less than the delay of 600 seconds.
    arrival = sorted(rows, key=lambda r: r[3] + rng.randrange(0, 550))
    parts = [arrival[:30], arrival[30:60], arrival[60:]]
    stream = lambda: session_turns(spark.readStream.schema(TURNS).parquet(f"{tmp_path}/in"), "1000 seconds", "600 seconds")
    latest = 0
    for n, part in enumerate(parts):
        put_turns(spark, part, tmp_path)
        run_available(stream(), str(tmp_path), "s")
        latest = max([latest, *(r[3] for r in part)])
        got = spark.read.schema(session_schema(spark.createDataFrame([], TURNS))).parquet(f"{tmp_path}/s").collect()
        seen = [r for p in parts[: n + 1] for r in p]
        assert sorted(((r.conv_id, r.turn, r.next, r.closed) for r in got), key=str) == known_turns(seen, 1000, latest - 600)
    put_turns(spark, [(99, 0, "far later", 1_000_000_000)], tmp_path)
    run_available(stream(), str(tmp_path), "s")
    got = spark.read.parquet(f"{tmp_path}/s").collect()
    assert len(got) == len(rows) and sum(r.closed for r in got) == sum(c for *_, c in known_turns(rows, 1000, 10**9 - 600))


def test_late_rows_are_left_out_and_odd_ones_take_no_part(spark, tmp_path):
    put_turns(spark, [(1, 0, "how do I sort a list", 0), (1, 2, "no, sort a list in place", 60), (1, None, "no number", 70), (2, 0, None, 7000), (None, 1, "x", 10)], tmp_path)
    source = lambda: spark.readStream.schema(TURNS).parquet(f"{tmp_path}/in")
    first = stream_session_outcomes(spark, source(), str(tmp_path), 0.5, 0.3, "30 minutes", "10 minutes", "o")
    assert sorted((str(r.conv_id), r.turn, r.outcome, r.reason) for r in first.collect()) == [("1", 0, "rejected", "negation"), ("1", 2, "neutral", "session_close")]
    put_turns(spark, [(1, 3, "too late", 100), (2, 1, "next", 7060), (3, 0, "end", 50_000)], tmp_path)
    second = stream_session_outcomes(spark, source(), str(tmp_path), 0.5, 0.3, "30 minutes", "10 minutes", "o")
    told = {(r.conv_id, r.turn): (r.outcome, r.reason) for r in second.collect()}
    assert (1, 3) not in told and told[2, 1] == ("neutral", "session_close") and told[2, 0] == ("accepted", "new_topic") and len(told) == 4


def put_calls(spark, rows, folder):
    schema = "session_id string, kind string, id string, ts timestamp, payload string, feedback string, edited boolean, seq long"
    df = spark.createDataFrame([(s, k, i, at, f) for s, k, i, at, f in rows], "session_id string, kind string, id string, at long, feedback string")
    df.select("session_id", "kind", "id", F.timestamp_seconds("at").alias("ts"), F.concat(F.lit("p"), "id").alias("payload"), "feedback", F.lit(None).cast("boolean").alias("edited"), F.lit(0).cast("long").alias("seq")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return schema


def test_buffer_of_a_size_with_feedback_and_silence(spark, tmp_path):
    day = 86_400
    schema = put_calls(spark, [("a", "record", f"r{i}", i, None) for i in range(7)] + [("a", "mark", "r6", 8, "positive"), ("a", "mark", "r1", 9, "negative"), ("b", "record", "x", day + 1, None), ("b", "record", "y", 5, None), (None, "record", "z", 1, None), ("b", None, "z", 1, None)], tmp_path)
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    rows = lambda: sorted(((r.session_id, r.kind, r.day, r.batch_no, r.position, r.reason, r.id, r.feedback) for r in committed(spark, f"{tmp_path}/w", buffer.WRITTEN).collect()), key=str)
    buffer.write_buffered(stream(), str(tmp_path), 3, "1 second", "w")
    first = [("a", "record", "1970-01-01", n // 3, n % 3, "full", f"r{n}", None) for n in range(6)] + [("a", "mark", "1970-01-01", None, None, None, "r1", "negative")]
    assert rows() == sorted(first, key=str)
    # The rest stays in the state over a restart: it is marked there, filled up or let out by a call or by silence.
    put_calls(spark, [("b", "record", "w", day + 2, None), ("b", "record", "v", day + 3, None), ("b", "mark", "y", day + 4, "neutral"), ("b", "close", None, day + 5, None)], tmp_path)
    time.sleep(1.5)
    buffer.write_buffered(stream(), str(tmp_path), 3, "1 second", "w")
    second = [("b", "record", "1970-01-02", 0, k, "full", i, None) for k, i in enumerate("xwv")] + [("b", "record", "1970-01-01", 0, 0, "close", "y", "neutral")]
    silent = [("a", "record", "1970-01-01", 2, 0, "silence", "r6", "positive")]
    assert rows() == sorted(first + second + silent, key=str)
    buffer.write_buffered(stream(), str(tmp_path), 3, "1 second", "w")
    assert rows() == sorted(first + second + silent, key=str)


def test_a_batch_is_committed_once(spark, tmp_path):
    df, schema = spark.range(5).withColumn("day", (F.col("id") % 2).cast("string")), "id long, day string"
    assert committed(spark, f"{tmp_path}/t", schema).count() == 0
    assert commit_once(df, 0, f"{tmp_path}/t", ("day",)) and not commit_once(df, 0, f"{tmp_path}/t", ("day",))
    # A crash between data and manifest leaves a folder that nobody reads, and a cut manifest entry counts as none.
    df.write.json(f"{tmp_path}/t/data/batch_id=1/attempt=crashed")
    (tmp_path / "t" / "manifest" / "000000000001").mkdir()
    assert committed(spark, f"{tmp_path}/t", schema).count() == 5
    assert commit_once(df.filter("id < 2"), 1, f"{tmp_path}/t", ("day",)) and commit_once(df.limit(0), 2, f"{tmp_path}/t")
    assert sorted((r.id, r.day, r.batch_id) for r in committed(spark, f"{tmp_path}/t", schema).collect()) == [(0, "0", 0), (0, "0", 1), (1, "1", 0), (1, "1", 1), (2, "0", 0), (3, "1", 0), (4, "0", 0)]


def said(role, text):
    return json.dumps({"type": role, "message": {"role": role, "content": text}})


def test_watch_sets_bad_files_aside_and_reads_each_file_once(spark, tmp_path):
    good = "\n".join([said("user", "please fix this error now"), "not json", "[1]", said("assistant", "You should look at the stack trace and then change the loop so that it ends, " * 3)])
    (tmp_path / "in" / "p1").mkdir(parents=True)
    (tmp_path / "in" / "p2").mkdir()
    (tmp_path / "in" / "p1" / "good.jsonl").write_text(good)
    (tmp_path / "in" / "p1" / "bytes.jsonl").write_bytes(b"\xff\xfe{}\n")
    (tmp_path / "in" / "p2" / "none.jsonl").write_text("no\njson\n")
    (tmp_path / "in" / "p2" / "empty.jsonl").write_text(" \n")
    (tmp_path / "in" / "p2" / "other.txt").write_text(good)
    watch.watch_sessions(spark, f"{tmp_path}/in", str(tmp_path / "out"), glob="*.jsonl")
    marker, pairs = watch.watched(spark, str(tmp_path / "out"))
    told = {r.file_key: (r.status, r.reason, r.records, r.pairs) for r in marker.collect()}
    assert told == {"p1/good.jsonl": ("done", None, 2, 1), "p1/bytes.jsonl": ("failed", "no UTF-8", 0, 0), "p2/none.jsonl": ("failed", "no JSON object", 0, 0), "p2/empty.jsonl": ("done", None, 0, 0)}
    assert [(r.file_key, r.category) for r in pairs.collect()] == [("p1/good.jsonl", "error_fix")]
    # Later lines of a known file are not read, a new file is, under a new root and checkpoint a known key is not.
    (tmp_path / "in" / "p1" / "good.jsonl").write_text(good + "\n" + good)
    (tmp_path / "in" / "p2" / "new.jsonl").write_text(good)
    watch.watch_sessions(spark, f"{tmp_path}/in", str(tmp_path / "out"), glob="*.jsonl")
    marker, pairs = watch.watched(spark, str(tmp_path / "out"))
    assert marker.count() == 5 and sorted(r.file_key for r in pairs.collect()) == ["p1/good.jsonl", "p2/new.jsonl"]


@pytest.mark.parametrize("n", [0, 3])
def test_a_batch_without_files(spark, tmp_path, n):
    (tmp_path / "in").mkdir()
    for k in range(n):
        (tmp_path / "in" / f"{k}.jsonl").write_text("{}")
    watch.watch_sessions(spark, f"{tmp_path}/in", str(tmp_path / "out"))
    assert watch.watched(spark, str(tmp_path / "out"))[0].count() == n


class _Counted:
    """A stand-in for state and its handle that counts what is asked of it."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def getListState(self, *_):  # noqa: N802
        return _Counted()

    def getMapState(self, *_):  # noqa: N802
        return self

    def containsKey(self, key):  # noqa: N802
        self.asked += 1
        return key in self.held

    def getValue(self, key):  # noqa: N802
        self.asked += 1
        return self.held[key]

    def updateValue(self, key, value):  # noqa: N802
        self.asked += 1
        self.held[key] = value

    def exists(self):
        return False

    def listTimers(self):  # noqa: N802
        return ()

    def clear(self):
        pass


def test_state_is_asked_for_a_day_and_not_for_each_batch():
    state, kept = _Counted(), buffer.Buffer(2, 1000)
    kept.init(state)
    names = ["session_id", "kind", "id", "ts_ms", "day", "payload", "feedback", "edited", "seq", "arrived_ms"]
    numbers = []
    for part in range(2):
        rows = [("a", "record", str(i), part * 100 + i, f"d{i // 50}", "p", None, False, i, 0) for i in range(100)]
        numbers += [n for out in kept.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=names)]), None) for n in zip(out.day, out.batch_no, strict=True)]
    assert sorted(numbers) == sorted((d, n) for d in ("d0", "d1") for n in range(50) for _ in range(2))
    assert state.held == {("d0",): (50,), ("d1",): (50,)} and state.asked <= 12
