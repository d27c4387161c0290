"""Outcomes of conversation turns by event time: sessions end after a gap, and their last turn comes out then."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from skein.functions.text import overlap, token_set
from skein.operators.turns import outcome_of
from skein.streaming.outcomes import run_available

_TURN = "ts long, turn long, text string"


class SessionTurns(StatefulProcessor):
    """Gives out each turn with the one that follows it in its session, or alone once `gap_ms` have passed without one.

    Rows wait in the state until the watermark is past them, so their order of arrival does not matter. Each key has
    one timer, at its earliest waiting row or at the end of its session; when nothing is left the state is gone.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _TURN)
        self.waiting = handle.getListState("waiting", _TURN)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(s), int(t), x) for pdf in rows for s, t, x in zip(pdf["ts_ms"], pdf["turn"], pdf["text"], strict=True) if pd.notna(t)]
        if new:
            self.waiting.appendList(new)
            self._wake(min(s for s, _, _ in new))
        yield self._frame([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1], r[2] or "")) if self.waiting.exists() else []
        ready, rest = [r for r in waiting if r[0] <= now], [r for r in waiting if r[0] > now]
        turns = ([tuple(self.last.get())] if self.last.exists() else []) + ready
        out = []
        for a, b in zip(turns, turns[1:], strict=False):
            ended = b[0] - a[0] > self.gap_ms
            out.append((key[0], a[1], a[2], None if ended else b[2], ended))
        if turns and turns[-1][0] + self.gap_ms < now:
            out.append((key[0], turns[-1][1], turns[-1][2], None, True))
            turns = []
            self.last.clear()
        elif turns:
            self.last.update(turns[-1])
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        marks = [r[0] for r in rest] + ([turns[-1][0] + self.gap_ms + 1] if turns else [])
        if marks:
            self._wake(min(marks), expiredTimerInfo.getExpiryTimeInMs())
        yield self._frame(out)

    def _wake(self, at: int, expired: int | None = None) -> None:
        """Keeps the key's earliest timer alone; the one that is being handled goes by itself."""
        before = [t for t in self.handle.listTimers() if t != expired]
        if before and min(before) <= at:
            return
        for t in before:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "turn", "text", "next", "closed"])

    def close(self) -> None:
        pass


def session_schema(turns: DataFrame) -> StructType:
    """(conv_id of the input's type, turn, text, next, closed)"""
    return turns.select("conv_id").schema.add("turn", "long").add("text", "string").add("next", "string").add("closed", "boolean")


def session_turns(turns: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Streaming (conv_id, turn, text, next, closed): each user turn of a stream (conv_id, turn, role, text, ts).

    `next` is the next user turn's text, if that comes within `gap`; otherwise the session has ended, `closed` is true
    and `next` null. A turn comes out when the watermark, `delay` behind the latest time seen, has passed its successor
    or the end of the gap. Turns of one conversation go by time, then number, then text. Rows later than the watermark
    are dropped by Spark; rows without a conversation, time or number take no part.
    """
    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    asked = turns.filter("role = 'user' AND conv_id IS NOT NULL AND ts IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), "text", F.col("ts").cast("timestamp").alias("ts"))
    timed = asked.withWatermark("ts", delay).withColumn("ts_ms", F.unix_millis("ts"))
    return timed.groupBy("conv_id").transformWithStateInPandas(SessionTurns(gap_ms), outputStructType=session_schema(turns), outputMode="Append", timeMode="EventTime")


def stream_session_outcomes(spark: SparkSession, source: DataFrame, folder: str, same: float, negated: float, gap: str = "30 minutes", delay: str = "10 minutes", name: str | None = None) -> DataFrame:
    """(conv_id, turn, outcome, reason, overlap) of the turns whose outcome is known, last turns of ended sessions included.

    With a `name` that was used before, the stream goes on from its checkpoint in `folder`.
    """
    name = name or f"sessions-{uuid.uuid4().hex}"
    run_available(session_turns(source, gap, delay), folder, name)
    found = spark.read.schema(session_schema(source)).parquet(f"{folder}/{name}")
    scored = found.withColumn("overlap", F.when(~F.col("closed"), overlap(token_set(F.col("text")), token_set(F.col("next")))))
    return scored.select("conv_id", "turn", *outcome_of(F.col("next"), F.col("overlap"), same, negated), F.round("overlap", 6).alias("overlap"))
