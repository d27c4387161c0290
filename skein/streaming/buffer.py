"""A writer that buffers records of each session and writes batches of a fixed size, with feedback on buffered ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skein.streaming.outcomes import run_available
from skein.streaming.sink import commit_once

#: Fixed value: records of a batch.
BATCH_SIZE = 100
_KEPT = "day string, id string, ts long, payload string, feedback string, edited boolean"
#: What comes out: records in their batch, and marks of records that are no longer buffered.
WRITTEN = "session_id string, kind string, day string, batch_no long, position long, reason string, id string, ts long, payload string, feedback string, edited boolean"


class Buffer(StatefulProcessor):
    """Up to `size` - 1 records of each day of a session; a full batch, a closing call or a silence lets them out."""

    def __init__(self, size: int, wait_ms: int):
        self.size, self.wait_ms = size, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", _KEPT)
        self.done = handle.getMapState("done", "day string", "batches long")

    def _batch(self, key: tuple, day: str, rows: list[tuple], reason: str, numbers: dict[str, int]) -> list[tuple]:
        """A batch of a day; `numbers` has the next number of each day met in this call, so that state is asked once a day."""
        if day not in numbers:
            numbers[day] = int(self.done.getValue((day,))[0]) if self.done.containsKey((day,)) else 0
        no = numbers[day]
        numbers[day] = no + 1
        return [(key[0], "record", day, no, k, reason, *r[1:]) for k, r in enumerate(rows)]

    def _flushed(self, key: tuple, days: dict[str, list[tuple]], reason: str, numbers: dict[str, int]) -> list[tuple]:
        return [row for day in sorted(days) if days[day] for row in self._batch(key, day, days.pop(day), reason, numbers)]

    def _remember(self, numbers: dict[str, int]) -> None:
        for day, no in numbers.items():
            self.done.updateValue((day,), (no,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        calls = sorted((r for pdf in rows for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False)), key=lambda r: (r.ts_ms, r.seq, r.id or ""))
        if not calls:
            yield self._frame([])
            return
        days: dict[str, list[tuple]] = {}
        for r in self.kept.get() if self.kept.exists() else ():
            days.setdefault(r[0], []).append(tuple(r))
        out: list[tuple] = []
        numbers: dict[str, int] = {}
        for c in calls:
            if c.kind == "close":
                out += self._flushed(key, days, "close", numbers)
            elif c.kind == "mark":
                held = next(((own, k) for own in days.values() for k in range(len(own) - 1, -1, -1) if own[k][1] == c.id), None)
                if held:
                    own, k = held
                    own[k] = (*own[k][:4], c.feedback, bool(c.edited))
                else:
                    out.append((key[0], "mark", c.day, None, None, None, c.id, int(c.ts_ms), None, c.feedback, bool(c.edited)))
            else:
                own = days.setdefault(c.day, [])
                own.append((c.day, c.id, int(c.ts_ms), c.payload, c.feedback, bool(c.edited)))
                if len(own) >= self.size:
                    out += self._batch(key, c.day, days.pop(c.day), "full", numbers)
        self._remember(numbers)
        left = [r for own in days.values() for r in own]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if left:
            self.kept.put(left)
            self.handle.registerTimer(int(calls[-1].arrived_ms) + self.wait_ms)
        else:
            self.kept.clear()
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        days: dict[str, list[tuple]] = {}
        for r in self.kept.get() if self.kept.exists() else ():
            days.setdefault(r[0], []).append(tuple(r))
        self.kept.clear()
        numbers: dict[str, int] = {}
        out = self._flushed(key, days, "silence", numbers)
        self._remember(numbers)
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in WRITTEN.split(", ")]
        frame = pd.DataFrame(rows, columns=names)
        return frame.astype({"batch_no": "Int64", "position": "Int64", "ts": "Int64", "edited": "boolean"})

    def close(self) -> None:
        pass


def buffered(calls: DataFrame, size: int = BATCH_SIZE, wait: str = "1 minute") -> DataFrame:
    """Streaming records and marks (columns of `WRITTEN`) of a stream of calls on sessions.

    A call is (session_id, kind, id, ts, payload, feedback, edited): kind `record` buffers one, `mark` puts feedback on
    the record with its id if that is still buffered and comes out as a mark if not, `close` lets out what is
    buffered. A batch is `size` records of one session and day, or the rest after `wait` without a call. The calls
    of a session in one micro-batch go by time, then `seq` if there is such a column, then id. The waiting goes by the
    time of arrival, which the watermark follows, so no call is ever late: a silence shows once later calls, of any
    session, have arrived. Rows without session, kind or time are left out.
    """
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    ts = F.col("ts").cast("timestamp")
    named = calls.filter("session_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL").select(
        F.col("session_id").cast("string").alias("session_id"), "kind", F.col("id").cast("string").alias("id"), F.unix_millis(ts).alias("ts_ms"), F.date_format(ts, "yyyy-MM-dd").alias("day"),
        F.col("payload").cast("string").alias("payload"), F.col("feedback").cast("string").alias("feedback"), F.coalesce(F.col("edited").cast("boolean"), F.lit(False)).alias("edited"),
        (F.col("seq").cast("long") if "seq" in calls.columns else F.lit(0).cast("long")).alias("seq"),
    )
    arrived = named.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds").withColumn("arrived_ms", F.unix_millis("arrived"))
    return arrived.groupBy("session_id").transformWithStateInPandas(Buffer(size, wait_ms), outputStructType=WRITTEN, outputMode="Append", timeMode="EventTime")


def write_buffered(calls: DataFrame, folder: str, size: int = BATCH_SIZE, wait: str = "1 minute", name: str = "interactions") -> None:
    """Works off what a stream of calls has at present into `folder`: records by day, and marks in a sidecar.

    Each micro-batch is committed once, so a replayed one writes nothing twice. Read with `sink.committed(spark,
    f"{folder}/{name}", WRITTEN)`.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        commit_once(batch, batch_id, f"{folder}/{name}", ("kind", "day"))

    run_available(buffered(calls, size, wait), folder, name, each)
