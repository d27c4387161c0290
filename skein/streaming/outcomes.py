"""Outcome inference and session pairing over streams of conversation turns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from skein.functions.text import overlap, token_set
from skein.operators.turns import outcome_of

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PendingTurn(StatefulProcessor):
    """Keeps the last user turn of a conversation and gives it out together with the one that follows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "turn long, text string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = sorted(((int(t), x) for pdf in rows for t, x in zip(pdf["turn"], pdf["text"], strict=True) if pd.notna(t)), key=lambda r: (r[0], r[1] or ""))
        if self.last.exists():
            new = [tuple(self.last.get()), *new]
        out = [(key[0], int(a[0]), a[1], b[1]) for a, b in zip(new, new[1:], strict=False)]
        if new:
            self.last.update(new[-1])
        yield pd.DataFrame(out, columns=["conv_id", "turn", "text", "next"])

    def close(self) -> None:
        pass


def followed_schema(turns: DataFrame) -> StructType:
    """(conv_id of the input's type, turn, text, next)"""
    return turns.select("conv_id").schema.add("turn", "long").add("text", "string").add("next", "string")


def followed_turns(turns: DataFrame) -> DataFrame:
    """Streaming (conv_id, turn, text, next): user turns that have been followed by another.

    The state of a conversation is its last turn. Turns of one conversation must arrive in order over micro-batches;
    within a batch they are put in order, equal turns by text. A null turn takes no part, a null text stays null.
    """
    asked = turns.filter("role = 'user'").select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    return asked.groupBy("conv_id").transformWithStateInPandas(PendingTurn(), outputStructType=followed_schema(turns), outputMode="Append", timeMode="None")


def run_available(stream: DataFrame, folder: str, name: str, each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Works off what a source has at present, with its checkpoint under `folder`, into Parquet files or `each` batch.

    State with columns of its own needs the RocksDB store, so the session has that while the stream starts.
    """
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKS)
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True)
        query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", f"{folder}/{name}").start()
        query.awaitTermination()
    finally:
        conf.set(_PROVIDER, before)


def stream_outcomes(spark: SparkSession, source: DataFrame, folder: str, same: float, negated: float) -> DataFrame:
    """(conv_id, turn, outcome, reason, overlap) of the turns of a streaming source that were followed by another."""
    name = f"followed-{uuid.uuid4().hex}"
    run_available(followed_turns(source), folder, name)
    found = spark.read.schema(followed_schema(source)).parquet(f"{folder}/{name}")
    scored = found.withColumn("overlap", overlap(token_set(F.col("text")), token_set(F.col("next"))))
    return scored.select("conv_id", "turn", *outcome_of(F.col("next"), F.col("overlap"), same, negated), F.round("overlap", 6).alias("overlap"))


def stream_counts(source: DataFrame) -> DataFrame:
    """Streaming (conv_id, turns, user_turns, last_turn) in complete mode."""
    return source.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max("turn").alias("last_turn"))
