"""Watches a folder of session files: each file is read once, pairs are kept, and files that fail are set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.turns import accepted_pairs
from skein.sources.lake import messages_of
from skein.streaming.outcomes import run_available
from skein.streaming.sink import commit_once, committed

#: What is noted of each file, and the pairs of good ones.
MARKER = "file_key string, status string, reason string, records long, pairs long"
PAIRS = "file_key string, pair_id string, turn long, category string, score double"


def file_key(path: str = "file"):
    """Folder and name, by which a file is known."""
    return F.concat_ws("/", F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -1))


def session_records(files: DataFrame) -> DataFrame:
    """(file, ord, record) of the lines of files (path, content) that are JSON objects."""
    text = files.select(F.col("path").alias("file"), F.col("content").cast("string").alias("t"))
    lines = text.select("file", F.posexplode(F.split("t", "\n")).alias("ord", "record"))
    return lines.filter(F.try_variant_get(F.try_parse_json("record"), "$", "map<string,variant>").isNotNull())


def judged(files: DataFrame, least: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """(marker rows, pairs) of files (path, content).

    A file fails if its bytes are no UTF-8, or if it has lines but none is a JSON object; an empty one is good.
    """
    keyed = files.select("path", "content", file_key("path").alias("file_key"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"))
    good = keyed.filter("valid")
    records = session_records(good)
    messages = messages_of(records).select(file_key("file").alias("conv_id"), F.col("ord").cast("long").alias("turn"), "role", "text")
    pairs = accepted_pairs(messages, least=least).select(F.col("conv_id").alias("file_key"), "pair_id", "turn", "category", "score")
    counts = records.groupBy(file_key("file").alias("file_key")).agg(F.count("*").alias("records"))
    found = pairs.groupBy("file_key").agg(F.count("*").alias("pairs"))
    every = keyed.select("file_key", "valid", (F.regexp_replace(F.col("content").cast("string"), r"\s+", "") == "").alias("empty")).join(counts, "file_key", "left").join(found, "file_key", "left")
    reason = F.when(~F.col("valid"), "no UTF-8").when(F.col("records").isNull() & ~F.col("empty"), "no JSON object")
    marker = every.select(
        "file_key", F.when(reason.isNull(), "done").otherwise("failed").alias("status"), reason.alias("reason"),
        F.coalesce("records", F.lit(0)).cast("long").alias("records"), F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"),
    )
    return marker, pairs


def watch_sessions(spark: SparkSession, root: str, folder: str, least: float = 0.4, name: str = "watch", glob: str = "*") -> None:
    """Works off the files under `root` whose key the marker in `folder` doesn't have.

    A key is noted once, with its first version, whatever came of it: lines that are appended later are not read, and a
    file that fails is set aside and stops nothing. Marker and pairs are committed by micro-batch, so one that
    is replayed writes nothing twice. Files of no bytes are not seen by the source. Call again, or from a loop or a schedule, to go on from the checkpoint.
    """
    # A file source finds files by path; the marker, by key, also holds files that came back under another root.
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)

    def each(batch: DataFrame, batch_id: int) -> None:
        known = committed(spark, f"{folder}/{name}-marker", MARKER).select("file_key")
        fresh = batch.withColumn("file_key", file_key("path")).join(known, "file_key", "left_anti")
        marker, pairs = judged(fresh.groupBy("file_key").agg(F.min_by("path", "path").alias("path"), F.min_by("content", "path").alias("content")).select("path", "content"), least)
        # The marker comes last: a crash before it repeats the pairs' commit, which is then found and left alone.
        commit_once(pairs, batch_id, f"{folder}/{name}-pairs")
        commit_once(marker, batch_id, f"{folder}/{name}-marker")

    run_available(stream.select("path", "content"), folder, name, each)


def watched(spark: SparkSession, folder: str, name: str = "watch") -> tuple[DataFrame, DataFrame]:
    """(marker, pairs) of all that was worked off so far."""
    return committed(spark, f"{folder}/{name}-marker", MARKER), committed(spark, f"{folder}/{name}-pairs", PAIRS)
