"""A folder that takes each batch of a stream once, whatever is replayed after a crash."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_ENTRY = "batch_id long, folder string, rows long"


def _entry(spark: SparkSession, path: str, batch_id: int) -> list:
    try:
        return spark.read.schema(_ENTRY).json(f"{path}/manifest/{batch_id:012d}").collect()
    except AnalysisException:
        return []


def commit_once(rows: DataFrame, batch_id: int, path: str, partitions: tuple[str, ...] = ()) -> bool:
    """Writes `rows` as the batch of this number, unless it is there already; says whether it wrote.

    The rows go to a folder of their own, and only then a manifest entry names that folder. A crash before the entry
    leaves a folder that nobody reads; a replay after it finds the entry and writes nothing.
    """
    spark = rows.sparkSession
    if _entry(spark, path, batch_id):
        return False
    folder = f"data/batch_id={batch_id}/attempt={uuid.uuid4().hex}"
    writer = rows.write.partitionBy(*partitions) if partitions else rows.write
    writer.json(f"{path}/{folder}")
    count = spark.read.schema(rows.schema).json(f"{path}/{folder}").count()
    entry = spark.createDataFrame([(batch_id, folder, count)], _ENTRY)
    entry.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{batch_id:012d}")
    return True


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that were committed, with `batch_id`; an empty table where there are none."""
    try:
        entries = spark.read.schema(_ENTRY).option("recursiveFileLookup", True).json(f"{path}/manifest")
        folders = [(r["batch_id"], r["folder"]) for r in entries.filter("rows > 0").toLocalIterator()]
    except AnalysisException:
        folders = []
    if not folders:
        return spark.createDataFrame([], f"{schema}, batch_id long")
    full = f"{schema}, batch_id long"
    read = spark.read.schema(full).option("basePath", f"{path}/data").json([f"{path}/{f}" for _, f in folders])
    return read.select(*spark.createDataFrame([], full).columns)
