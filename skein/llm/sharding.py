"""Contiguous shards of nearly equal byte size.

Rows are ordered by id over range partitions. Each partition's byte and row totals are summed, the running sums of
those few totals give every partition its offset, and a row's global byte position decides its shard: the position
range is cut at equal targets. No task sees more than its own partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import cut_lineage

SHARDS = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of `docs`.

    `size` is the text's UTF-8 bytes plus one, so null and empty texts weigh one and CRC-32 0. Shards hold whole
    documents in id order (null ids first; equal ids by size, then checksum); a document goes to the shard in which
    its middle byte falls, so a shard differs from the target by less than its largest border documents. `slot`
    counts a shard's rows from 0 without gaps. An empty table gives an empty table; with fewer documents than
    shards some shards stay empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(1)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # Range borders come from a sample, so the partition number is written down before anything depends on it.
    ranged = cut_lineage(
        narrow.repartitionByRange("doc_id", "size", "text_crc32").withColumn("part", F.spark_partition_id())
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    # One row per partition: a table bounded by the number of tasks.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("byte_offset"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("row_offset"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy("doc_id", "size", "text_crc32")
    running = ranged.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    running = running.withColumn("row", F.row_number().over(inside) - 1)
    placed = running.join(F.broadcast(offsets), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("row_offset") + F.col("row")).alias("row"),
        F.expr(f"least({shards - 1}L, ((2 * (byte_offset + upto) - size) * {shards}L) div (2 * all_bytes))").cast("int").alias("shard"),
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).cast("long").alias("slot")
    )
