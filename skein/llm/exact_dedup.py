"""Exact duplicate removal by progressive refinement, in DataFrame functions only.

Documents are compared on their text without ASCII white space. Three keys of rising cost refine the groups: the
length of that text; for rows that share it, a hash of its beginning; for rows that share both, SHA-256 of everything.
The first two are counted in aggregations over a fixed number of buckets, and the buckets with several rows are
broadcast as bitmaps of a fixed total size. Buckets decide nothing: a collision costs one extra hash, and groups are
formed on the full hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut_lineage, row_columns

#: Fixed by the contract: the characters that equality ignores.
IGNORED = " \t\n\x0b\x0c\r"
#: Code points of the normalised text that the second key reads, and of the text in which they are looked for first.
PREFIX_POINTS, HEAD_POINTS = 128, 512
#: Buckets of a key; their bitmap is broadcast and takes 8 MB at most, whatever the number of documents.
BUCKETS = 1 << 26


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in IGNORED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _prefix(text: Column) -> Column:
    """The beginning of the normalised text; the whole text is read only if its head is mostly white space."""
    head = normalised(F.substring(text, 1, HEAD_POINTS))
    return F.substring(F.when((F.length(head) >= PREFIX_POINTS) | (F.length(text) <= HEAD_POINTS), head).otherwise(normalised(text)), 1, PREFIX_POINTS)


def bucket(*keys: Column) -> Column:
    """A number from 1 to BUCKETS."""
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) + 1


def _with_part(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.bitmap_bucket_number("bucket"))


def _shared(rows: DataFrame) -> DataFrame:
    """(part, bits): a bitmap of the values of `bucket` that several rows have."""
    return bucket_bitmap(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))


def bucket_bitmap(rows: DataFrame) -> DataFrame:
    """(part, bits): a bitmap of the values of `bucket`."""
    # At most BUCKETS / 32768 rows of 4096 bytes each, so what is broadcast has a proven bound.
    return cut_lineage(rows.groupBy(F.bitmap_bucket_number("bucket").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bucket")).alias("bits")))


def _is_shared() -> Column:
    """Whether the row's bucket is set in the bitmap that it was joined with."""
    at = F.bitmap_bit_position("bucket")
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1, F.lit(False))


def within_buckets(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """The rows whose key's bucket is set in the bitmap."""
    return _with_part(rows.withColumn("bucket", bucket(F.col(key)))).join(F.broadcast(bitmap), "part").filter(_is_shared()).select(*rows.columns)


def _refined(docs: DataFrame, text_col: str, id_col: str, carry: tuple[str, ...] | None = None) -> DataFrame:
    """(doc, id, points, text, survives): whether another row shares the row's length and prefix hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.length(normalised(text))
    lengths = _shared(docs.select(bucket(length).alias("bucket")))
    alike = _with_part(docs.select(text.alias("text"), length.alias("length"), bucket(length).alias("bucket")))
    alike = alike.join(F.broadcast(lengths), "part").filter(_is_shared())
    both = _shared(alike.select(bucket(F.col("length"), _prefix(F.col("text"))).alias("bucket")))
    rows = docs.select(F.struct(*(carry or ["*"])).alias("doc"), F.col(id_col).alias("id"), F.length(text).alias("points"), text.alias("text"), bucket(length, _prefix(text)).alias("bucket"))
    return _with_part(rows).join(F.broadcast(both), "part", "left").select("doc", "id", "points", "text", _is_shared().alias("survives"))


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", digest_all: bool = False, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Adds the decision on each row of `docs` to it: columns (doc, keep_id, group_size, kept, digest).

    `doc` is the input row, or its columns `carry`, as a struct, so no column of the input can clash. With `carry` the
    narrow rows are written down, so that texts are read once for all that follows. Of equal texts the row with the most
    code points stays, then the smallest id (null ids last). A null text counts as empty. Rows that repeat both id
    and text are the same document: every one of them is marked kept, see `drop_exact_copies`. An empty table gives
    an empty table. `digest` is the SHA-256 of the normalised text for rows that reached the last key, for all rows
    with `digest_all`, else null.
    """
    full = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    rows = _refined(docs, text_col, id_col, carry).select(
        "doc",
        "id",
        "points",
        "survives",
        (full if digest_all else F.when(F.col("survives"), full)).alias("digest"),
    )
    # Rows that are alone already get a spread-out key that equals no digest.
    rows = rows.withColumn("key", F.when(F.col("survives"), F.col("digest")).otherwise(F.hex(F.xxhash64("id", "points"))))
    rows = cut_lineage(rows) if carry else rows
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("z"), F.col("id").alias("id")))
    groups = (
        rows.filter("survives")
        .groupBy(F.col("key").alias("group_key"))
        .agg(best.alias("best"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    # Written down, so that the join below is one of two plain shuffles, of which Spark splits a hot group's rows.
    groups = cut_lineage(groups)
    joined = rows.join(groups, F.col("key") == F.col("group_key"), "left")
    alone = F.col("n").isNull()
    return joined.select(
        "doc",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("id").eqNullSafe(F.col("best.id")) & (-F.col("points") == F.col("best.p")))).alias("kept"),
        "digest",
    )


def drop_exact_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, one for each normalised text, with the columns of `docs`.

    Of equal texts the row with the most code points stays, then the smallest id (null ids last), then the one whose
    columns hash lowest. Rows that are alone after the second key never move; of the others each task sends one row
    for each full hash, so a hot group shrinks before the shuffle.
    """
    rows = _refined(docs, text_col, id_col)
    # A struct can't be hashed with a map or a variant in it, so the hash goes by columns.
    rows = rows.select("*", F.xxhash64(*row_columns(docs, "doc")).alias("hash"))
    alone = rows.filter(~F.col("survives")).select("doc.*")
    order = F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("hash").alias("h"))
    hashed = rows.filter("survives").select("doc", order.alias("order"), F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("digest"))
    best = hashed.groupBy("digest").agg(F.min_by("doc", "order").alias("doc"))
    return alone.unionByName(best.select("doc.*"))
