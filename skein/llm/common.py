"""Small helpers shared by the text operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import bounded_batches  # noqa: F401  # the text operators take it from here


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; where none is set, a folder of our own in local mode, else an error."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return configured or sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared checkpoint folder so that later reads don't recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`: the fixed split into training and held-out documents."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def hash_rank(key: Column, seed: int) -> Column:
    """A number from 0 to 2**63 - 1 that depends on the key alone."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 1)


def rank_bound(wanted: int, total: int) -> int:
    """The bound on `hash_rank` under which about `wanted` of `total` keys lie, or all if there are no more."""
    return (1 << 63) - 1 if total <= wanted else ((1 << 63) - 1) * wanted // total


def row_columns(df: DataFrame, inside: str = "") -> list[Column]:
    """The columns of `df`, or those of a struct with them, in a form that can be hashed: maps and variants as JSON."""
    at = (lambda c: F.col(f"{inside}.`{c}`")) if inside else (lambda c: F.col(f"`{c}`"))
    odd = {f.name for f in df.schema if any(t in f.dataType.simpleString() for t in ("map<", "variant"))}
    return [F.to_json(F.struct(at(c).alias("v"))) if c in odd else at(c) for c in df.columns]
