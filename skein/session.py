"""Shared folders of a session, and bounds of its tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; where none is set, a folder of our own in local mode, else an error."""
    import tempfile

    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return configured or sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables and stream state, beside the checkpoints."""
    import uuid

    return f"{ensure_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Lowers the session's bound on an Arrow batch's bytes to `limit`, so that long rows don't pile up in a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > limit:
        spark.conf.set(name, str(limit))


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt evenly over the cores if it has fewer partitions than there are: for work that is long for each row.

    A table of a few large row groups is read by a few tasks; a large one has more partitions than cores and stays.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
