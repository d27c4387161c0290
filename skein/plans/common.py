"""Small helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def rounded(*names: str, places: int = 6) -> list:
    return [F.round(F.col(n), places).alias(n) for n in names]


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")
