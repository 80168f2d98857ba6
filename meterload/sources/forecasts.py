"""Forecast store and the text-matrix exchange format.

Forecasts live in one Parquet table partitioned by (base_level, level): one row per entity and
window with the horizon as an array. Text matrices (one file per entity, one line per window) can
be read into it and written from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_forecasts(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Written by the tasks that make the rows: those come out of a shuffle by entity, which sized the tasks."""
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("base_level", "level").parquet(path))


def read_forecasts(
    spark: SparkSession, path: str, base_level: str | None = None, level: str | None = None
) -> DataFrame:
    df = spark.read.parquet(path)
    if base_level is not None:
        df = df.where(F.col("base_level") == base_level)
    if level is not None:
        df = df.where(F.col("level") == level)
    return df


def long_form(df: DataFrame, value: str, alias: str, keys: Sequence[str]) -> DataFrame:
    """(keys, win, h, value) from an array column; h counts from 0."""
    return df.select(*keys, "win", F.posexplode(value).alias("h", alias))


def write_matrix(df: DataFrame, path: str, keys: Sequence[str], value: str = "y_hat") -> None:
    """Text matrices: a line of space-separated numbers per window, a directory per entity."""
    line = F.array_join(F.transform(F.col(value), lambda v: F.format_string("%.18e", v)), " ")
    rows = df.select(*keys, "win", line.alias("line"))
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "win")
    ordered.drop("win").write.mode("overwrite").partitionBy(*keys).text(path)


def read_matrix(
    spark: SparkSession, path: str | Sequence[str], keys: Sequence[str], first_window: int,
    value: str = "y_hat",
) -> DataFrame:
    """Text matrices as (keys, win, value); keys come from `key=value` path segments.

    A file holds the windows of one entity in order, so its size is bounded by the test period
    and it is read whole to keep the line numbers.
    """
    files = spark.read.text(path, wholetext=True)
    location = F.col("_metadata.file_path")
    key_columns = [
        F.url_decode(F.regexp_extract(location, f"{key}=([^/]+)", 1)).alias(key) for key in keys
    ]
    lines = files.select(
        *key_columns, F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("pos", "line")
    )
    numbers = F.transform(F.split("line", " "), lambda v: v.cast("double"))
    return lines.select(
        *keys, (F.col("pos") + F.lit(first_window)).cast("int").alias("win"), numbers.alias(value)
    )
