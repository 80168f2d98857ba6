"""Training curves and load statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterload.config import Config
from meterload.operators.hierarchy import presence


def key_from_path(df: DataFrame, key: str) -> DataFrame:
    """Adds a column with the value of a `key=value` segment of each row's path."""
    return df.withColumn(key, F.regexp_extract("path", rf"{key}=(\w+)", 1))


def curve_by_appliance(logs: DataFrame) -> DataFrame:
    """(appliance, epoch, mae, rmse): mean over households."""
    return logs.groupBy("appliance", "epoch").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"))


def curve_of_appliances(by_appliance: DataFrame) -> DataFrame:
    """(epoch, mae, rmse): unweighted mean of the appliance curves."""
    return by_appliance.groupBy("epoch").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"))


def curve_by_level(logs: DataFrame) -> DataFrame:
    """(level, epoch, mae, rmse): mean over the entities of a level."""
    return logs.groupBy("level", "epoch").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"))


def mean_load(city: DataFrame, counts: DataFrame, cfg: Config) -> DataFrame:
    """(level, mean): mean city load of the test period, divided among the entities of each level.

    `counts` has one row per level, see `entity_counts`.
    """
    base = city.where(F.col("index") >= cfg.test_start).agg(F.avg("total").alias("mean")).scalar()
    cities = counts.where(F.col("level") == "city").select("n").scalar()
    return counts.select("level", (base * cities / F.col("n")).alias("mean"))


def std_of_totals(level_table: DataFrame, key: str, cfg: Config) -> DataFrame:
    """One row: mean over entities of the sample deviation of their test-period load."""
    test = level_table.where(F.col("index") >= cfg.test_start)
    per_entity = test.groupBy(key).agg(F.stddev_samp("total").alias("std"))
    return per_entity.agg(F.avg("std").alias("std"))


def std_of_appliances(appliance: DataFrame, profile: DataFrame, cfg: Config) -> DataFrame:
    """One row: mean over all present appliances of the sample deviation of their test-period load.

    One wide aggregate per household; its single row per household is unpivoted afterwards. The
    sign of a generator does not change its deviation.
    """
    sensors = list(cfg.appliances)
    test = appliance.where(F.col("index") >= cfg.test_start)
    stds = test.groupBy("dataid").agg(*[F.stddev_samp(s).alias(s) for s in sensors])
    long = stds.unpivot("dataid", sensors, "sensor", "std")
    owned = long.join(presence(profile, cfg), ["dataid", "sensor"])
    return owned.agg((F.sum("std") / F.count("*")).alias("std"))


def std_load(
    appliance: DataFrame, tables: dict[str, DataFrame], profile: DataFrame, cfg: Config
) -> DataFrame:
    """(level, std) for all four levels."""
    rows = std_of_appliances(appliance, profile, cfg).select(F.lit("appliance").alias("level"), "std")
    for level, key in (("household", "dataid"), ("community", "community"), ("city", "city")):
        part = std_of_totals(tables[level], key, cfg).select(F.lit(level).alias("level"), "std")
        rows = rows.unionByName(part)
    return rows
