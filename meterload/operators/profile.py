"""Quality profile of raw readings: coverage, balance error, sensor presence, year alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterload.config import Config
from meterload.functions.rows import balance_error
from meterload.functions.time import add_years, ntz, seconds_between
from meterload.operators.clean import without_nan


def profile_readings(readings: DataFrame, cfg: Config) -> DataFrame:
    """One row per household: first and last time, availability, balance error, sensor presence.

    Fixed-size aggregates only, so map-side combine reduces a household of any size to one row
    per task before the shuffle.
    """
    ts = F.col(cfg.time_column)
    error = without_nan(readings, cfg.sensors).withColumn("_error", balance_error(cfg))
    grouped = error.groupBy("dataid").agg(
        F.min(ts).alias("min_time"),
        F.max(ts).alias("max_time"),
        F.count(ts).alias("n_readings"),
        F.max("_error").alias("aggregation_abs_error_max"),
        F.avg("_error").alias("aggregation_abs_error_mean"),
        *[F.bool_or(F.col(s).isNotNull()).alias(s) for s in cfg.sensors],
    )
    step = F.lit(float(cfg.step_seconds))
    expected = (seconds_between(F.col("min_time"), F.col("max_time")) + step) / step
    return grouped.select(
        "dataid", "min_time", "max_time", "n_readings",
        F.try_divide(F.col("n_readings").cast("double"), expected).alias("data_availability"),
        "aggregation_abs_error_max", "aggregation_abs_error_mean", *cfg.sensors,
    )


def add_source_metadata(profile: DataFrame, source: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """City, state and extra columns of the delivered metadata; households without any keep NULLs."""
    return profile.join(source.select("dataid", "city", "state", *extra), "dataid", "left")


def align_years(profile: DataFrame, cfg: Config) -> DataFrame:
    """Adds `delta_year` and keeps households that cover the calendar window in some year.

    The shift brings the last reading to or past the end of the window; the first reading must
    then not lie after its start.
    """
    base = F.lit(cfg.end_time.year) - F.year("max_time")
    reaches_end = add_years(F.col("max_time"), base) >= ntz(cfg.end_time)
    shifted = profile.withColumn("delta_year", F.when(reaches_end, base).otherwise(base + 1).cast("int"))
    return shifted.where(add_years(F.col("min_time"), F.col("delta_year")) <= ntz(cfg.from_time))


def _two_decimals(value: Column) -> Column:
    return (F.floor(value * 100) / F.lit(100.0)).cast("string")


def display_profile(profile: DataFrame, cfg: Config, prefix: str = "egauge_1min_") -> DataFrame:
    """The profile as display text: floored percentages and errors, "yes" or "" for presence."""
    percent = F.concat((F.floor(F.col("data_availability") * 10000) / F.lit(100.0)).cast("string"), F.lit("%"))
    formats = {
        "data_availability": percent,
        "aggregation_abs_error_max": _two_decimals(F.col("aggregation_abs_error_max")),
        "aggregation_abs_error_mean": _two_decimals(F.col("aggregation_abs_error_mean")),
        **{s: F.when(F.col(s), "yes").otherwise("") for s in cfg.sensors},
    }
    renamed = {c: f"{prefix}{c}" for c in ("min_time", "max_time", "data_availability")}
    return profile.withColumns(formats).drop("n_readings").withColumnsRenamed(renamed)
