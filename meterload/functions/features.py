"""Calendar features and their min-max scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calendar_columns(ts: Column) -> dict[str, Column]:
    """The seven calendar features of a timestamp."""
    weekday = F.weekday(ts)
    return {
        "dayofyear": F.dayofyear(ts),
        "season": F.quarter(ts),
        "month": F.month(ts),
        "dayofweek": weekday,                                   # Monday is 0
        "hourofday": F.hour(ts),
        "minuteofhour": F.minute(ts),
        "typeofday": F.when(weekday >= 5, F.lit(1)).otherwise(F.lit(-1)),
    }


def add_calendar(df: DataFrame, time_column: str) -> DataFrame:
    return df.withColumns(calendar_columns(F.col(time_column)))


def scaled_columns(zero_based_weekday: bool = False) -> dict[str, Column]:
    """Min-max scaled features; `typeofday` is already -1 or 1.

    The weekday counts from 0 but is scaled like the 1-based features, so it runs from -1/6 to
    5/6; `zero_based_weekday` scales it to 0..1 instead.
    """
    # Fixed values: (lowest value, width of the range) of each feature.
    ranges = {
        "dayofyear": (1, 365),
        "season": (1, 3),
        "month": (1, 11),
        "dayofweek": (0 if zero_based_weekday else 1, 6),
        "hourofday": (0, 23),
        "minuteofhour": (0, 59),
    }
    return {name: (F.col(name) - low) / F.lit(float(width)) for name, (low, width) in ranges.items()}


def scale_calendar(df: DataFrame, zero_based_weekday: bool = False) -> DataFrame:
    return df.withColumns(scaled_columns(zero_based_weekday))
