"""Z-scores of values and min-max scaling of calendar features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterload.config import FEATURES, Config
from meterload.functions.features import scale_calendar


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with a struct column: mean and sample deviation of each column."""
    parts = [F.avg(c).alias(f"{c}_mean") for c in columns]
    parts += [F.stddev_samp(c).alias(f"{c}_std") for c in columns]
    return df.agg(F.struct(*parts).alias("stats"))


def zscore(df: DataFrame, columns: Sequence[str], fit_until: int | None = None) -> DataFrame:
    """Replace columns by their z-scores; NULL where the deviation is 0.

    Statistics come from all rows, or from rows with index <= `fit_until`. They are a scalar
    subquery of one row, so the table is neither joined nor shuffled.
    """
    fit = df if fit_until is None else df.where(F.col("index") <= fit_until)
    stats = column_statistics(fit, columns).scalar()
    scored = df.withColumn("_stats", stats)
    values = {
        c: F.try_divide(F.col(c) - F.col(f"_stats.{c}_mean"), F.col(f"_stats.{c}_std")) for c in columns
    }
    return scored.withColumns(values).drop("_stats")


def normalize_level(
    df: DataFrame, level: str, cfg: Config, fit_until: int | None = None,
    zero_based_weekday: bool = False,
) -> DataFrame:
    """Normalised copy of a level table: z-scored values, scaled calendar features."""
    columns = list(cfg.appliances) if level == "appliance" else ["total"]
    scored = zscore(df, columns, fit_until)
    return scale_calendar(scored, zero_based_weekday) if set(FEATURES) <= set(df.columns) else scored
