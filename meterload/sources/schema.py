"""Declared schemas of every file the engine reads or writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

from meterload.config import Config


def readings_schema(cfg: Config) -> T.StructType:
    """Raw readings: the id and the time as text, one double per sensor."""
    fields = [T.StructField("dataid", T.IntegerType()), T.StructField(cfg.time_column, T.StringType())]
    return T.StructType(fields + [T.StructField(s, T.DoubleType()) for s in cfg.sensors])


def source_metadata_schema(extra: Sequence[str] = ()) -> T.StructType:
    """Household metadata as delivered. The id stays text, so that the descriptor row parses."""
    return T.StructType([T.StructField(c, T.StringType()) for c in ("dataid", "city", "state", *extra)])


def profile_csv_schema(cfg: Config, prefix: str, extra: Sequence[str] = ()) -> T.StructType:
    """Generated metadata as written to CSV: ratios and flags are display text."""
    text = ["city", "state", *extra, f"{prefix}min_time", f"{prefix}max_time",
            f"{prefix}data_availability", "aggregation_abs_error_max", "aggregation_abs_error_mean"]
    fields = [T.StructField("dataid", T.IntegerType())]
    fields += [T.StructField(c, T.StringType()) for c in [*text, *cfg.sensors]]
    fields += [T.StructField("delta_year", T.IntegerType()), T.StructField("community", T.IntegerType())]
    return T.StructType(fields)


TRAINING_LOG = T.StructType([
    T.StructField("epoch", T.IntegerType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("root_mean_squared_error", T.DoubleType()),
])

EVALUATION = T.StructType([
    T.StructField("mae", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()),
])
