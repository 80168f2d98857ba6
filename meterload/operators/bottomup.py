"""Bottom-up aggregation of forecasts along the hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterload.config import LEVELS, Config
from meterload.functions.arrays import elementwise_sum

# Columns that name an entity of each level, and those a forecast of the level carries.
ENTITY_KEYS = {
    "appliance": ["dataid", "sensor"],
    "household": ["dataid"],
    "community": ["community"],
    "city": ["city"],
}
PATH_KEYS = {
    "appliance": ["city", "community", "dataid", "sensor"],
    "household": ["city", "community", "dataid"],
    "community": ["city", "community"],
    "city": ["city"],
}


def negate_generators(forecasts: DataFrame, cfg: Config, column: str = "y_hat") -> DataFrame:
    """Flip the sign of generating sensors, so that a plain sum is consumption minus generation."""
    negative = F.transform(column, lambda v: -v)
    signed = F.when(F.col("sensor").isin(list(cfg.generators)), negative).otherwise(F.col(column))
    return forecasts.withColumn(column, signed)


def sum_to_parent(forecasts: DataFrame, parent: str, cfg: Config, column: str = "y_hat") -> DataFrame:
    """Forecasts of a level from those of the level below it."""
    total = elementwise_sum(column, cfg.output_size).alias(column)
    return forecasts.groupBy(*PATH_KEYS[parent], "win").agg(total)


def bottom_up(forecasts: DataFrame, base: str, cfg: Config) -> dict[str, DataFrame]:
    """Forecasts of `base` and of every level above it, each summed from the level below.

    Appliance forecasts are kept positive at their own level and negated for the sums. Each step
    reads the already smaller level below, never the base again.
    """
    levels = {base: forecasts.select(*PATH_KEYS[base], "win", "y_hat")}
    current = negate_generators(levels[base], cfg) if base == "appliance" else levels[base]
    for parent in LEVELS[LEVELS.index(base) + 1:]:
        current = sum_to_parent(current, parent, cfg)
        levels[parent] = current
    return levels


def bottom_up_pairs(paired: DataFrame, base: str, cfg: Config) -> dict[str, DataFrame]:
    """Like `bottom_up` for rows that hold forecast and actual (y_hat, y) side by side.

    Totals of a level are the signed sums of its children, so actuals can be summed along and the
    pairing at higher levels needs no join. Holds when all children of an entity are present.
    """
    levels = {base: paired}
    current = paired
    if base == "appliance":
        current = negate_generators(negate_generators(paired, cfg), cfg, "y")
    for parent in LEVELS[LEVELS.index(base) + 1:]:
        sums = [elementwise_sum(c, cfg.output_size).alias(c) for c in ("y_hat", "y")]
        current = current.groupBy(*PATH_KEYS[parent], "win").agg(*sums)
        levels[parent] = current
    return levels


def tag(df: DataFrame, base: str, level: str) -> DataFrame:
    """One schema for all levels: (base_level, level, city, community, dataid, sensor, win, ...)."""
    types = {"city": "string", "community": "int", "dataid": "bigint", "sensor": "string"}
    keys = [
        (F.col(k) if k in PATH_KEYS[level] else F.lit(None)).cast(t).alias(k) for k, t in types.items()
    ]
    rest = [c for c in df.columns if c not in types]
    return df.select(F.lit(base).alias("base_level"), F.lit(level).alias("level"), *keys, *rest)


def stack_levels(levels: dict[str, DataFrame], base: str) -> DataFrame:
    stacked = None
    for level, df in levels.items():
        tagged = tag(df, base, level)
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    return stacked
