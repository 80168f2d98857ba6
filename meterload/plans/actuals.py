"""Expected outputs of every level over the test windows, stored once for all runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterload.config import LEVELS, Config
from meterload.operators.bottomup import ENTITY_KEYS, PATH_KEYS, tag
from meterload.operators.hierarchy import household_map
from meterload.operators.windows import appliance_blocks, output_blocks, unshifted


def place(df: DataFrame, level: str, metadata: DataFrame) -> DataFrame:
    """Adds the path above an entity; entities outside `metadata` drop out."""
    if level == "city":
        return df.join(metadata.select("city").distinct(), "city", "left_semi")
    key = ENTITY_KEYS[level][0]
    path = [c for c in PATH_KEYS[level] if c != key]
    return df.join(metadata.select(key, *path).distinct(), key)


def level_actuals(
    tables: dict[str, DataFrame], metadata: DataFrame, level: str, cfg: Config
) -> DataFrame:
    """(path keys, _first, _last, values): expected outputs of the test windows _first.._last, a row for each entity and
    block. A window's outputs are a slice of the values, so none is kept as often as windows overlap."""
    first, last = cfg.test_start, cfg.last_window
    if level == "appliance":
        homes, start = household_map(metadata, cfg), cfg.input_size
        return unshifted(appliance_blocks(tables[level], homes, cfg, first + start, last + start, cfg.output_size), start)
    blocks = output_blocks(tables[level], ENTITY_KEYS[level], "total", cfg, first, last)
    return place(blocks, level, metadata).select(*PATH_KEYS[level], "_first", "_last", "values")


def store_actuals(
    tables: dict[str, DataFrame], metadata: DataFrame, path: str, cfg: Config
) -> None:
    """Expected outputs of all levels, shared by every aggregation path and every run. Rows are written by the tasks that
    gather them."""
    for level in LEVELS:
        rows = tag(level_actuals(tables, metadata, level, cfg), level, level).drop("base_level")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("level").parquet(path)


def actuals_of(stored: DataFrame, level: str, metadata: DataFrame, cfg: Config) -> DataFrame:
    """(entity keys, _first, _last, values) of the stored actuals of a level, for the entities that `metadata` knows."""
    rows = stored.where(F.col("level") == level).select(*ENTITY_KEYS[level], "_first", "_last", "values")
    if level == "appliance":
        owned = household_map(metadata, cfg).select(F.col("dataid").cast("bigint").alias("dataid"), F.explode("sensors").alias("sensor"))
        return rows.join(owned, ["dataid", "sensor"], "left_semi")
    key = ENTITY_KEYS[level][0]
    known = metadata.select(F.col(key).cast(rows.schema[key].dataType).alias(key)).distinct()
    return rows.join(known, key, "left_semi")
