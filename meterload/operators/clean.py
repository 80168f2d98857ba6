"""Outlier removal and bounded forward fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterload.config import Config
from meterload.functions.features import add_calendar
from meterload.functions.rows import row_statistics, row_std, smallest_row_for
from meterload.functions.time import grid_time
from meterload.operators.grid import align_readings, one_per_slot


def without_nan(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """NaN means a missing reading, as NULL does."""
    return df.withColumns({s: F.nanvl(s, F.lit(None).cast("double")) for s in sensors})


def mask_row_zscore(df: DataFrame, sensors: Sequence[str], z_limit: float) -> DataFrame:
    """Null values further than `z_limit` sample deviations from the mean of their row.

    Rows too short to hold such a value skip the second pass.
    """
    df = without_nan(df, sensors)
    stats = df.withColumn("_row", row_statistics(sensors))
    std = F.when(F.col("_row.n") >= smallest_row_for(z_limit), row_std(F.col("_row")))
    scored = stats.withColumn("_std", std).withColumn("_mean", F.col("_row.mean"))
    z = {s: F.abs(F.try_divide(F.col(s) - F.col("_mean"), F.col("_std"))) for s in sensors}
    masked = {s: F.when(F.coalesce(z[s] > z_limit, F.lit(False)), None).otherwise(F.col(s)) for s in sensors}
    return scored.withColumns(masked).drop("_row", "_std", "_mean")


def mask_limit(df: DataFrame, sensors: Sequence[str], limit: float) -> DataFrame:
    """Null values whose magnitude exceeds a fixed limit."""
    return df.withColumns({s: F.when(F.abs(F.col(s)) <= limit, F.col(s)) for s in sensors})


def mask_outliers(df: DataFrame, sensors: Sequence[str], cfg: Config) -> DataFrame:
    if cfg.outliers is None:
        return df
    if cfg.outliers == "row_zscore":
        if len(sensors) < smallest_row_for(cfg.z_limit):
            return df
        return mask_row_zscore(df, sensors, cfg.z_limit)
    if cfg.outliers == "abs_limit":
        return mask_limit(df, sensors, cfg.value_limit)
    raise ValueError(f"unknown outlier rule {cfg.outliers!r}")


def _block(index: Column, rows: int) -> Column:
    return F.floor((index - 1) / rows).cast("int")


def bounded_fill(df: DataFrame, sensors: Sequence[str], cfg: Config) -> DataFrame:
    """Carry the last value forward over at most `cfg.fill_rows` rows, then use 0.

    Expects one row per household and grid index. A grid longer than `cfg.block_rows` is cut into
    blocks; the rows before a block boundary are copied into the next block, so blocks of one
    household are filled by different tasks.
    """
    keys = ["dataid"]
    blocked = cfg.n_steps > cfg.block_rows
    if blocked:
        if cfg.fill_rows >= cfg.block_rows:
            raise ValueError("fill_rows must be smaller than block_rows")
        home = _block(F.col("index"), cfg.block_rows)
        reach = _block(F.col("index") + cfg.fill_rows, cfg.block_rows)
        df = df.withColumn("_home", home).withColumn("_block", F.explode(F.array_distinct(F.array(home, reach))))
        keys.append("_block")
    frame = Window.partitionBy(*keys).orderBy("index").rowsBetween(-cfg.fill_rows, 0)
    filled = df.select(
        *[c for c in df.columns if c not in sensors],
        *[F.coalesce(F.last(s, ignorenulls=True).over(frame), F.lit(0.0)).alias(s) for s in sensors],
    )
    if blocked:
        filled = filled.where(F.col("_block") == F.col("_home")).drop("_block", "_home")
    return filled


def fill_grid(slots: DataFrame, households: DataFrame, sensors: Sequence[str], cfg: Config) -> DataFrame:
    """Gap exposure and bounded fill in one pass: (dataid, index, sensors) for every grid index.

    Equal to `bounded_fill(expose_gaps(...))` for slots without duplicates, but only present rows
    are shuffled and sorted. Each row finds, per sensor, the last value so far and where it was
    read (a running frame: one update per row); the missing rows up to the next present one are
    then generated in place and use the value while it is at most `cfg.fill_rows` old. One marker row per household and block opens the block, so
    leading gaps and households without readings are generated too.
    """
    blocks = -(-cfg.n_steps // cfg.block_rows)
    rows, reach = cfg.block_rows, cfg.fill_rows
    if blocks > 1 and reach >= rows:
        raise ValueError("fill_rows must be smaller than block_rows")
    known = households.select("dataid").distinct()
    marker = known.selectExpr("dataid", f"explode(sequence(0, {blocks - 1})) AS _block").selectExpr(
        "dataid", f"_block * {rows} AS index", "_block", "true AS _open",
        *[f"CAST(NULL AS DOUBLE) AS {s}" for s in sensors],
    )
    # A row also opens the next block if that block's first rows may still carry its values.
    here, next_ = f"(index - 1) div {rows}", f"(index - 1 + {reach}) div {rows}"
    if blocks > 1:
        homes = f"filter(array_distinct(array({here}, {next_})), b -> b < {blocks})"
        block = f"explode(transform({homes}, b -> CAST(b AS INT)))"
    else:
        block = "0"
    present = slots.selectExpr("dataid", "index", f"{block} AS _block", "false AS _open", *sensors)
    keys = ["dataid", "_block"] if blocks > 1 else ["dataid"]
    run = Window.partitionBy(*keys).orderBy("index")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marker.unionByName(present).select(
        "dataid", "index",
        F.max("_open").over(whole).alias("_known"),
        F.expr(f"_block * {rows} + 1").alias("_first"),
        F.expr(f"least((_block + 1) * {rows}, {cfg.n_steps})").alias("_last"),
        F.lead("index", 1).over(run).alias("_next"),
        *[F.last(s, True).over(so_far).alias(s) for s in sensors],
        *[F.last(F.expr(f"CASE WHEN {s} IS NOT NULL THEN index END"), True).over(so_far).alias(f"_at_{s}") for s in sensors],
    )
    # The last row of an index has seen the others, so it carries the gap that follows.
    seen_at = [f"_at_{s}" for s in sensors]
    gaps = placed.selectExpr(
        "dataid", "_known", "greatest(index, _first) AS _begin", "coalesce(_next - 1, _last) AS _end",
        *sensors, *seen_at,
    ).where("_known AND _end >= _begin")
    grid = gaps.selectExpr("dataid", *sensors, *seen_at, "explode(sequence(_begin, _end)) AS index")
    return grid.selectExpr(
        "dataid", "index", *[f"CASE WHEN index - _at_{s} <= {reach} THEN {s} ELSE 0D END AS {s}" for s in sensors]
    )


def clean_slots(
    readings: DataFrame, households: DataFrame, cfg: Config, sensors: Sequence[str] | None = None
) -> DataFrame:
    """Gap-free, filled grid of aligned readings: duplicates combined, outliers removed."""
    sensors = list(cfg.appliances if sensors is None else sensors)
    slots = one_per_slot(without_nan(readings.select("dataid", "index", *sensors), sensors), cfg)
    return fill_grid(mask_outliers(slots, sensors, cfg), households, sensors, cfg)


def add_time(df: DataFrame, cfg: Config) -> DataFrame:
    """Timestamp and calendar features, computed from the grid index."""
    return add_calendar(df.withColumn(cfg.time_column, grid_time(F.col("index"), cfg)), cfg.time_column)


def process_readings(readings: DataFrame, metadata: DataFrame, cfg: Config) -> DataFrame:
    """Appliance table: aligned, gap-free, cleaned readings with calendar features.

    `metadata` holds `dataid` and `delta_year` (the latter unless `cfg.years` is off). The balance
    sensor is dropped first, so it is neither shuffled nor part of the row statistics.
    """
    return add_time(clean_readings(readings, metadata, cfg), cfg)


def clean_readings(readings: DataFrame, metadata: DataFrame, cfg: Config) -> DataFrame:
    """The appliance table without time and calendar features: (dataid, index, sensors)."""
    work = cfg.with_(sensors=cfg.appliances)
    slots = align_readings(without_nan(readings, work.sensors), metadata, work)
    masked = mask_outliers(slots, work.sensors, work)
    return fill_grid(masked, metadata, work.sensors, work)
