"""Alignment of raw readings to the calendar window and to the regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterload.config import Config
from meterload.functions.time import add_years, grid_index, grid_time, in_window

# Grid rows are generated in runs of this length, so that no generated array grows with the window.
_RUN = 4096


def _explode_index(df: DataFrame, cfg: Config) -> DataFrame:
    n = cfg.n_steps
    runs = df.select("*", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // _RUN))).alias("_run"))
    first = F.col("_run") * _RUN + 1
    last = F.least(F.lit(n), (F.col("_run") + 1) * _RUN)
    return runs.select(*df.columns, F.explode(F.sequence(first, last)).alias("index"))


def time_spine(spark: SparkSession, cfg: Config) -> DataFrame:
    """The regular grid: (time, index), both ends included."""
    spine = _explode_index(spark.range(1).drop("id"), cfg)
    return spine.select(grid_time(F.col("index"), cfg).alias(cfg.time_column), "index")


def household_grid(households: DataFrame, cfg: Config) -> DataFrame:
    """Every grid index of every household: (dataid, index)."""
    return _explode_index(households.select("dataid").distinct(), cfg)


def calendar_slots(readings: DataFrame, cfg: Config) -> DataFrame:
    """(dataid, shift, index, sensors): the grid slot of each reading under every whole-year shift
    that moves it into the calendar window; readings that no shift moves there drop out.

    A window shorter than a year leaves one shift per reading, so this is a filter that needs no
    metadata and runs before any shuffle.
    """
    ts = F.col(cfg.time_column)
    if not cfg.years:
        slots = readings.where(in_window(ts, cfg)).withColumn("index", grid_index(ts, cfg))
        return slots.where("index IS NOT NULL").select("dataid", F.lit(0).alias("shift"), "index", *cfg.sensors)
    years = range(cfg.from_time.year, cfg.end_time.year + 1)
    if len(years) == 1:
        placed = readings.withColumn("shift", F.lit(years[0]) - F.year(ts))
        slots = placed.withColumn("index", grid_index(add_years(ts, F.col("shift")), cfg))
        return slots.where("index IS NOT NULL").select("dataid", "shift", "index", *cfg.sensors)
    shifts = [F.lit(y) - F.year(ts) for y in years]
    slots = [F.struct(k.alias("shift"), grid_index(add_years(ts, k), cfg).alias("index")) for k in shifts]
    landed = F.filter(F.array(*slots), lambda slot: slot["index"].isNotNull())
    return readings.select("dataid", *cfg.sensors, F.inline(landed)).select(
        "dataid", "shift", "index", *cfg.sensors
    )


def align_readings(readings: DataFrame, metadata: DataFrame, cfg: Config) -> DataFrame:
    """Readings of known households on the grid, one row per slot: (dataid, index, sensors).

    Slots are combined before households are looked up: the lookup then sees at most one row per
    slot, whatever share of the raw rows one household holds, and if the metadata is too large to
    broadcast, the shuffle by `dataid` of this join also serves the fill that follows. The shift
    is compared by difference, so that it does not become part of the join key.
    """
    slots = one_per_slot(calendar_slots(readings, cfg), cfg)
    if not cfg.years:
        return slots.drop("shift").join(metadata.select("dataid").distinct(), "dataid", "left_semi")
    known = metadata.select("dataid", "delta_year")
    joined = slots.join(known, "dataid").where(F.col("shift") - F.col("delta_year") == 0)
    return joined.select("dataid", "index", *cfg.sensors)


def one_per_slot(readings: DataFrame, cfg: Config) -> DataFrame:
    """Combine readings of one slot by `cfg.duplicates`; None trusts the source to have no copies.

    Keys are the household and the slot, and map-side combine applies, so a household with many
    copies of its slots arrives as at most one row per slot and task.
    """
    if cfg.duplicates is None:
        return readings
    if cfg.duplicates not in ("avg", "sum", "min", "max"):
        raise ValueError(f"unknown rule for duplicates: {cfg.duplicates!r}")
    keys = [c for c in ("dataid", "shift", "index") if c in readings.columns]
    sensors = [c for c in readings.columns if c not in keys]
    return readings.groupBy(*keys).agg(*[F.expr(f"{cfg.duplicates}({s})").alias(s) for s in sensors])


def expose_gaps(readings: DataFrame, households: DataFrame, cfg: Config) -> DataFrame:
    """One row per household and grid index, NULL where there is no reading: the left join of the
    grid with the readings of each slot, for all households at once."""
    return household_grid(households, cfg).join(one_per_slot(readings, cfg), ["dataid", "index"], "left")
