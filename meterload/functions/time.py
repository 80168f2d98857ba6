"""Time expressions. Tables hold zone-free timestamps that mean UTC, so no result depends on the
session time zone."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterload.config import Config

_ZONE = r"\d{2}:\d{2}.*([zZ]|[+-]\d{2}(:?\d{2})?)$"


def ntz(moment: datetime) -> Column:
    return F.expr(f"timestamp_ntz'{moment:%Y-%m-%d %H:%M:%S.%f}'")


def _add_seconds(start: Column, seconds: Column) -> Column:
    zero = F.lit(0)
    return start + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def utc_ntz(instant: Column) -> Column:
    """UTC wall clock of a zoned timestamp, whatever the session time zone is."""
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    return _add_seconds(ntz(datetime(1970, 1, 1)), seconds)


def parse_utc(text: Column) -> Column:
    """Parse timestamp text with an offset; text without one is taken as UTC."""
    zoned = F.when(text.rlike(_ZONE), text).otherwise(F.concat(text, F.lit("Z")))
    return utc_ntz(F.to_timestamp(zoned))


def add_years(ts: Column, years: Column) -> Column:
    """Calendar-year shift; 29 February moves to the 28th in common years."""
    return ts + F.make_ym_interval(years, F.lit(0))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with fraction as DOUBLE, between zone-free timestamps. Each of them is read once: where `end` is itself
    computed, as a grid time is, the expression would otherwise grow with every field."""
    return (end - start).cast("interval second").cast("decimal(18,6)").cast("double")


def in_window(ts: Column, cfg: Config) -> Column:
    """Plain range predicate that a columnar scan can use to skip row groups."""
    end = cfg.from_time + timedelta(seconds=cfg.n_steps * cfg.step_seconds)
    return (ts >= ntz(cfg.from_time)) & (ts < ntz(end))


def slot_index(ts: Column, cfg: Config) -> Column:
    """1-based index of the grid slot a timestamp falls into (for data finer than the grid)."""
    offset = seconds_between(ntz(cfg.from_time), ts)
    return F.when(in_window(ts, cfg), (F.floor(offset / cfg.step_seconds) + 1).cast("int"))


def grid_index(ts: Column, cfg: Config) -> Column:
    """1-based grid index of a timestamp that lies exactly on the grid, else NULL."""
    offset = seconds_between(ntz(cfg.from_time), ts)
    return F.when(offset % cfg.step_seconds == 0, slot_index(ts, cfg))


def grid_time(index: Column, cfg: Config) -> Column:
    """Timestamp of a grid index."""
    return ntz(cfg.from_time) + F.expr(f"interval '{cfg.step_seconds}' second") * (index.cast("bigint") - 1)
