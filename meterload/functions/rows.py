"""Row-wise arithmetic across sensor columns, with NULL meaning "no reading"."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterload.config import Config


def row_sum(columns: Sequence[str]) -> Column:
    """Sum that skips NULLs; 0 for an empty or all-NULL row."""
    return F.expr(" + ".join(f"coalesce({c}, 0D)" for c in columns) or "0D")


def signed_total(cfg: Config) -> Column:
    """Consumption minus generation of a household; the balance sensor takes no part."""
    return row_sum(cfg.consumers) - row_sum(cfg.active_generators)


def balance_error(cfg: Config) -> Column:
    """|consumption - (generation + grid)|, NULL where the grid sensor has no reading."""
    if cfg.balance_sensor not in cfg.sensors:
        return F.lit(None).cast("double")
    supply = row_sum(cfg.active_generators) + F.col(cfg.balance_sensor)
    return F.when(F.col(cfg.balance_sensor).isNotNull(), F.abs(row_sum(cfg.consumers) - supply))


def row_statistics(columns: Sequence[str]) -> Column:
    """STRUCT<n, mean, std> over the non-NULL columns of a row (sample std, two passes)."""
    values = F.filter(F.array(*columns), lambda v: v.isNotNull())
    n = F.size(values)
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v), n.cast("double"))
    return F.struct(n.alias("n"), mean.alias("mean"), values.alias("values"))


def row_std(stats: Column) -> Column:
    squares = F.aggregate(
        stats["values"], F.lit(0.0), lambda acc, v: acc + (v - stats["mean"]) * (v - stats["mean"])
    )
    return F.sqrt(F.try_divide(squares, (stats["n"] - 1).cast("double")))


def smallest_row_for(z_limit: float) -> int:
    """Fewest values a row needs before any |z| can exceed the limit.

    With n values, |z| is at most (n - 1) / sqrt(n) under the sample standard deviation.
    """
    n = 2
    while (n - 1) / math.sqrt(n) <= z_limit:
        n += 1
    return n
