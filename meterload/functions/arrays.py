"""Arithmetic on arrays of one window: error sums and elementwise sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def errors_of(y: Column, y_hat: Column) -> Column:
    return F.zip_with(y, y_hat, lambda a, b: a - b)


def absolute_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.abs(v))


def square_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v)


def array_mean(values: Column, length: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.lit(float(length))


def elementwise_sum(column: str, length: int) -> Column:
    """Grouped sum of equally long arrays, position by position.

    One `sum` per position keeps the map-side combine: a task ships one array per group however
    many children it holds.
    """
    return F.expr("array(" + ", ".join(f"sum({column}[{i}])" for i in range(length)) + ")")
