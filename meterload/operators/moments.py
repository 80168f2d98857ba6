"""Least squares from mergeable co-moments.

The state of a group of rows is (n, mean, cross): their number, the mean of each column and the matrix of centred cross
products. Spark's own covariance aggregates build it with map-side combine, so a group of any size arrives as one state
per task. States are then values of one row: `merged` adds two, `without` takes a part out of a whole, `weighted` counts
every row several times, and `line` solves the normal equations of any choice of columns, all in expressions. Nothing is
fitted while a plan is built, and no state passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STATE = "struct<n: double, mean: array<double>, cross: array<array<double>>>"
#: A column of which other columns explain all but this part of the variance adds nothing: coefficient 0.
SINGULAR = 1e-9


def moments(columns: Sequence[str]) -> Column:
    """Aggregate of the rows in which none of the columns is NULL: their state."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    values = [F.when(complete, F.col(c).cast("double")) for c in columns]
    n = F.count_if(complete).cast("double")
    cells = {(i, j): F.coalesce(F.covar_pop(values[i], values[j]) * n, F.lit(0.0))
             for i in range(len(columns)) for j in range(i + 1)}
    cross = [F.array(*[cells[max(i, j), min(i, j)] for j in range(len(columns))]) for i in range(len(columns))]
    mean = [F.coalesce(F.avg(v), F.lit(0.0)) for v in values]
    return _record(n=n, mean=F.array(*mean), cross=F.array(*cross))


def _shifted(cross: Column, delta: Column, weight: Column) -> Column:
    """cross + weight * delta x delta."""
    return F.transform(cross, lambda row, i: F.zip_with(
        row, delta, lambda c, d: c + weight * F.get(delta, i) * d))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value computed once. Plain structs would be inlined into everything that reads one of their fields,
    and expressions of several steps would grow without bound."""
    return F.transform(F.array(value), body)[0]


def _record(**values: Column) -> Column:
    """A struct with explicit names: beside a generator, Spark drops aliases inside lambdas before they name fields."""
    return F.named_struct(*[x for name, value in values.items() for x in (F.lit(name), value)])


def merged(a: Column, b: Column) -> Column:
    """State of the rows of both."""
    def sums(ab: Column) -> Column:
        a, b = ab["a"], ab["b"]
        n = a["n"] + b["n"]
        return _record(
            n=n, share=F.when(n == 0, 0.0).otherwise(b["n"] / n), mean=a["mean"],
            delta=F.zip_with(a["mean"], b["mean"], lambda x, y: y - x),
            cross=F.zip_with(a["cross"], b["cross"], lambda r, s: F.zip_with(r, s, lambda x, y: x + y)))

    return _let(_let(_record(a=a, b=b), sums), lambda v: _record(
        n=v["n"], mean=F.zip_with(v["mean"], v["delta"], lambda m, d: m + v["share"] * d),
        cross=_shifted(v["cross"], v["delta"], v["n"] * v["share"] * (1 - v["share"]))))


def without(whole: Column, part: Column) -> Column:
    """State of the rows of `whole` that are not in `part`, which are some of them."""
    def rest(wp: Column) -> Column:
        w, p = wp["w"], wp["p"]
        n = w["n"] - p["n"]
        return _record(
            n=n, all=w["n"], mean=w["mean"], ratio=F.when(n <= 0, 0.0).otherwise(p["n"] / n),
            delta=F.zip_with(w["mean"], p["mean"], lambda x, y: y - x),
            cross=F.zip_with(w["cross"], p["cross"], lambda r, s: F.zip_with(r, s, lambda x, y: x - y)))

    # The part's mean less the rest's is (whole's n / rest's n) times delta.
    return _let(_let(_record(w=whole, p=part), rest), lambda v: _record(
        n=v["n"], mean=F.zip_with(v["mean"], v["delta"], lambda m, d: m - v["ratio"] * d),
        cross=_shifted(v["cross"], v["delta"], -v["all"] * v["ratio"])))


def weighted(state: Column, weight: Column) -> Column:
    """State of rows that each count `weight` times."""
    return _let(state, lambda s: _record(
        n=s["n"] * weight, mean=s["mean"],
        cross=F.transform(s["cross"], lambda row: F.transform(row, lambda c: c * weight))))


def merged_all(states: Column, size: int) -> Column:
    """State of the rows of all states of an array, for `size` columns."""
    zero = _record(
        n=F.lit(0.0), mean=F.array(*[F.lit(0.0)] * size), cross=F.array(*[F.array(*[F.lit(0.0)] * size)] * size))
    return F.aggregate(states, zero, lambda acc, s: merged(acc, s).cast(STATE))


def line(state: Column, target: int, inputs: Sequence[int]) -> Column:
    """struct(intercept, weights): least squares of one column by others, given by their places in the state.

    The matrix is symmetric and never negative, so it is eliminated along its diagonal (the Cholesky factors without
    their roots). A pivot of no size belongs to a column that those before it explain, or that is constant: weight 0.
    """
    at, size = [*inputs, target], len(inputs)

    def eliminated(done: Column, p: Column) -> Column:
        own = F.get(done["matrix"], p)
        pivot = F.get(own, p)
        scaled = F.transform(own, lambda v: F.when(pivot > F.lit(SINGULAR) * F.get(done["full"], p), v / pivot).otherwise(0.0))
        return _let(_record(done=done, scaled=scaled), lambda v: _record(
            matrix=F.transform(v["done"]["matrix"], lambda row, i: F.when(i == p, v["scaled"]).otherwise(
                F.zip_with(row, v["scaled"], lambda x, s: x - F.get(row, p) * s))),
            full=v["done"]["full"]))

    def weights(s: Column) -> Column:
        if not size:
            return F.array().cast("array<double>")
        rows = F.array(*[F.array(*[s["cross"][i][j] for j in at]) for i in inputs])
        start = _record(matrix=rows, full=F.array(*[s["cross"][i][i] for i in inputs]))
        return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), start, eliminated, lambda done: F.transform(
            done["matrix"], lambda row: F.element_at(row, -1)))

    return _let(_let(state, lambda s: _record(mean=s["mean"], weights=weights(s))), lambda v: _record(
        intercept=v["mean"][target] - sum(
            [F.get(v["weights"], F.lit(k)) * v["mean"][i] for k, i in enumerate(inputs)], F.lit(0.0)),
        weights=v["weights"]))


def squared_error(state: Column, target: int, inputs: Sequence[int], intercept: Column, weights: Column) -> Column:
    """Mean squared error of intercept + weights * inputs over the rows of a state; NULL without rows."""
    def weight(i: int) -> Column:
        return F.get(weights, F.lit(i))

    spread = state["cross"][target][target]
    for k, i in enumerate(inputs):
        spread = spread - 2 * weight(k) * state["cross"][i][target]
        for m, j in enumerate(inputs):
            spread = spread + weight(k) * weight(m) * state["cross"][i][j]
    bias = state["mean"][target] - intercept - sum([weight(k) * state["mean"][i] for k, i in enumerate(inputs)], F.lit(0.0))
    return F.greatest(F.try_divide(spread, state["n"]), F.lit(0.0)) + F.when(state["n"] > 0, bias * bias)
