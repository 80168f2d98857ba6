"""Co-moment states against numpy: merging, taking out, weights, fits and errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterload.operators import moments

SCHEMA = "g string, part int, w int, y double, a double, b double, c double"
NAMES = ["y", "a", "b", "c"]


def table(seed, n=200):
    rng = np.random.default_rng(seed)
    x = rng.normal(1e4, 3, (n, 3))
    y = 5 + x @ [2.0, -1.0, 0.5] + rng.normal(0, 0.1, n)
    return [(f"g{i % 3}", int(i % 4), int(i % 2 + 1), float(y[i]), *map(float, x[i])) for i in range(n)]


def arrays(rows):
    return np.array([r[3:] for r in rows])


def check(state, values):
    centred = values - values.mean(axis=0)
    assert state.n == len(values)
    np.testing.assert_allclose(state.mean, values.mean(axis=0), rtol=1e-12)
    np.testing.assert_allclose(np.array(state.cross), centred.T @ centred, rtol=1e-8, atol=1e-7)


def test_states_merge_and_come_apart(spark):
    rows = table(1)
    df = spark.createDataFrame(rows, SCHEMA)
    parts = df.groupBy("g", "part").agg(moments.moments(NAMES).alias("s"))
    states = parts.groupBy("g").agg(F.collect_list("s").alias("all"), F.min_by("s", "part").alias("first"))
    out = states.select("g", moments.merged_all(F.col("all"), 4).alias("whole"), "first")
    out = out.withColumn("rest", moments.without(F.col("whole"), F.col("first")))
    for r in out.collect():
        check(r.whole, arrays([x for x in rows if x[0] == r.g]))
        check(r.rest, arrays([x for x in rows if x[0] == r.g and x[1] != 0]))


def test_weights_count_rows_several_times(spark):
    rows = table(2)
    df = spark.createDataFrame(rows, SCHEMA)
    by_weight = df.groupBy("w").agg(moments.moments(NAMES).alias("s"))
    states = by_weight.select(moments.weighted(F.col("s"), F.col("w").cast("double")).alias("s")).agg(F.collect_list("s").alias("all"))
    whole = states.select(moments.merged_all(F.col("all"), 4).alias("s")).first().s
    check(whole, arrays([x for x in rows for _ in range(x[2])]))


@pytest.mark.parametrize("inputs", [[1], [1, 2], [3, 1, 2], []])
def test_lines_and_errors(spark, inputs):
    rows = table(3)
    df = spark.createDataFrame(rows, SCHEMA).agg(moments.moments(NAMES).alias("s"))
    fit = df.select("s", moments.line(F.col("s"), 0, inputs).alias("f"))
    r = fit.select("f", moments.squared_error(F.col("s"), 0, inputs, F.col("f.intercept"), F.col("f.weights")).alias("mse")).first()
    values = arrays(rows)
    design = np.column_stack([np.ones(len(values)), values[:, inputs]])
    want, *_ = np.linalg.lstsq(design, values[:, 0], rcond=None)
    np.testing.assert_allclose([r.f.intercept, *r.f.weights], want, rtol=1e-6)
    np.testing.assert_allclose(r.mse, ((values[:, 0] - design @ want) ** 2).mean(), rtol=1e-6)


def test_constant_and_repeated_columns_get_no_weight(spark):
    rows = [("g", 0, 1, 2.0 * i + 1, float(i), 7.0, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA).agg(moments.moments(NAMES).alias("s"))
    r = df.select(moments.line(F.col("s"), 0, [1, 2, 3]).alias("f")).first().f
    np.testing.assert_allclose([r.intercept, *r.weights], [1, 2, 0, 0], atol=1e-9)


def test_no_rows_and_nulls(spark):
    df = spark.createDataFrame([("g", 0, 1, None, 1.0, 1.0, 1.0)], SCHEMA)
    r = df.agg(moments.moments(NAMES).alias("s")).select("s", moments.line(F.col("s"), 0, [1]).alias("f"), moments.squared_error(
        F.col("s"), 0, [1], F.lit(0.0), F.array(F.lit(0.0))).alias("e")).first()
    assert r.s.n == 0 and r.f.weights == [0.0] and r.e is None
    both = df.agg(moments.moments(NAMES).alias("s")).select(
        moments.merged(F.col("s"), F.col("s")).alias("m"), moments.without(F.col("s"), F.col("s")).alias("w")).first()
    assert both.m.n == both.w.n == 0
