"""Fold errors from subtracted states against refits on stacked windows, and successive halving against plain Python."""

import hashlib
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterload.config import Config
from meterload.operators import crossval, forecast, search, splits, windows

START = datetime(2018, 6, 4)
N, I, O = 120, 8, 3
CFG = Config(from_time=START, end_time=START + timedelta(minutes=15 * (N - 1)), input_size=I, output_size=O,
             sensors=("air1", "grid"))


def series(spark, seed=0, entities=("x", "y", "flat")):
    rng = np.random.default_rng(seed)
    data = {e: np.zeros(N) if e == "flat" else np.cumsum(rng.normal(0, 1, N)) + 1e4 for e in entities}
    rows = [(e, i + 1, float(v)) for e, vs in data.items() for i, v in enumerate(vs)]
    return data, spark.createDataFrame(rows, "city string, index int, total double").repartition(3)


def stacked(values, first, last, lags):
    """(targets, lag columns) of all windows of a fold, window by window."""
    at = [w - 1 + I + h for w in range(first, last + 1) for h in range(O)]
    return values[at], np.column_stack([values[[a - lag for a in at]] for lag in lags])


def test_fold_errors_equal_refits(spark):
    data, df = series(spark)
    models = (crossval.LagModel((4,)), crossval.LagModel((3, 7)), crossval.LagModel((3,), False), crossval.LagModel((3, 5), False))
    got = {(r.city, r.fold, r.candidate): r.rmse for r in crossval.kfold_scores(df, ["city"], "total", models, CFG, 4).collect()}
    bounds = splits.fold_bounds(CFG, 4)
    for city, values in data.items():
        for fold, (first, last) in enumerate(bounds):
            for m in models:
                y, x = stacked(values, first, last, m.lags)
                if m.fitted:
                    parts = [stacked(values, *b, m.lags) for i, b in enumerate(bounds) if i != fold]
                    ys, xs = np.concatenate([p[0] for p in parts]), np.vstack([p[1] for p in parts])
                    fit, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(ys)), xs - 1e4]), ys, rcond=None)
                    y_hat = fit[0] + (x - 1e4) @ fit[1:]
                else:
                    y_hat = x.mean(axis=1)
                want = math.sqrt(((y - y_hat) ** 2).mean())
                assert got.pop((city, fold, m.name)) == pytest.approx(want, rel=1e-6, abs=1e-6)
    assert not got
    best = {r.city: r for r in crossval.best_over_folds(
        crossval.kfold_scores(df, ["city"], "total", models, CFG, 4), ["city"]).collect()}
    assert best["flat"].rmse == 0.0 and set(best) == set(data)


def test_one_scan_of_the_series(spark):
    _, df = series(spark)
    plan = crossval.kfold_scores(df, ["city"], "total", (crossval.LagModel((4,)),), CFG)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def rung(win, rungs, factor):
    d = int(hashlib.md5(f"rung:{win}".encode()).hexdigest()[:8], 16)
    return next(r for r in range(rungs) if d % factor ** (rungs - 1 - r) == 0)


@pytest.mark.parametrize("rungs, factor", [(3, 3), (2, 2), (1, 3)])
def test_halving_equals_plain_rungs(spark, rungs, factor):
    data, df = series(spark, 7, ("x", "y", "z"))
    models = [forecast.SeasonalNaive(lag) for lag in range(3, 9)] + [forecast.WindowMean()]

    def held_out(win):
        return win % 2 == 0

    asked = []

    def cut(keep):
        cut = windows.value_windows(df, ["city"], "total", CFG, 1, CFG.last_train_window, keep=keep, mean=True)
        asked.append(cut)
        return cut

    got = {r.city: r for r in search.halve_candidates(cut, ["city"], models, CFG, held_out, rungs, factor).collect()}
    held = [w for w in range(1, CFG.last_train_window + 1) if w % 2 == 0]
    for city, v in data.items():
        def error(m, w):
            at = np.arange(w - 1 + I, w - 1 + I + O)
            hat = v[w - 1: w - 1 + I].mean() if m.name == "window_mean" else v[at - m.lag]
            return np.abs(v[at] - hat).mean()

        left = list(models)
        for r in range(rungs):
            wins = [w for w in held if rung(w, rungs, factor) <= r]
            means = {m: np.mean([error(m, w) for w in wins]) if wins else 0 for m in left}
            keep = max(1, math.ceil(len(models) / factor ** (r + 1))) if r < rungs - 1 else 1
            left = sorted(left, key=lambda m: (means[m], m.name))[:keep]
        assert got[city].candidate == left[0].name
        assert got[city].val_mae == pytest.approx(means[left[0]]) and got[city].n_windows == len(held)
    # Each window is cut in one rung only.
    wins = [r.win for c in asked for r in c.where("city = 'x'").select("win").collect()]
    assert sorted(wins) == held


def test_halving_without_windows_in_a_rung(spark):
    _, df = series(spark, 1, ("x",))
    only = next(w for w in range(1, 50) if rung(w, 3, 3) == 2)
    got = search.halve_candidates(
        lambda keep: windows.value_windows(df, ["city"], "total", CFG, 1, 50, keep=keep), ["city"],
        [forecast.SeasonalNaive(3), forecast.SeasonalNaive(4)], CFG, lambda w: w == only).collect()
    assert [(r.city, r.n_windows) for r in got] == [("x", 1)]


@pytest.mark.parametrize("block", [None, 1, 7, 1000])
def test_window_statistics_equal_numpy(spark, block):
    data, df = series(spark, 3)
    rows = windows.window_statistics(df, ["city"], "total", I, 2, N - I + 1, block).collect()
    assert len(rows) == len(data) * (N - I)
    for r in rows:
        part = data[r.city][r.win - 1: r.win - 1 + I]
        assert (r.mean, r.std) == pytest.approx((part.mean(), part.std(ddof=1)), abs=1e-7)


@pytest.mark.parametrize("block", [None, 5])
def test_means_by_running_sums(spark, block):
    data, df = series(spark, 4)
    cut = windows.value_windows(df, ["city"], "total", CFG, 2, 60, block, part=(0, 0), mean=True).collect()
    assert len(cut) == len(data) * 59
    for r in cut:
        assert r.x == [] and r.x_mean == pytest.approx(data[r.city][r.win - 1: r.win - 1 + I].mean())
