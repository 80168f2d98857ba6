"""Candidate search: the forecaster with the smallest validation error, per entity.

`score_candidates` measures every candidate on every validation window. `halve_candidates` spends that budget on
survivors: each rung adds windows and measures only the candidates that are left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterload.config import Config
from meterload.functions.arrays import absolute_sum, errors_of
from meterload.operators.forecast import Forecaster, with_mean
from meterload.sources.tables import stored


def _window_errors(candidates: Sequence[Forecaster], cfg: Config, start: int) -> dict[str, Column]:
    """Mean absolute error of each candidate in a window (x, y)."""
    return {
        m.name: absolute_sum(errors_of(F.col("y"), m.predict(F.col("x"), cfg, start))) / F.lit(float(cfg.output_size))
        for m in candidates
    }


def score_candidates(
    windows: DataFrame, keys: Sequence[str], candidates: Sequence[Forecaster], cfg: Config,
    start: int = 0,
) -> DataFrame:
    """(keys, candidate, val_mae). All candidates are scored in one pass over the validation
    windows (keys, win, x, y); a group keeps one running mean per candidate."""
    errors = _window_errors(candidates, cfg, start)
    names = list(errors)
    scored = with_mean(windows, candidates, cfg).select(*keys, *[e.alias(n) for n, e in errors.items()])
    means = scored.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])
    return means.unpivot(list(keys), names, "candidate", "val_mae")


def best_candidates(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, candidate, val_mae) of the smallest error; ties go to the smaller name."""
    rank = F.struct("val_mae", "candidate")
    best = scores.groupBy(*keys).agg(F.min(rank).alias("_best"))
    return best.select(*keys, "_best.candidate", "_best.val_mae")


def forecast_with_best(
    windows: DataFrame, keys: Sequence[str], best: DataFrame, candidates: Sequence[Forecaster],
    cfg: Config, start: int = 0,
) -> DataFrame:
    """(keys, win, candidate, y_hat[, y]) where each entity uses its winner."""
    chosen = with_mean(windows, candidates, cfg).join(best.select(*keys, "candidate"), list(keys))
    y_hat = F.lit(None).cast("array<double>")
    for m in candidates:
        y_hat = F.when(F.col("candidate") == m.name, m.predict(F.col("x"), cfg, start)).otherwise(y_hat)
    carried = ["y"] if "y" in windows.columns else []
    return chosen.select(*keys, "win", "candidate", y_hat.alias("y_hat"), *carried)


def rung_of(win: Column, rungs: int, factor: int) -> Column:
    """The rung from which on a window is used: a `factor`-th of the windows of each rung is in the one before too.
    Decided per window by an MD5, so that rungs are spread over the year and every task and retry agrees."""
    number = F.conv(F.substring(F.md5(F.concat(F.lit("rung:"), win.cast("string"))), 1, 8), 16, 10).cast("long")
    first = F.lit(rungs - 1)
    for r in range(rungs - 2, -1, -1):
        first = F.when(number % factor ** (rungs - 1 - r) == 0, F.lit(r)).otherwise(first)
    return first


def _of_rung(held_out: Callable[[Column], Column], rung: int, rungs: int, factor: int) -> Callable[[Column], Column]:
    def keep(win: Column) -> Column:
        return held_out(win) & (rung_of(win, rungs, factor) == rung)

    return keep


def halve_candidates(
    cut: Callable[[Callable[[Column], Column]], DataFrame], keys: Sequence[str], candidates: Sequence[Forecaster],
    cfg: Config, held_out: Callable[[Column], Column], rungs: int = 3, factor: int = 3, start: int = 0,
) -> DataFrame:
    """(keys, candidate, val_mae, n_windows) by successive halving over the windows that `held_out` names.

    `cut` gives the validation windows (keys, win, x, y) that a rule on window numbers keeps; it is asked once per rung,
    for the windows that the rung adds. After rung r an entity keeps the best 1 / factor^(r + 1) of all candidates, at
    least one, and after the last rung one; ties go to the smaller name. Errors of survivors are sums over all rungs so
    far, so no window is measured twice. Standings are one row per entity, written between rungs. An entity without
    windows in a rung keeps its candidates; one without any window has no row.
    """
    names = [m.name for m in candidates]
    standing = None
    for r in range(rungs):
        windows = with_mean(cut(_of_rung(held_out, r, rungs, factor)), candidates, cfg)
        if standing is not None:
            windows = windows.join(standing.select(*keys, F.col("survivors").alias("_survivors")), list(keys), "left")
        open_ = F.coalesce("_survivors", F.array(*[F.lit(n) for n in names])) if standing is not None else None
        errors = _window_errors(candidates, cfg, start)
        if open_ is not None:
            errors = {n: F.when(F.array_contains(open_, n), e) for n, e in errors.items()}
        sums = windows.select(*keys, *[e.alias(n) for n, e in errors.items()]).groupBy(*keys).agg(
            F.struct(*[F.sum(n).alias(n) for n in names]).alias("sums"), F.count("*").alias("n"))
        keep = max(1, math.ceil(len(names) / factor ** (r + 1))) if r < rungs - 1 else 1
        standing = stored(_standing(standing, sums, keys, names, keep), "rung")
    best = F.element_at("ranked", 1)
    return standing.where("n > 0").select(
        *keys, best["candidate"].alias("candidate"), best["mae"].alias("val_mae"), F.col("n").alias("n_windows"))


def _standing(before: DataFrame | None, sums: DataFrame, keys: Sequence[str], names: Sequence[str], keep: int) -> DataFrame:
    """(keys, sums, n, ranked, survivors) after a rung: the sums of all rungs, and the `keep` best by their mean."""
    if before is not None:
        new = sums.select(*keys, F.col("sums").alias("_sums"), F.col("n").alias("_n"))
        added = [(F.coalesce(f"sums.{n}", F.lit(0.0)) + F.coalesce(f"_sums.{n}", F.lit(0.0))).alias(n) for n in names]
        sums = before.select(*keys, "sums", "n", "survivors").join(new, list(keys), "full").select(
            *keys, F.struct(*added).alias("sums"), (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"),
            "survivors")
    else:
        sums = sums.withColumn("survivors", F.lit(None).cast("array<string>"))
    left = F.coalesce("survivors", F.array(*[F.lit(n) for n in names]))
    scored = F.array(*[F.struct((F.col(f"sums.{n}") / F.col("n")).alias("mae"), F.lit(n).alias("candidate")) for n in names])
    ranked = F.slice(F.sort_array(F.filter(scored, lambda c: F.array_contains(left, c["candidate"]))), 1, keep)
    return sums.withColumn("ranked", ranked).withColumn(
        "survivors", F.transform("ranked", lambda c: c["candidate"]))
