"""Cross-validation of lag models without refitting: folds are co-moment states that come off their total.

One pass over the lagged rows gives a state per entity and fold. The fit that leaves a fold out is solved from the total
less that fold's state, and its error on the fold follows from the fold's state too, because a squared error is a
quadratic form of co-moments. So any number of candidates costs no further pass over the data.

A target counts as often as windows of its fold contain it, as if all windows were cut and stacked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterload.config import Config
from meterload.operators.forecast import lagged_table, training_targets
from meterload.operators.moments import line, merged_all, moments, squared_error, weighted, without
from meterload.operators.splits import fold_bounds


@dataclass(frozen=True)
class LagModel:
    """A candidate: the sum of weighted lags. `fitted`: least squares; else the mean of the lags, without intercept."""

    lags: tuple[int, ...]
    fitted: bool = True

    @property
    def name(self) -> str:
        return "_".join(["regression" if self.fitted else "naive", *map(str, self.lags)])


def fold_and_weight(index: Column, cfg: Config, folds: int | None = None) -> tuple[Column, Column]:
    """The fold whose windows have a grid index among their outputs (NULL: none), and how many of them do."""
    fold, weight = F.lit(None).cast("int"), F.lit(None).cast("double")
    for i, (first, last) in enumerate(fold_bounds(cfg, folds)):
        low = F.greatest(index - cfg.span + 1, F.lit(first))
        high = F.least(index - cfg.input_size, F.lit(last))
        fold = F.when(low <= high, F.lit(i)).otherwise(fold)
        weight = F.when(low <= high, (high - low + 1).cast("double")).otherwise(weight)
    return fold, weight


def fold_states(
    series: DataFrame, keys: Sequence[str], target: str, lags: Sequence[int], cfg: Config, folds: int | None = None,
) -> DataFrame:
    """(keys, fold, state): co-moments of the target and its lags, in that order, over each fold's windows.

    Rows are summed by weight first, at most `output_size` weights per fold, and these few states are merged.
    """
    table, names = lagged_table(series, keys, target, lags, *training_targets(cfg))
    fold, weight = fold_and_weight(F.col("index"), cfg, folds)
    columns = ["y", *names]
    rows = table.select(*keys, *columns, fold.alias("fold"), weight.alias("_weight")).where("fold IS NOT NULL")
    by_weight = rows.groupBy(*keys, "fold", "_weight").agg(moments(columns).alias("_state"))
    counted = by_weight.select(*keys, "fold", weighted(F.col("_state"), F.col("_weight")).alias("_state"))
    few = counted.groupBy(*keys, "fold").agg(F.collect_list("_state").alias("_states"))
    return few.select(*keys, "fold", merged_all(F.col("_states"), len(columns)).alias("state"))


def kfold_scores(
    series: DataFrame, keys: Sequence[str], target: str, candidates: Sequence[LagModel], cfg: Config,
    folds: int | None = None,
) -> DataFrame:
    """(keys, fold, candidate, rmse): the error on each fold's windows of each candidate, fitted on all other folds."""
    lags = sorted({lag for m in candidates for lag in m.lags})
    states = fold_states(series, keys, target, lags, cfg, folds)
    gathered = states.groupBy(*keys).agg(F.collect_list(F.struct("fold", "state")).alias("_folds"))
    whole = merged_all(F.col("_folds.state"), len(lags) + 1)
    each = gathered.select(*keys, whole.alias("_whole"), F.inline("_folds"))
    rest = each.select(*keys, "fold", "state", without(F.col("_whole"), F.col("state")).alias("_rest"))
    places = {m: [lags.index(lag) + 1 for lag in m.lags] for m in candidates}
    fits = {
        m: line(F.col("_rest"), 0, places[m]) if m.fitted else F.struct(
            F.lit(0.0).alias("intercept"), F.array(*[F.lit(1.0 / len(m.lags))] * len(m.lags)).alias("weights"))
        for m in candidates
    }
    fitted = rest.select(*keys, "fold", "state", *[fits[m].alias(f"_fit_{m.name}") for m in candidates])
    scores = F.array(*[
        F.struct(F.lit(m.name).alias("candidate"), F.sqrt(squared_error(
            F.col("state"), 0, places[m], F.col(f"_fit_{m.name}.intercept"), F.col(f"_fit_{m.name}.weights"))).alias("rmse"))
        for m in candidates])
    return fitted.select(*keys, "fold", F.inline(scores))


def best_over_folds(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, candidate, rmse): the smallest mean error over folds; ties go to the smaller name."""
    means = scores.groupBy(*keys, "candidate").agg(F.avg("rmse").alias("rmse"))
    best = means.groupBy(*keys).agg(F.min(F.struct("rmse", "candidate")).alias("_best"))
    return best.select(*keys, "_best.candidate", "_best.rmse")
