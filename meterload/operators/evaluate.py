"""Forecast errors per window and entity, and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterload.config import Config
from meterload.functions.arrays import absolute_sum, errors_of, square_sum
from meterload.operators.bottomup import ENTITY_KEYS, PATH_KEYS, bottom_up, tag
from meterload.operators.windows import block_length

ENTITY = ["base_level", "level", "city", "community", "dataid", "sensor"]


def pair_actuals(forecasts: DataFrame, actuals: DataFrame, level: str) -> DataFrame:
    """Join forecasts with the actual outputs of the same entity and window. A forecast without an actual, or
    an actual without a forecast, fails: means over the rest would look like results."""
    keys = [*ENTITY_KEYS[level], "win"]
    known = actuals.select(*keys, "y")
    both = forecasts.withColumn("_forecast", F.lit(True)).join(known.withColumn("_actual", F.lit(True)), keys, "full")
    where = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    missing = F.when(F.col("_actual").isNull(), "no actual for the forecast of ").otherwise("no forecast for the actual of ")
    matched = F.col("_actual").isNotNull() & F.col("_forecast").isNotNull()
    checked = F.when(matched, F.col("y")).otherwise(F.raise_error(F.concat(F.lit(f"{level}: "), missing, where)))
    return both.withColumn("y", checked).drop("_forecast", "_actual")


def block_errors(forecasts: DataFrame, actuals: DataFrame, level: str, cfg: Config) -> DataFrame:
    """(path keys, win, mae, rmse_window, sse): `window_errors(pair_actuals(...))` for actuals that are stored as blocks,
    (entity keys, _first, _last, values).

    Forecasts meet the blocks of their entity, and a window's actual is a slice there, so both sides are shuffled by
    entity alone, actuals without the overlap of windows, and `with_entity_rmse` finds its rows in place. Windows of
    a block without a forecast are found as steps between those that have one, blocks without any by their keys.
    """
    path, win, length = PATH_KEYS[level], F.col("win"), block_length(cfg.output_size)
    several = cfg.last_window - cfg.test_start >= length
    keys = [*ENTITY_KEYS[level], *(["_block"] if several else [])]

    def numbered(rows: DataFrame, at: str) -> DataFrame:
        return rows.withColumn("_block", F.floor((F.col(at) - cfg.test_start) / length)) if several else rows

    def failed(text: str, at: Column) -> Column:
        where = F.concat_ws("/", *[F.col(k).cast("string") for k in ENTITY_KEYS[level]], at.cast("string"))
        return F.raise_error(F.concat(F.lit(f"{level}: {text} "), where)).cast("double")

    own, known = numbered(forecasts.select(*path, "win", "y_hat"), "win"), numbered(actuals, "_first")
    both = own.join(known, keys, "left")
    y = F.slice("values", win - F.col("_first") + 1, F.lit(cfg.output_size))
    errors = window_errors(both.select(*path, "win", "_first", "_last", y.alias("y"), "y_hat"), cfg)
    order = Window.partitionBy(*path, *(["_first"] if several else [])).orderBy("win")
    steps = errors.withColumns({"_before": F.lag("win").over(order), "_after": F.lead("win").over(order)})
    inside = F.coalesce(win.between(F.col("_first"), F.col("_last")), F.lit(False))
    hole = (F.when(win - F.coalesce("_before", F.col("_first") - 1) > 1, win - 1)
            .when(F.col("_after").isNull() & (win < F.col("_last")), win + 1))
    whole = (F.when(~inside, failed("no actual for the forecast of", win))
             .when(hole.isNotNull(), failed("no forecast for the actual of", hole)).otherwise(F.col("sse")))
    found = steps.select(*path, "win", "mae", "rmse_window", whole.alias("sse"))
    bare = known.join(own.select(*keys).distinct(), keys, "left_anti")
    lost = [F.lit(None).cast(t).alias(c) for c, t in found.dtypes if c != "sse"]
    return found.unionByName(bare.select(*lost, failed("no forecast for the actual of", F.col("_first")).alias("sse")))


def window_errors(paired: DataFrame, cfg: Config) -> DataFrame:
    """Replaces y and y_hat by `mae`, `rmse_window` and the sum of squares `sse` of each window."""
    n = F.lit(float(cfg.output_size))
    kept = [c for c in paired.columns if c not in ("y", "y_hat")]
    errors = paired.select(*kept, errors_of(F.col("y"), F.col("y_hat")).alias("_e"))
    sums = errors.select(*kept, absolute_sum(F.col("_e")).alias("_sae"), square_sum(F.col("_e")).alias("sse"))
    return sums.select(*kept, (F.col("_sae") / n).alias("mae"), F.sqrt(F.col("sse") / n).alias("rmse_window"), "sse")


def with_entity_rmse(errors: DataFrame, keys: Sequence[str], cfg: Config) -> DataFrame:
    """Adds `rmse` over all windows and steps of an entity, the same on each of its rows.

    An entity has at most as many rows as there are test windows.
    """
    entity = Window.partitionBy(*keys)
    total = F.sum("sse").over(entity) / (F.count("*").over(entity) * F.lit(float(cfg.output_size)))
    return errors.withColumn("rmse", F.sqrt(total)).drop("sse")


def level_errors(
    forecasts: dict[str, DataFrame], actuals: dict[str, DataFrame], base: str, cfg: Config
) -> DataFrame:
    """Window errors of every level in `forecasts`, in one schema."""
    stacked = None
    for level, df in forecasts.items():
        errors = tag(window_errors(pair_actuals(df, actuals[level], level), cfg), base, level)
        stacked = errors if stacked is None else stacked.unionByName(errors)
    return stacked


def evaluate_base(
    forecasts: DataFrame, base: str, actuals: dict[str, DataFrame], cfg: Config
) -> DataFrame:
    """Window errors of a base level's forecasts at its own and all higher levels.

    The forecasts may come from a model or from a stored table; nothing is predicted here.
    """
    return level_errors(bottom_up(forecasts, base, cfg), actuals, base, cfg)


def evaluation_table(errors: DataFrame, cfg: Config) -> DataFrame:
    """(entity, win, mae, rmse_window, rmse)."""
    return with_entity_rmse(errors, ENTITY, cfg)


def summarize(errors: DataFrame, cfg: Config) -> DataFrame:
    """Mean and sample deviation of mae and rmse per entity.

    Works on window errors: `rmse` is one number per entity, so its mean is that number and its
    deviation is 0 (NULL for a single window); no row has to carry it first.
    """
    n = F.lit(float(cfg.output_size))
    return errors.groupBy(*ENTITY).agg(
        F.avg("mae").alias("mae_mean"),
        F.sqrt(F.sum("sse") / (F.count("*") * n)).alias("rmse_mean"),
        F.stddev_samp("mae").alias("mae_std"),
        F.when(F.count("*") > 1, F.lit(0.0)).alias("rmse_std"),
    )


def summarize_table(evaluation: DataFrame, keys: Sequence[str] = tuple(ENTITY)) -> DataFrame:
    """The same summary from stored rows (mae, rmse), e.g. evaluation files."""
    return evaluation.groupBy(*keys).agg(
        F.avg("mae").alias("mae_mean"), F.avg("rmse").alias("rmse_mean"),
        F.stddev_samp("mae").alias("mae_std"), F.stddev_samp("rmse").alias("rmse_std"),
    )


def level_report(summary: DataFrame) -> DataFrame:
    """Unweighted means of the entity summaries per (base level, level)."""
    columns = ("mae_mean", "rmse_mean", "mae_std", "rmse_std")
    return summary.groupBy("base_level", "level").agg(*[F.avg(c).alias(c) for c in columns])
