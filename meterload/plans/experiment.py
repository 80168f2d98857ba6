"""From level tables to forecasts, evaluation of every aggregation path, and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterload.config import FEATURES, LEVELS, Config
from meterload.operators.bottomup import ENTITY_KEYS, PATH_KEYS, bottom_up, stack_levels, tag
from meterload.operators.evaluate import block_errors, evaluation_table, level_report, summarize_table
from meterload.operators.forecast import (
    EntityRegression,
    Forecaster,
    GlobalRegression,
    LagRegression,
    Model,
    UserModel,
    apply_regression,
    attach_fit,
    fit_appliance_regression,
    fit_lag_regression,
    fit_lines,
    forecast,
    input_part,
    lagged_appliances,
    lagged_table,
    lags_part,
    needs_mean,
    training_targets,
    user_model,
    user_model_by_sensor,
)
from meterload.operators.hierarchy import entity_counts, household_map
from meterload.operators.report import mean_load, std_load
from meterload.operators.search import best_candidates, forecast_with_best, score_candidates
from meterload.operators.splits import holdout
from meterload.operators.windows import appliance_windows, value_windows
from meterload.plans.actuals import actuals_of, place
from meterload.plans.preprocess import Store
from meterload.sources.csv import write_report
from meterload.sources.forecasts import read_forecasts, write_forecasts


def level_windows(
    tables: dict[str, DataFrame], metadata: DataFrame, level: str, cfg: Config, first: int, last: int,
    keep=None, part: tuple[int, int] | None = None, mean: bool = False,
) -> DataFrame:
    """(path keys, win, x, y[, x_mean]) of a level's entities, raw values."""
    if level == "appliance":
        homes = household_map(metadata, cfg)
        return appliance_windows(tables[level], homes, cfg, first, last, keep=keep, part=part, mean=mean)
    cut = value_windows(tables[level], ENTITY_KEYS[level], "total", cfg, first, last, keep=keep, part=part, mean=mean)
    return place(cut, level, metadata).select(*PATH_KEYS[level], "win", "x", "y", *(["x_mean"] if mean else []))


def level_series(tables: dict[str, DataFrame], metadata: DataFrame, level: str) -> tuple[DataFrame, DataFrame]:
    """(path keys, index, total) and (path keys, index, scaled, features): raw and normalised rows of a level above
    appliances, each one row per entity and step."""
    raw, normal, keys = tables[level], tables[f"normalized_{level}"], ENTITY_KEYS[level]
    normal = normal.select(*keys, "index", *FEATURES, F.col("total").alias("scaled"))
    return place(raw.select(*keys, "index", "total"), level, metadata), place(normal, level, metadata)


def level_lags(
    tables: dict[str, DataFrame], metadata: DataFrame, level: str, lags: Sequence[int], cfg: Config
) -> tuple[DataFrame, list[str]]:
    """(path keys, index, y, lag columns) of a level's training targets."""
    if level == "appliance":
        return lagged_appliances(tables[level], household_map(metadata, cfg), lags, cfg, *training_targets(cfg))
    keys = ENTITY_KEYS[level]
    series = place(tables[level].select(*keys, "index", "total"), level, metadata)
    return lagged_table(series, PATH_KEYS[level], "total", lags, *training_targets(cfg))


def _user_forecasts(
    tables: dict[str, DataFrame], metadata: DataFrame, level: str, model: UserModel, cfg: Config
) -> DataFrame:
    train, test = (1, cfg.last_train_window), (cfg.test_start, cfg.last_window)
    if level == "appliance":
        return user_model_by_sensor(
            tables[level], tables[f"normalized_{level}"], household_map(metadata, cfg), cfg, model.fit_predict,
            model.columns, train, test)
    raw, normal = level_series(tables, metadata, level)
    return user_model(raw, PATH_KEYS[level], cfg, model.fit_predict, model.columns, "total", train, test, normal)


def _fit(tables: dict[str, DataFrame], level: str, lag: int, cfg: Config, held_out=None) -> DataFrame:
    if level == "appliance":
        return fit_appliance_regression(tables[level], cfg.appliances, lag, cfg, held_out)
    return fit_lag_regression(tables[level], ENTITY_KEYS[level], "total", lag, cfg, held_out)


def _fitted(
    windows: DataFrame, tables: dict[str, DataFrame], level: str, models: Sequence[Forecaster], cfg: Config, held_out=None,
) -> DataFrame:
    """Windows beside the coefficients of the models that have any."""
    for model in models:
        if isinstance(model, LagRegression):
            windows = attach_fit(windows, _fit(tables, level, model.lag, cfg, held_out), ENTITY_KEYS[level], model.lag)
    return windows


def _predict(
    tables: dict[str, DataFrame], metadata: DataFrame, level: str, model: Model, cfg: Config
) -> DataFrame:
    keys, first, last = PATH_KEYS[level], cfg.test_start, cfg.last_window
    if isinstance(model, UserModel):
        return _user_forecasts(tables, metadata, level, model, cfg)
    if isinstance(model, GlobalRegression | EntityRegression):
        table, names = level_lags(tables, metadata, level, model.lags, cfg)
        fits = fit_lines(table, names, keys if isinstance(model, EntityRegression) else ())
        start, length = part = lags_part(model.lags, cfg)
        windows = level_windows(tables, metadata, level, cfg, first, last, part=part).drop("y")
        return apply_regression(windows, keys, fits, model.lags, cfg, start)
    start, length = part = input_part([model], cfg)
    windows = level_windows(tables, metadata, level, cfg, first, last, part=part, mean=needs_mean([model])).drop("y")
    return forecast(_fitted(windows, tables, level, [model], cfg), keys, model, cfg, start)


def _search(
    tables: dict[str, DataFrame], metadata: DataFrame, level: str, candidates: Sequence[Forecaster],
    cfg: Config,
) -> tuple[DataFrame, DataFrame]:
    """Candidates are fitted on training windows that are not held out, scored on those that are; the winner is
    fitted again on all of them."""
    def held_out(win: Column) -> Column:
        return holdout(win, cfg)

    keys = PATH_KEYS[level]
    start, length = part = input_part(candidates, cfg)
    last, mean = cfg.last_train_window, needs_mean(candidates)
    validation = level_windows(tables, metadata, level, cfg, 1, last, keep=held_out, part=part, mean=mean)
    validation = _fitted(validation, tables, level, candidates, cfg, held_out)
    best = best_candidates(score_candidates(validation, keys, candidates, cfg, start), keys)
    test = level_windows(tables, metadata, level, cfg, cfg.test_start, cfg.last_window, part=part, mean=mean).drop("y")
    test = _fitted(test, tables, level, candidates, cfg)
    return forecast_with_best(test, keys, best, candidates, cfg, start).drop("candidate"), best


def run_level(
    spark: SparkSession, tables: dict[str, DataFrame], metadata: DataFrame, level: str, store: Store,
    run: str, cfg: Config, model: Model | None = None,
    candidates: Sequence[Forecaster] | None = None,
) -> None:
    """Forecast the test windows of a level, sum them up the hierarchy, store every level.

    The base forecasts are stored first: the sums read them back instead of predicting again.
    """
    if candidates:
        predicted, best = _search(tables, metadata, level, candidates, cfg)
        tag(best, level, level).write.mode("overwrite").parquet(store.run(run, f"best/{level}"))
    else:
        predicted = _predict(tables, metadata, level, model, cfg)
    path = store.run(run, "forecasts")
    write_forecasts(tag(predicted, level, level), path)
    base = read_forecasts(spark, path, level, level)
    above = {k: v for k, v in bottom_up(base, level, cfg).items() if k != level}
    if above:
        write_forecasts(stack_levels(above, level), path)


def evaluate_stored(
    spark: SparkSession, store: Store, run: str, cfg: Config, metadata: DataFrame, levels: Sequence[str] = LEVELS,
) -> dict[str, DataFrame]:
    """Errors, summaries and the level report of stored forecasts; predicts nothing.

    Every forecast must have its actual and every actual of the entities in `metadata` its forecast. Each path is paired,
    measured and written where the forecasts of an entity meet, after one shuffle.
    """
    actuals, table = spark.read.parquet(store.actuals), None
    for base in levels:
        for level in LEVELS[LEVELS.index(base):]:
            forecasts = read_forecasts(spark, store.run(run, "forecasts"), base, level)
            errors = block_errors(forecasts, actuals_of(actuals, level, metadata, cfg), level, cfg)
            part = evaluation_table(tag(errors, base, level), cfg)
            table = part if table is None else table.unionByName(part)
    path = store.run(run, "evaluation")
    table.write.mode("overwrite").partitionBy("base_level", "level").parquet(path)
    evaluation = spark.read.parquet(path)
    summarize_table(evaluation).write.mode("overwrite").parquet(store.run(run, "summary"))
    summary = spark.read.parquet(store.run(run, "summary"))
    report = level_report(summary)
    write_report(report.orderBy("base_level", "level"), store.run(run, "level_report"), single_file=True)
    return {"evaluation": evaluation, "summary": summary, "report": report}


def evaluate(
    spark: SparkSession, tables: dict[str, DataFrame], store: Store, run: str, cfg: Config,
    models: dict[str, Model] | Model | None = None, levels: Sequence[str] = LEVELS,
    candidates: Sequence[Forecaster] | None = None, scope: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Forecast each level, sum upwards, compare with the direct forecasts and with the actuals that
    `build_levels` stored.

    `levels` picks the base levels; `scope` is metadata restricted to a sub-tree (its sums are
    compared with the actuals of whole communities and cities); `candidates` switches the search
    on, else `models` names one forecaster per level or one for all.
    """
    metadata = tables["metadata"] if scope is None else scope
    for level in levels:
        model = models.get(level) if isinstance(models, dict) else models
        run_level(spark, tables, metadata, level, store, run, cfg, model, candidates)
    return evaluate_stored(spark, store, run, cfg, metadata, levels)


def load_statistics(tables: dict[str, DataFrame], cfg: Config) -> DataFrame:
    """(level, mean, std) of the load in the test period."""
    metadata = tables["metadata"]
    means = mean_load(tables["city"], entity_counts(metadata, cfg), cfg)
    return means.join(std_load(tables["appliance"], tables, metadata, cfg), "level")
