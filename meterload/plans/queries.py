"""The query catalogue: one entry per operator or pipeline step, over the test tables.

Every entry takes (spark, folder) and returns a DataFrame. Doubles are rounded in the last step
only, so that engines that add in another order agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterload import fixtures as fx
from meterload.config import FEATURES, LEVELS
from meterload.functions.features import calendar_columns, scale_calendar
from meterload.functions.time import grid_time
from meterload.operators import bottomup, evaluate, hierarchy, hooks, report, splits, windows
from meterload.operators.clean import add_time, bounded_fill, clean_slots, mask_limit, mask_row_zscore
from meterload.operators.crossval import LagModel, best_over_folds
from meterload.operators.crossval import kfold_scores as fold_scores
from meterload.operators.forecast import (
    EntityRegression,
    GlobalRegression,
    LagRegression,
    SeasonalNaive,
    UserModel,
    WindowMean,
    apply_regression,
    attach_fit,
    fit_appliance_regression,
    fit_lag_regression,
    fit_regression,
    forecast,
    input_part,
    needs_mean,
    user_model,
)
from meterload.operators.grid import align_readings, expose_gaps, time_spine
from meterload.operators.normalize import normalize_level, zscore
from meterload.operators.profile import add_source_metadata, align_years, display_profile, profile_readings
from meterload.operators.rollup import (
    city_totals,
    community_totals,
    household_totals,
    join_totals,
    totals_by_grouping_sets,
    with_features,
)
from meterload.operators.search import best_candidates, forecast_with_best, halve_candidates, score_candidates
from meterload.plans import experiment
from meterload.plans.preprocess import Store, build_levels, preprocess
from meterload.session import scratch_path
from meterload.sources.csv import (
    read_evaluations,
    read_profile_csv,
    read_readings,
    read_source_metadata,
    read_training_logs,
    write_tree,
)
from meterload.sources.forecasts import long_form, read_forecasts, read_matrix, write_forecasts, write_matrix
from meterload.sources.tables import read_entities, read_entity, read_table, stored, stored_all, write_table

CFG = fx.HOURLY
FIRST, LAST = CFG.test_start, CFG.last_window
CANDIDATES = (SeasonalNaive(12), SeasonalNaive(24), SeasonalNaive(48), SeasonalNaive(72), WindowMean())
# Direct forecaster of each level in the evaluation queries.
MODELS = {
    "appliance": SeasonalNaive(24), "household": SeasonalNaive(48),
    "community": SeasonalNaive(72), "city": SeasonalNaive(12),
}
Query = Callable[[SparkSession, str], DataFrame]


def _r(name: str, digits: int = 4) -> Column:
    return F.round(F.col(name), digits).alias(name)


# --- levels over the test tables -----------------------------------------------------------------

def _levels(
    spark: SparkSession, folder: str, store: bool = False, homes: DataFrame | None = None, raw: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Totals of placed households, their communities and cities. `store` keeps the household
    totals in a file, for queries that branch into several levels. `homes` and `raw` (stored households and
    filled readings) spare a query that has them the second hierarchy and the second fill."""
    homes = fx.placed_households(spark, folder) if homes is None else homes
    raw = fx.appliance_table(spark, folder, homes) if raw is None else raw
    totals = household_totals(raw, CFG)
    household = totals.join(homes.select("dataid", "city", "community"), "dataid")
    household = stored(household, "household") if store else household
    community = household.groupBy("city", "community", "index").agg(F.sum("total").alias("total"))
    return {"household": household, "community": community, "city": city_totals(community)}


def _household(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder)["household"]


def _community(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder)["community"]


def _city(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder)["city"]


def _cut(
    series: DataFrame, level: str, first: int = FIRST, last: int = LAST, keep=None, part=None, mean: bool = False,
) -> DataFrame:
    """(path keys, win, x, y[, x_mean]) of a level above appliances."""
    keys = bottomup.PATH_KEYS[level]
    return windows.value_windows(series, keys, "total", CFG, first, last, keep=keep, part=part, mean=mean)


def _predict(series: DataFrame, level: str, model) -> DataFrame:
    """(path keys, win, y_hat, y) over the test windows."""
    start, length = part = input_part([model], CFG)
    cut = _cut(series, level, part=part, mean=needs_mean([model]))
    return forecast(cut, bottomup.PATH_KEYS[level], model, CFG, start)


# --- flagship, grid, profile ---------------------------------------------------------------------

def city_load_flagship(spark, folder):
    totals = household_totals(fx.appliance_table(spark, folder), CFG)
    city = city_totals(totals, fx.households(spark, folder))
    return city.select("city", "index", _r("total"))


def time_spine_hours(spark, folder):
    """The grid beside the number of events in each slot."""
    events = fx.slot_readings(spark, folder).groupBy("index").agg(F.count("*").alias("n_events"))
    spine = time_spine(spark, CFG).join(events, "index", "left")
    return spine.select("ts", "index", F.coalesce("n_events", F.lit(0)).cast("bigint").alias("n_events"))


def grid_rows(spark, folder):
    """Grid rows per household before and after exposing gaps."""
    work = CFG.with_(sensors=CFG.appliances)
    readings = fx.slot_readings(spark, folder).drop("grid")
    grid = expose_gaps(readings, readings, work)
    present = F.coalesce(*CFG.appliances).isNotNull()
    return grid.groupBy("dataid").agg(
        F.count("*").alias("n_rows"), F.count_if(present).alias("n_present"), F.min("index").alias("first_index"),
        F.max("index").alias("last_index"),
    )


def spine_fill(spark, folder):
    return fx.appliance_table(spark, folder).select("dataid", "index", *[_r(s) for s in CFG.appliances])


def spine_fill_blocks(spark, folder):
    """The same fill with the grid cut into blocks, as for very long grids."""
    work = CFG.with_(sensors=CFG.appliances, block_rows=100)
    readings = fx.slot_readings(spark, folder).drop("grid")
    filled = clean_slots(readings, readings, work)
    return filled.select("dataid", "index", *[_r(s) for s in CFG.appliances])


def spine_join_fill(spark, folder):
    """The same in two steps: left join with the grid, then a fill over the joined rows."""
    work = CFG.with_(sensors=CFG.appliances)
    readings = fx.slot_readings(spark, folder).drop("grid")
    filled = bounded_fill(expose_gaps(readings, readings, work), list(work.sensors), work)
    return filled.select("dataid", "index", *[_r(s) for s in CFG.appliances])


def household_profile(spark, folder):
    profile = profile_readings(fx.hourly_readings(spark, folder), CFG)
    return profile.select(
        "dataid", "min_time", "max_time", "n_readings", _r("data_availability", 6),
        _r("aggregation_abs_error_max"), _r("aggregation_abs_error_mean", 6), *CFG.sensors,
    )


def year_alignment(spark, folder):
    aligned = align_years(profile_readings(fx.order_readings(spark, folder), fx.ORDERS), fx.ORDERS)
    return aligned.select("dataid", "min_time", "max_time", "delta_year")


def year_aligned_readings(spark, folder):
    readings = fx.order_readings(spark, folder)
    metadata = align_years(profile_readings(readings, fx.ORDERS), fx.ORDERS)
    aligned = align_readings(readings, metadata, fx.ORDERS)
    return aligned.select("dataid", "index", _r("price", 2))


# --- hierarchy -----------------------------------------------------------------------------------

def community_assignment(spark, folder):
    return fx.placed_households(spark, folder).select("dataid", "city", "state", "community")


def community_assignment_runs(spark, folder):
    """The same numbering with the households cut into more ranges than there are cities."""
    homes = fx.households(spark, folder)
    runs = hierarchy.assign_communities(homes, CFG.community_size, ranges=7)
    return runs.select("dataid", "city", "state", "community")


def sensor_presence(spark, folder):
    return hierarchy.presence(fx.metadata(spark, folder), CFG)


def hierarchy_edges(spark, folder):
    return hierarchy.edges(fx.metadata(spark, folder), CFG)


def hierarchy_tree(spark, folder):
    tree = hierarchy.nested_cities(fx.metadata(spark, folder), CFG)
    sizes = F.aggregate(F.map_values("households"), F.lit(0), lambda acc, s: acc + F.size(s))
    return tree.select(
        "city", "community", F.size("households").alias("n_households"), sizes.alias("n_appliances"),
        F.array_min(F.map_keys("households")).alias("first_household"),
    )


def entity_lists(spark, folder):
    meta = fx.placed_households(spark, folder)
    rows = None
    for level in ("household", "community", "city"):
        entity = hierarchy.entity_list(meta, level)
        part = entity.select(F.lit(level).alias("level"), F.col(entity.columns[0]).cast("string").alias("entity"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def entity_counts(spark, folder):
    return hierarchy.entity_counts(fx.metadata(spark, folder), CFG)


# --- cleaning ------------------------------------------------------------------------------------

def row_zscore_outliers(spark, folder):
    sensors = list(fx.DAILY.sensors)
    grid = fx.daily_grid(spark, folder)
    masked = mask_row_zscore(grid, sensors, fx.DAILY.z_limit)
    n = sum((F.col(s).isNotNull().cast("int") for s in sensors[1:]), F.col(sensors[0]).isNotNull().cast("int"))
    total = sum((F.coalesce(s, F.lit(0.0)) for s in sensors[1:]), F.coalesce(sensors[0], F.lit(0.0)))
    return masked.select("dataid", "index", n.alias("n_kept"), F.round(total, 4).alias("total_kept"))


def abs_limit_outliers(spark, folder):
    sensors = list(fx.DAILY.sensors)
    masked = mask_limit(fx.daily_grid(spark, folder), sensors, 50.0)
    n = sum((F.col(s).isNotNull().cast("int") for s in sensors[1:]), F.col(sensors[0]).isNotNull().cast("int"))
    total = sum((F.coalesce(s, F.lit(0.0)) for s in sensors[1:]), F.coalesce(sensors[0], F.lit(0.0)))
    return masked.select("dataid", "index", n.alias("n_kept"), F.round(total, 4).alias("total_kept"))


# --- features ------------------------------------------------------------------------------------

def calendar_features(spark, folder):
    events = fx.table(spark, folder, "events").select("event_id", "ts")
    return events.withColumns(calendar_columns(F.col("ts")))


def calendar_features_scaled(spark, folder):
    scaled = scale_calendar(calendar_features(spark, folder))
    return scaled.select("event_id", *[_r(f, 6) if f != "typeofday" else F.col(f) for f in FEATURES])


# --- roll-up -------------------------------------------------------------------------------------

def household_total(spark, folder):
    return _household(spark, folder).select("dataid", "index", _r("total"))


def community_total(spark, folder):
    homes = fx.placed_households(spark, folder)
    household = household_totals(fx.appliance_table(spark, folder, homes), CFG)
    return community_totals(household, homes).select("community", "index", _r("total"))


def city_total(spark, folder):
    full = with_features(_city(spark, folder), CFG)
    return full.select("city", "ts", "index", *FEATURES, _r("total"))


def city_total_joined(spark, folder):
    """City totals joined to the de-duplicated features of their households."""
    household = _household(spark, folder)
    features = add_time(household.select("city", "index"), CFG)
    joined = join_totals(features, city_totals(household), "city")
    return joined.select("city", "ts", "index", *FEATURES, _r("total"))


def levels_grouping_sets(spark, folder):
    homes = fx.placed_households(spark, folder)
    household = household_totals(fx.appliance_table(spark, folder, homes), CFG)
    both = totals_by_grouping_sets(household, homes)
    community = F.coalesce("community", F.lit(0)).alias("community")
    return both.select("level", "city", community, "index", _r("total"))


# --- normalisation -------------------------------------------------------------------------------

def zscore_sensors(spark, folder):
    sensors = list(CFG.appliances)
    scored = zscore(fx.appliance_table(spark, folder), sensors)
    return scored.select("dataid", "index", *[_r(s) for s in sensors])


def zscore_levels(spark, folder):
    rows, levels = None, _levels(spark, folder, store=True)
    for level in ("household", "community", "city"):
        scored = normalize_level(levels[level], level, CFG)
        key = bottomup.ENTITY_KEYS[level][0]
        part = scored.select(F.lit(level).alias("level"), F.col(key).cast("string").alias("entity"), "index", _r("total"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def zscore_fit_on_train(spark, folder):
    scored = zscore(stored(_city(spark, folder), "city"), ["total"], fit_until=CFG.boundary)
    return scored.select("city", "index", _r("total"))


# --- splits and windows --------------------------------------------------------------------------

def _with_load(spark, folder, split: DataFrame) -> DataFrame:
    """Windows beside the number of events in their input rows."""
    events = fx.slot_readings(spark, folder)
    wins = F.sequence(F.greatest(F.lit(1), F.col("index") - CFG.input_size + 1), F.col("index"))
    per_slot = events.groupBy("index").agg(F.count("*").alias("n"))
    per_window = per_slot.select(F.explode(wins).alias("win"), "n").groupBy("win").agg(F.sum("n").alias("n_events"))
    joined = split.join(per_window, "win", "left")
    return joined.select(*split.columns, F.coalesce("n_events", F.lit(0)).cast("bigint").alias("n_events"))


def split_windows(spark, folder):
    return _with_load(spark, folder, splits.split_windows(spark, CFG))


def kfold_windows(spark, folder):
    return _with_load(spark, folder, splits.kfold_windows(spark, CFG, 3))


def validation_holdout(spark, folder):
    return _with_load(spark, folder, splits.validation_holdout(spark, CFG, method="modulo"))


def validation_holdout_hash(spark, folder):
    """The default rule, by hash."""
    return _with_load(spark, folder, splits.validation_holdout(spark, CFG))


def _feature_series(spark, folder) -> DataFrame:
    """City series with the raw total, its z-score and scaled features."""
    city = with_features(stored(_city(spark, folder), "city"), CFG)
    scaled = normalize_level(city.withColumn("raw", F.col("total")), "city", CFG)
    return scaled.withColumnsRenamed({"total": "scaled", "raw": "total"})


def _describe(name: str, values: Column, total: Column | None = None) -> list[Column]:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) if total is None else total
    return [
        F.size(values).alias(f"n_{name}"), F.round(total, 4).alias(f"sum_{name}"),
        F.round(values[0], 4).alias(f"first_{name}"), F.round(F.element_at(values, -1), 4).alias(f"last_{name}"),
    ]


def _fields() -> list[Column]:
    """All eight fields of an input array: the target by sum and ends, each feature by its sum."""
    columns = _describe("x", F.col("x.y"))
    for name in FEATURES:
        total = F.aggregate(F.col(f"x.{name}"), F.lit(0.0), lambda acc, v: acc + v)
        columns.append(F.round(total, 4).alias(f"sum_{name}"))
    return columns


def _summed_fields() -> list[Column]:
    """The same where windows bring the sums of their fields."""
    return [*_describe("x", F.col("x.y"), F.col("total_y")), *[F.round(f"total_{f}", 4).alias(f"sum_{f}") for f in FEATURES]]


def _output_sum() -> Column:
    """Sum of the few outputs of a window, value by value, in order."""
    return sum((F.get("y", F.lit(i)) for i in range(CFG.output_size)), F.lit(0.0))


def input_windows(spark, folder):
    series = _feature_series(spark, folder)
    cut = windows.input_windows(series, ["city"], "scaled", CFG, 1, CFG.last_window)
    return cut.select("city", "win", *_fields())


def output_windows(spark, folder):
    cut = windows.output_windows(_community(spark, folder), ["community"], "total", CFG, 1, CFG.last_window)
    return cut.select("community", "win", *_describe("y", F.col("y")))


def training_pairs(spark, folder):
    pairs = windows.training_pairs(
        _feature_series(spark, folder), ["city"], "total", "scaled", CFG, 1, CFG.last_train_window)
    return pairs.select("city", "win", *_fields(), *_describe("y", F.col("y")))


def _appliance_tables(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw and normalised appliance tables with features, and the household map."""
    meta = stored(fx.metadata(spark, folder), "metadata")
    raw = stored(add_time(fx.appliance_table(spark, folder, meta), CFG), "appliance")
    return raw, normalize_level(raw, "appliance", CFG), hierarchy.household_map(meta, CFG)


def appliance_input_windows(spark, folder):
    """Normalised input windows of every appliance over the test period."""
    raw, scaled, homes = _appliance_tables(spark, folder)
    cut = windows.appliance_pairs(raw, scaled, homes, CFG, FIRST, LAST, with_output=False, totals=True)
    return cut.select("dataid", "sensor", "win", *_summed_fields())


def appliance_training_pairs(spark, folder):
    """Normalised inputs and raw outputs of every appliance over all training windows."""
    raw, scaled, homes = _appliance_tables(spark, folder)
    cut = windows.appliance_pairs(raw, scaled, homes, CFG, 1, CFG.last_train_window, totals=True)
    return cut.select("dataid", "sensor", "win", *_summed_fields(), *_describe("y", F.col("y"), _output_sum()))


def actual_windows(spark, folder):
    """Expected outputs of every appliance over the test windows."""
    meta = stored(fx.metadata(spark, folder), "metadata")
    cut = windows.appliance_windows(
        fx.appliance_table(spark, folder, meta), hierarchy.household_map(meta, CFG), CFG, FIRST, LAST,
        with_input=False)
    return cut.select("dataid", "sensor", "win", *_describe("y", F.col("y")))


def window_statistics(spark, folder):
    """Mean and deviation of every input window of a community, from running sums."""
    cut = windows.window_statistics(_community(spark, folder), ["community"], "total", CFG.input_size, 1, CFG.last_window)
    return cut.select("community", "win", _r("mean", 7), _r("std"))


# --- forecasts -----------------------------------------------------------------------------------

def _long(df: DataFrame, keys: list[str]) -> DataFrame:
    return long_form(df, "y_hat", "y_hat", keys).select(*keys, "win", "h", _r("y_hat", 7))


def seasonal_naive(spark, folder):
    return _long(_predict(_city(spark, folder), "city", SeasonalNaive(24)), ["city"])


def window_mean(spark, folder):
    return _long(_predict(_city(spark, folder), "city", WindowMean()), ["city"])


def lag_regression_entity(spark, folder):
    fits = fit_lag_regression(_household(spark, folder), ["dataid"], "total", 24, CFG)
    return fits.select("dataid", _r("slope"), _r("intercept"))


def lag_regression_forecast(spark, folder):
    city = stored(_city(spark, folder), "city")
    fits = fit_lag_regression(city, ["city"], "total", 24, CFG)
    cut = attach_fit(_cut(city, "city"), fits, ["city"], 24)
    return _long(forecast(cut, ["city"], LagRegression(24), CFG), ["city"])


def lag_regression_global(spark, folder):
    fits = fit_regression(_community(spark, folder), ["community"], "total", [24], CFG)
    return fits.select(F.lit(24).alias("lag"), F.round(F.get("weights", F.lit(0)), 4).alias("slope"), _r("intercept"))


def lag_regression_multi(spark, folder):
    """One model with two lags for each household."""
    fits = fit_regression(_household(spark, folder), ["dataid"], "total", [24, 48], CFG, ["dataid"])
    weights = [F.round(F.get("weights", F.lit(i)), 4).alias(f"weight_{lag}") for i, lag in enumerate((24, 48))]
    return fits.select("dataid", _r("intercept"), *weights)


def _validation(win: Column) -> Column:
    return splits.holdout(win, CFG, method="modulo")


def candidate_search(spark, folder):
    cut = _cut(_community(spark, folder), "community", 1, CFG.last_train_window, _validation, mean=True)
    scores = score_candidates(cut, ["community"], CANDIDATES, CFG)
    return best_candidates(scores, ["community"]).select("community", "candidate", _r("val_mae", 7))


def candidate_forecast(spark, folder):
    """Test-period error of each community under its winning candidate."""
    keys = ["city", "community"]
    series = stored(_community(spark, folder), "community")
    validation = _cut(series, "community", 1, CFG.last_train_window, _validation, mean=True)
    best = best_candidates(score_candidates(validation, keys, CANDIDATES, CFG), keys)
    test = _cut(series, "community", mean=True)
    errors = evaluate.window_errors(forecast_with_best(test, keys, best, CANDIDATES, CFG), CFG)
    return errors.groupBy("community", "candidate").agg(F.round(F.avg("mae"), 7).alias("mae"))


def candidate_search_fitted(spark, folder):
    """Fitted and fit-free candidates: fits without the held-out windows, scores on them, a refit for the winner,
    its error over the test windows."""
    city = stored(_city(spark, folder), "city")
    candidates = (SeasonalNaive(24), LagRegression(24), LagRegression(48), WindowMean())

    def fitted(cut: DataFrame, held_out=None) -> DataFrame:
        for lag in (24, 48):
            cut = attach_fit(cut, fit_lag_regression(city, ["city"], "total", lag, CFG, held_out), ["city"], lag)
        return cut

    def held_out(win: Column) -> Column:
        return splits.holdout(win, CFG)

    validation = fitted(_cut(city, "city", 1, CFG.last_train_window, held_out, mean=True), held_out)
    best = stored(best_candidates(score_candidates(validation, ["city"], candidates, CFG), ["city"]), "best")
    test = forecast_with_best(fitted(_cut(city, "city", mean=True)), ["city"], best, candidates, CFG)
    errors = evaluate.window_errors(test, CFG).groupBy("city").agg(F.avg("mae").alias("mae"))
    return best.join(errors, "city").select("city", "candidate", _r("val_mae", 5), _r("mae", 5))


HALVED = (*[SeasonalNaive(lag) for lag in (12, 24, 36, 48, 60, 72)], WindowMean())


def candidate_halving(spark, folder):
    """Successive halving over the held-out windows of each community: seven candidates, three rungs, a third stays."""
    keys = ["city", "community"]
    series = _community(spark, folder)
    blocks = stored(windows.value_blocks(series, keys, "total", CFG, 1, CFG.last_train_window, mean=True), "blocks")

    def cut(keep):
        return windows.cut_values(blocks, keys, "total", CFG, keep, mean=True)

    best = halve_candidates(cut, keys, HALVED, CFG, _validation)
    return best.select("community", "candidate", _r("val_mae", 7), "n_windows")


FOLD_MODELS = (LagModel((12,), False), LagModel((24,), False), LagModel((24, 48), False), LagModel((24,)), LagModel((24, 48)))


def kfold_scores(spark, folder):
    """Error of each candidate on each fold of each community, fitted on the other folds."""
    scores = fold_scores(_community(spark, folder), ["community"], "total", FOLD_MODELS, CFG, 3)
    return scores.select("community", "fold", "candidate", _r("rmse"))


def kfold_best(spark, folder):
    """The candidate of each community with the smallest mean error over folds."""
    scores = fold_scores(_community(spark, folder), ["community"], "total", FOLD_MODELS, CFG, 3)
    return best_over_folds(scores, ["community"]).select("community", "candidate", _r("rmse"))


def appliance_regression(spark, folder):
    meta = stored(fx.metadata(spark, folder), "metadata")
    fits = fit_appliance_regression(fx.appliance_table(spark, folder, meta), CFG.appliances, 24, CFG)
    return fits.select("dataid", "sensor", _r("slope"), _r("intercept"))


def global_regression_forecast(spark, folder):
    """One model with two lags for all communities, and its forecasts."""
    keys = ["city", "community"]
    series = stored(_community(spark, folder), "community")
    fits = fit_regression(series, keys, "total", [24, 48], CFG)
    cut = _cut(series, "community")
    return _long(apply_regression(cut, keys, fits, [24, 48], CFG), ["community"])


def user_model_hook(spark, folder):
    """A user model in numpy: window mean plus the training drift between outputs and inputs."""
    n_out = CFG.output_size

    def drifted_mean(x_train, y_train, x_test):
        drift = y_train.mean() - x_train[:, :, 0].mean()
        return (x_test[:, :, 0].mean(axis=1) + drift)[:, None].repeat(n_out, axis=1)

    y_hat = user_model(
        _city(spark, folder), ["city"], CFG, drifted_mean, ["total"], "total",
        (1, CFG.last_train_window), (FIRST, LAST))
    return _long(y_hat, ["city"])


# --- bottom-up and evaluation --------------------------------------------------------------------

def _predict_appliances(meta: DataFrame, table: DataFrame, model) -> DataFrame:
    start, length = part = input_part([model], CFG)
    cut = windows.appliance_windows(table, hierarchy.household_map(meta, CFG), CFG, FIRST, LAST, part=part)
    return forecast(cut, bottomup.PATH_KEYS["appliance"], model, CFG, start)


def _evaluated(spark: SparkSession, folder: str, *bases: str) -> DataFrame:
    """Window errors of base levels at their own and all higher levels.

    The base windows' forecasts are stored once and summed upwards from there. Actuals travel up
    beside the forecasts: both are sums of the same children, so the pairing needs no join.
    """
    several, meta, raw = len(bases) > 1, None, None
    if "appliance" in bases:
        meta = stored(fx.metadata(spark, folder), "metadata")
        raw = fx.appliance_table(spark, folder, meta)
        raw = stored(raw, "appliance") if several else raw
    levels = _levels(spark, folder, several, meta, raw) if set(bases) - {"appliance"} else {}
    predicted = {
        base: _predict_appliances(meta, raw, MODELS[base]) if base == "appliance" else _predict(levels[base], base, MODELS[base])
        for base in bases
    }
    predicted |= stored_all({base: df for base, df in predicted.items() if base != "city"})
    rows = None
    for base in bases:
        for level, df in bottomup.bottom_up_pairs(predicted[base], base, CFG).items():
            errors = bottomup.tag(evaluate.window_errors(df, CFG), base, level)
            rows = errors if rows is None else rows.unionByName(errors)
    return rows


def _entity() -> Column:
    return F.concat_ws("/", "city", "community", "dataid", "sensor").alias("entity")


def _bottomup(base: str) -> Query:
    def query(spark, folder):
        table = evaluate.evaluation_table(_evaluated(spark, folder, base), CFG)
        return table.select("level", _entity(), "win", _r("mae"), _r("rmse"))
    return query


def bottomup_from_store(spark, folder):
    """Household forecasts written to the store, read back, summed and joined with actuals."""
    levels = _levels(spark, folder, store=True)
    path = scratch_path(spark, "forecasts")
    predicted = _predict(levels["household"], "household", MODELS["household"]).drop("y")
    write_forecasts(bottomup.tag(predicted, "household", "household"), path)
    kept = read_forecasts(spark, path, "household", "household")
    actuals = {
        level: windows.output_windows(df, bottomup.PATH_KEYS[level], "total", CFG, FIRST, LAST)
        for level, df in levels.items()
    }
    table = evaluate.evaluation_table(evaluate.evaluate_base(kept, "household", actuals, CFG), CFG)
    return table.select("level", _entity(), "win", _r("mae"), _r("rmse"))


def window_mae(spark, folder):
    predicted = _predict(_community(spark, folder), "community", WindowMean())
    errors = evaluate.window_errors(predicted, CFG)
    return errors.select("community", "win", _r("mae", 7), _r("rmse_window"))


def entity_rmse(spark, folder):
    keys = bottomup.PATH_KEYS["household"]
    predicted = _predict(_household(spark, folder), "household", WindowMean())
    table = evaluate.with_entity_rmse(evaluate.window_errors(predicted, CFG), keys, CFG)
    return table.select("dataid", "win", _r("mae", 7), _r("rmse"))


def evaluation_summary(spark, folder):
    summary = evaluate.summarize(_evaluated(spark, folder, "household"), CFG)
    return summary.select(
        "base_level", "level", _entity(), _r("mae_mean"), _r("rmse_mean"), _r("mae_std"),
        _r("rmse_std"))


def level_report(spark, folder):
    """All ten (base level, level) rows: every aggregation path beside the direct forecasts."""
    errors = _evaluated(spark, folder, *MODELS)
    rows = evaluate.level_report(evaluate.summarize(errors, CFG))
    return rows.select("base_level", "level", *[_r(c) for c in ("mae_mean", "rmse_mean", "mae_std", "rmse_std")])


# --- reports -------------------------------------------------------------------------------------

def training_curve_by_appliance(spark, folder):
    logs = report.key_from_path(fx.training_logs(spark, folder), "appliance")
    return report.curve_by_appliance(logs).select("appliance", "epoch", _r("mae", 9), _r("rmse", 9))


def training_curve(spark, folder):
    logs = report.key_from_path(fx.training_logs(spark, folder), "appliance")
    curve = report.curve_of_appliances(report.curve_by_appliance(logs))
    return curve.select("epoch", _r("mae", 9), _r("rmse", 9))


def training_curve_levels(spark, folder):
    """Curves of households, communities and cities: logs of a user, and of the users of each."""
    logs = report.key_from_path(fx.training_logs(spark, folder), "household")
    logs = logs.withColumn("dataid", F.col("household").cast("bigint"))
    means = F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse")
    household = logs.groupBy("dataid", "epoch").agg(*means)
    city = household.join(fx.households(spark, folder).select("dataid", "city"), "dataid")
    community = household.join(fx.placed_households(spark, folder).select("dataid", "community"), "dataid")
    levels = household.select(F.lit("household").alias("level"), "epoch", "mae", "rmse")
    for level, rows in (("community", community), ("city", city)):
        grouped = rows.groupBy(level, "epoch").agg(*means)
        levels = levels.unionByName(grouped.select(F.lit(level).alias("level"), "epoch", "mae", "rmse"))
    return report.curve_by_level(levels).select("level", "epoch", _r("mae", 9), _r("rmse", 9))


def mean_load(spark, folder):
    meta = stored(fx.metadata(spark, folder), "metadata")
    city = _levels(spark, folder, homes=meta)["city"]
    return report.mean_load(city, hierarchy.entity_counts(meta, CFG), CFG).select("level", _r("mean", 7))


def std_load(spark, folder):
    rows, levels = None, _levels(spark, folder, store=True)
    for level in ("household", "community", "city"):
        key = bottomup.ENTITY_KEYS[level][0]
        part = report.std_of_totals(levels[level], key, CFG).select(F.lit(level).alias("level"), _r("std"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def std_load_appliance(spark, folder):
    meta = stored(fx.metadata(spark, folder), "metadata")
    return report.std_of_appliances(fx.appliance_table(spark, folder, meta), meta, CFG).select(_r("std"))


# --- user functions ------------------------------------------------------------------------------

#: Presence of each sensor as a user would write it: states and results are flags.
PRESENCE = hooks.UserAggregate(
    chunk=lambda groups: groups.count() > 0,
    agg=lambda groups: groups.any(),
    finalize=lambda states: states,
    state=", ".join(f"{s} BOOLEAN" for s in CFG.sensors),
    result=", ".join(f"{s} BOOLEAN" for s in CFG.sensors),
)


def user_aggregate_present(spark, folder):
    """Sensor presence per household by a user-defined aggregate over the raw readings."""
    return hooks.user_aggregate(fx.hourly_readings(spark, folder), ["dataid"], list(CFG.sensors), PRESENCE)


def partition_hook(spark, folder):
    """Training curves where a user function takes each log's appliance from its path."""
    def appliance_of(rows, path):
        return rows.assign(appliance=path.split("appliance=")[1].split("/")[0])

    logs = hooks.map_files(
        fx.training_logs(spark, folder), appliance_of, "appliance STRING, epoch INT, mae DOUBLE, rmse DOUBLE")
    return report.curve_of_appliances(report.curve_by_appliance(logs)).select("epoch", _r("mae", 9), _r("rmse", 9))


# --- sources and sinks ---------------------------------------------------------------------------

def roundtrip_partitioned(spark, folder):
    """City tables written by entity, read back through partition pruning and a pushed filter."""
    path = scratch_path(spark, "city")
    write_table(_city(spark, folder), path, key="city", layout="entity")
    kept = read_table(spark, path, ["city", "index", "total"], (F.col("city") == "ASIA") & (F.col("index") > 600))
    return kept.select("city", "index", _r("total"))


def _active_totals(spark, folder) -> DataFrame:
    """(dataid, index, total) of all active users."""
    return household_totals(fx.appliance_table(spark, folder), CFG).select("dataid", "index", "total")


def roundtrip_bucketed(spark, folder):
    """Household totals written in buckets; a few households read back through bucket pruning."""
    path = scratch_path(spark, "household")
    write_table(_active_totals(spark, folder), path, key="dataid", buckets=8)
    return read_entities(spark, path, "dataid", [3, 7, 11, 12, 14]).select("dataid", "index", _r("total"))


def read_entity_bucketed(spark, folder):
    """One household of a table in the default number of buckets."""
    path = scratch_path(spark, "household")
    write_table(_active_totals(spark, folder), path, key="dataid")
    return read_entity(spark, path, "dataid", 7, ["dataid", "index", "total"]).select("dataid", "index", _r("total"))


def roundtrip_append(spark, folder):
    """Two appended writes into one table of buckets, all of it read back."""
    path = scratch_path(spark, "append")
    household = stored(_household(spark, folder).select("dataid", "index", "total"), "household")
    half = F.col("index") <= CFG.boundary
    write_table(household.where(half), path, key="dataid", buckets=8)
    write_table(household.where(~half), path, key="dataid", buckets=8, mode="append")
    return read_table(spark, path).select("dataid", "index", _r("total"))


def roundtrip_overwritten_partitions(spark, folder):
    """City tables of which one city is written anew; the others stay."""
    path = scratch_path(spark, "city")
    city = stored(_city(spark, folder).select("city", "index", "total"), "city")
    write_table(city, path, key="city", layout="entity")
    anew = city.where("city = 'ASIA'").withColumn("total", F.col("total") * 2)
    write_table(anew, path, key="city", layout="entity", mode="overwrite_partitions")
    return read_table(spark, path).select("city", "index", _r("total"))


def csv_profile_roundtrip(spark, folder):
    """Readings and metadata through CSV: offsets in the times, a descriptor row, display text."""
    path = scratch_path(spark, "csv")
    readings = fx.hourly_readings(spark, folder)
    stamped = F.concat(F.col("ts").cast("string"), F.lit("+00"))
    rounded = [F.round(s, 2).alias(s) for s in CFG.sensors]
    readings.select("dataid", stamped.alias("ts"), *rounded).write.option("header", True).csv(f"{path}/readings")
    homes = fx.placed_households(spark, folder).select(F.col("dataid").cast("string"), "city", "state")
    descriptor = spark.createDataFrame([("unique id", "city name", "state name")], "dataid string, city string, state string")
    descriptor.unionByName(homes).write.option("header", True).csv(f"{path}/metadata")

    source = read_source_metadata(spark, f"{path}/metadata")
    profile = add_source_metadata(profile_readings(read_readings(spark, f"{path}/readings", CFG), CFG), source)
    shown = display_profile(profile, CFG).withColumns({
        "delta_year": F.lit(0), "community": F.lit(0),
        "egauge_1min_min_time": F.col("egauge_1min_min_time").cast("string"),
        "egauge_1min_max_time": F.col("egauge_1min_max_time").cast("string"),
    })
    shown.write.option("header", True).csv(f"{path}/profile")
    back = read_profile_csv(spark, f"{path}/profile", CFG)
    return back.select(
        "dataid", "city", F.col("egauge_1min_min_time").alias("min_time"), F.col("egauge_1min_max_time").alias("max_time"),
        F.col("egauge_1min_data_availability").alias("availability"), "aggregation_abs_error_max", *CFG.sensors)


def matrix_roundtrip(spark, folder):
    """City forecasts through text matrices, one file per city, windows recovered from line order."""
    path = scratch_path(spark, "matrix")
    predicted = _predict(_city(spark, folder), "city", SeasonalNaive(24))
    write_matrix(predicted, path, ["city"])
    return _long(read_matrix(spark, f"{path}/city=*", ["city"], FIRST), ["city"])


# --- files ---------------------------------------------------------------------------------------

def csv_readings_by_name(spark, folder):
    """Readings of two folders with other column orders and other texts for missing values."""
    path = scratch_path(spark, "by-name")
    readings = fx.hourly_readings(spark, folder).withColumn("ts", F.concat(F.col("ts").cast("string"), F.lit("+00")))
    for part, columns, missing in (
        (0, ["dataid", "ts", *CFG.sensors], "NaN"), (1, [*reversed(CFG.sensors), "ts", "dataid"], "NA"),
    ):
        rows = readings.where(F.col("dataid") % 2 == part).select(*columns)
        rows.write.option("header", True).option("nullValue", missing).csv(f"{path}/part{part}")
    return read_readings(spark, f"{path}/part*/*.csv", CFG).withColumn("dataid", F.col("dataid").cast("bigint"))


def log_tree_curves(spark, folder):
    """Training logs in a tree of one folder per household and appliance, read by a pattern."""
    path = scratch_path(spark, "logs")
    logs = report.key_from_path(report.key_from_path(fx.training_logs(spark, folder), "household"), "appliance")
    rows = logs.selectExpr("household", "appliance", "epoch", "mae AS loss", "rmse AS root_mean_squared_error")
    write_tree(rows, path, ["household", "appliance"])
    back = report.key_from_path(read_training_logs(spark, f"{path}/household=*/appliance=*/*.csv"), "appliance")
    return report.curve_by_appliance(back).select("appliance", "epoch", _r("mae", 9), _r("rmse", 9))


def evaluation_tree_summary(spark, folder):
    """Evaluation files anywhere below a folder, summarised per household."""
    path = scratch_path(spark, "evaluations")
    logs = report.key_from_path(fx.training_logs(spark, folder), "household")
    rows = logs.select("household", "mae", "rmse")
    write_tree(rows, f"{path}/deep/down", ["household"])
    back = report.key_from_path(read_evaluations(spark, path, "*.csv"), "household")
    summary = evaluate.summarize_table(back, ["household"])
    return summary.select("household", *[_r(c, 9) for c in ("mae_mean", "rmse_mean", "mae_std", "rmse_std")])


# --- whole pipelines -----------------------------------------------------------------------------

def _order_run(spark, folder) -> dict[str, DataFrame]:
    """`preprocess` over CSV files of the orders."""
    path = scratch_path(spark, "orders")
    readings = fx.order_readings(spark, folder).withColumn("ts", F.concat(F.col("ts").cast("string"), F.lit("+00")))
    for part, columns in ((0, ["dataid", "ts", "price"]), (1, ["price", "ts", "dataid"])):
        readings.where(F.col("dataid") % 2 == part).select(*columns).write.option("header", True).csv(f"{path}/part{part}")
    fx.customers(spark, folder).selectExpr(
        "CAST(dataid AS STRING) AS dataid", "segment", "city", "state").write.option("header", True).csv(f"{path}/metadata")
    return preprocess(
        spark, f"{path}/part*/*.csv", f"{path}/metadata", Store(f"{path}/out"), fx.ORDERS, extra=["segment"])


def preprocess_levels(spark, folder):
    """All four level tables and their normalised copies, from CSV."""
    tables, rows = _order_run(spark, folder), None
    for name in [*LEVELS, *[f"normalized_{level}" for level in LEVELS]]:
        level = name.removeprefix("normalized_")
        key = F.col(bottomup.ENTITY_KEYS[level][0]).cast("string")
        value = "price" if level == "appliance" else "total"
        part = tables[name].select(F.lit(name).alias("name"), key.alias("entity"), "index", F.round(value, 4).alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def generated_metadata(spark, folder):
    """Profile, year shift, delivered metadata with an extra column, and communities, from CSV."""
    meta = _order_run(spark, folder)["metadata"]
    return meta.select(
        F.col("dataid").cast("bigint").alias("dataid"), "city", "state", "segment", "min_time", "max_time", "n_readings",
        "delta_year", "community", "price")


def profile_source_metadata(spark, folder):
    """Profiles of customers with orders beside metadata of users with events; households without any stay, with NULLs."""
    source = fx.households(spark, folder).join(fx.customers(spark, folder).select("dataid", "segment"), "dataid")
    profile = profile_readings(fx.order_readings(spark, folder), fx.ORDERS)
    return add_source_metadata(profile, source, ["segment"]).select("dataid", "city", "state", "segment", "n_readings")


def _run(spark, folder, levels=LEVELS, city: str | None = None, **choice) -> tuple[Store, dict[str, DataFrame]]:
    """Level tables built by the pipeline, then `evaluate` on them."""
    store = Store(scratch_path(spark, "run"))
    tables = build_levels(spark, fx.hourly_readings(spark, folder), stored(fx.metadata(spark, folder), "metadata"), store, CFG)
    scope = hierarchy.subtree(tables["metadata"], city=city) if city else None
    return store, experiment.evaluate(spark, tables, store, "run", CFG, levels=levels, scope=scope, **choice)


def _report(rows: DataFrame) -> DataFrame:
    return rows.select("base_level", "level", *[_r(c) for c in ("mae_mean", "rmse_mean", "mae_std", "rmse_std")])


def evaluate_pipeline(spark, folder):
    return _report(_run(spark, folder, models=MODELS)[1]["report"])


def evaluate_without_appliances(spark, folder):
    return _report(_run(spark, folder, LEVELS[1:], models=MODELS)[1]["report"])


def evaluate_subtree(spark, folder):
    """The same on the households of one city."""
    return _report(_run(spark, folder, LEVELS[1:], city="ASIA", models=MODELS)[1]["report"])


def _drifted(x_train, y_train, x_test):
    """A user model on normalised inputs: the training mean of the outputs plus the mean of the scaled input."""
    return (y_train.mean() + x_test[:, :, 0].mean(axis=1))[:, None].repeat(CFG.output_size, axis=1)


def user_model_levels(spark, folder):
    """A user model as the forecaster of the pipeline, at every level above appliances."""
    return _report(_run(spark, folder, LEVELS[1:], models=UserModel(_drifted))[1]["report"])


def user_model_appliance(spark, folder):
    """The same user model for every appliance, summed to all levels."""
    return _report(_run(spark, folder, ("appliance",), models=UserModel(_drifted))[1]["report"])


def global_model_appliance(spark, folder):
    """One two-lag model for all appliances, summed to all levels."""
    return _report(_run(spark, folder, ("appliance",), models=GlobalRegression((24, 48)))[1]["report"])


def entity_regression_levels(spark, folder):
    """A two-lag model for each household, community and city."""
    return _report(_run(spark, folder, LEVELS[1:], models=EntityRegression((24, 48)))[1]["report"])


def evaluation_sink(spark, folder):
    """Stored evaluation rows of household forecasts at every level."""
    store, _ = _run(spark, folder, ("household",), models=MODELS)
    table = spark.read.parquet(store.run("run", "evaluation"))
    return table.select("level", _entity(), "win", _r("mae"), _r("rmse"))


def report_csv(spark, folder):
    """The level report as CSV, read back."""
    store, _ = _run(spark, folder, ("community", "city"), models=MODELS)
    schema = "base_level STRING, level STRING, mae_mean DOUBLE, rmse_mean DOUBLE, mae_std DOUBLE, rmse_std DOUBLE"
    return _report(spark.read.schema(schema).option("header", True).csv(store.run("run", "level_report")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        city_load_flagship, time_spine_hours, grid_rows, spine_fill, spine_fill_blocks, spine_join_fill, household_profile,
        year_alignment, year_aligned_readings, community_assignment, community_assignment_runs,
        sensor_presence, hierarchy_edges, hierarchy_tree, entity_lists, entity_counts,
        row_zscore_outliers, abs_limit_outliers, calendar_features, calendar_features_scaled,
        household_total, community_total, city_total, city_total_joined, levels_grouping_sets,
        zscore_sensors, zscore_levels, zscore_fit_on_train, split_windows, kfold_windows,
        validation_holdout, input_windows, output_windows, training_pairs, actual_windows,
        seasonal_naive, window_mean, lag_regression_entity, lag_regression_forecast,
        lag_regression_global, candidate_search, candidate_forecast, user_model_hook,
        bottomup_from_store, window_mae, entity_rmse, evaluation_summary, level_report,
        training_curve_by_appliance, training_curve, training_curve_levels, mean_load, std_load,
        std_load_appliance, roundtrip_partitioned, roundtrip_bucketed, roundtrip_append,
        read_entity_bucketed, roundtrip_overwritten_partitions,
        csv_profile_roundtrip, matrix_roundtrip, csv_readings_by_name, log_tree_curves, evaluation_tree_summary,
        preprocess_levels, generated_metadata, profile_source_metadata, evaluate_pipeline, evaluate_without_appliances,
        evaluate_subtree, evaluation_sink, report_csv, appliance_input_windows, appliance_training_pairs,
        validation_holdout_hash, candidate_search_fitted, appliance_regression, global_regression_forecast, user_model_levels,
        window_statistics, lag_regression_multi, candidate_halving, kfold_scores, kfold_best, user_aggregate_present,
        partition_hook, user_model_appliance, global_model_appliance, entity_regression_levels,
    )
}
QUERIES.update({f"bottomup_{base}": _bottomup(base) for base in MODELS})
