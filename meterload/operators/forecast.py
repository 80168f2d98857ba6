"""Forecasters. Each turns the input values of a window into its output array by an expression,
so forecasting is a projection over windows; fitting is a grouped aggregate."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from meterload.config import FEATURES, Config
from meterload.functions.arrays import array_mean
from meterload.operators.moments import line, moments
from meterload.operators.windows import per_sensor, series_blocks


def _check_lag(lag: int, cfg: Config) -> None:
    if not cfg.output_size <= lag <= cfg.input_size:
        raise ValueError(
            f"lag {lag} must lie between output_size {cfg.output_size} and input_size {cfg.input_size}"
        )


def _lagged(x: Column, lag: int, cfg: Config, start: int) -> Column:
    """The input values `lag` steps before each output step, of an input cut at `start`."""
    return F.slice(x, cfg.input_size - lag - start + 1, cfg.output_size)


@dataclass(frozen=True)
class SeasonalNaive:
    """Repeats the value seen `lag` steps earlier."""

    lag: int

    @property
    def name(self) -> str:
        return f"naive_{self.lag}"

    def reads(self, cfg: Config) -> tuple[int, int]:
        _check_lag(self.lag, cfg)
        return cfg.input_size - self.lag, cfg.output_size

    def predict(self, x: Column, cfg: Config, start: int = 0) -> Column:
        return _lagged(x, self.lag, cfg, start)


@dataclass(frozen=True)
class WindowMean:
    """Repeats the mean of the input window, which windows carry as `x_mean` (see `with_mean`): it reads no values."""

    @property
    def name(self) -> str:
        return "window_mean"

    def reads(self, cfg: Config) -> tuple[int, int]:
        return 0, 0

    def predict(self, x: Column, cfg: Config, start: int = 0) -> Column:
        return F.array_repeat(F.col("x_mean"), cfg.output_size)


@dataclass(frozen=True)
class LagRegression:
    """intercept + slope * value `lag` steps earlier; `attach_fit` gives windows the coefficients."""

    lag: int

    @property
    def name(self) -> str:
        return f"regression_{self.lag}"

    def reads(self, cfg: Config) -> tuple[int, int]:
        _check_lag(self.lag, cfg)
        return cfg.input_size - self.lag, cfg.output_size

    def predict(self, x: Column, cfg: Config, start: int = 0) -> Column:
        line = lambda v: F.col(f"_intercept_{self.lag}") + F.col(f"_slope_{self.lag}") * v
        return F.transform(_lagged(x, self.lag, cfg, start), line)


@dataclass(frozen=True)
class GlobalRegression:
    """One linear model over several lags for all entities of a level."""

    lags: tuple[int, ...]


@dataclass(frozen=True)
class EntityRegression:
    """One linear model over several lags for each entity."""

    lags: tuple[int, ...]


@dataclass(frozen=True)
class UserModel:
    """A model in numpy per entity, see `user_model`. `columns` are read from the normalised table: `scaled` is the
    target, calendar features have their own names, `total` is the raw value."""

    fit_predict: Callable
    columns: tuple[str, ...] = ("scaled", *FEATURES)


Forecaster = SeasonalNaive | WindowMean | LagRegression
Model = Forecaster | GlobalRegression | EntityRegression | UserModel


def attach_fit(windows: DataFrame, fits: DataFrame, keys: Sequence[str], lag: int) -> DataFrame:
    """Windows beside the coefficients (keys, slope, intercept) of a fitted LagRegression."""
    named = fits.select(*keys, F.col("slope").alias(f"_slope_{lag}"), F.col("intercept").alias(f"_intercept_{lag}"))
    return windows.join(named, list(keys))


def input_part(models: Sequence[Forecaster], cfg: Config) -> tuple[int, int]:
    """(offset, length) of the input window that the models read together; windows cut for them
    need not hold more."""
    reads = [part for part in (m.reads(cfg) for m in models) if part[1]] or [(0, 0)]
    start = min(offset for offset, _ in reads)
    return start, max(offset + length for offset, length in reads) - start


def needs_mean(models: Sequence[Forecaster]) -> bool:
    return any(isinstance(m, WindowMean) for m in models)


def with_mean(windows: DataFrame, models: Sequence[Forecaster], cfg: Config) -> DataFrame:
    """Windows with the mean of their input, if a model asks for it. Windows cut with `mean=True` have it from running
    sums; of others, whose x is whole, it is computed here."""
    if not needs_mean(models) or "x_mean" in windows.columns:
        return windows
    return windows.withColumn("x_mean", array_mean(F.col("x"), cfg.input_size))


def forecast(
    windows: DataFrame, keys: Sequence[str], model: Forecaster, cfg: Config, start: int = 0
) -> DataFrame:
    """(keys, win, y_hat[, y]) from windows with an input array `x` that begins at `start`."""
    carried = ["y"] if "y" in windows.columns else []
    windows = with_mean(windows, [model], cfg)
    return windows.select(*keys, "win", model.predict(F.col("x"), cfg, start).alias("y_hat"), *carried)


def lag_pairs(
    series: DataFrame, keys: Sequence[str], target: str, lag: int, first: int, last: int
) -> DataFrame:
    """(keys, index, y, y_lag) for targets at first..last.

    The lag runs inside one entity, whose rows the grid bounds.
    """
    needed = series.where(F.col("index").between(first - lag, last))
    order = Window.partitionBy(*keys).orderBy("index")
    lagged = needed.select(
        *keys, "index", F.col(target).alias("y"), F.lag(target, lag).over(order).alias("y_lag")
    )
    return lagged.where(F.col("index").between(first, last) & F.col("y_lag").isNotNull())


def training_targets(cfg: Config) -> tuple[int, int]:
    """Index range that the outputs of the training windows cover."""
    return cfg.input_size + 1, cfg.boundary


def target_weight(index: Column, cfg: Config, held_out: Callable[[Column], Column]) -> Column:
    """Number of training windows, those held out excepted, that have a grid index among their outputs."""
    low = F.greatest(index - cfg.input_size - cfg.output_size + 1, F.lit(1))
    high = F.least(index - cfg.input_size, F.lit(cfg.last_train_window))
    wins = F.filter(F.sequence(low, high), lambda w: ~held_out(w))
    return F.when(low <= high, F.size(wins)).otherwise(0).cast("double")


def _line(y: str, x: str, weight: str | None) -> tuple[Column, Column]:
    """Slope and intercept of a least-squares line as aggregates; a constant input gives slope 0 and the mean."""
    if weight is None:
        slope, intercept = F.regr_slope(y, x), F.regr_intercept(y, x)
        return F.coalesce(slope, F.lit(0.0)), F.coalesce(intercept, F.avg(y))
    w, v, u = F.col(weight), F.col(x), F.col(y)
    n, sx, sy = F.sum(w), F.sum(w * v), F.sum(w * u)
    slope = F.coalesce(F.try_divide(n * F.sum(w * v * u) - sx * sy, n * F.sum(w * v * v) - sx * sx), F.lit(0.0))
    return slope, F.try_divide(sy - slope * sx, n)


def fit_lag_regression(
    series: DataFrame, keys: Sequence[str], target: str, lag: int, cfg: Config,
    held_out: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(keys, slope, intercept) per entity. With `held_out`, a rule on window numbers, each target counts as often as
    training windows that are not held out contain it."""
    _check_lag(lag, cfg)
    pairs = lag_pairs(series, keys, target, lag, *training_targets(cfg))
    if held_out is not None:
        pairs = pairs.withColumn("_w", target_weight(F.col("index"), cfg, held_out))
    slope, intercept = _line("y", "y_lag", "_w" if held_out is not None else None)
    return pairs.groupBy(*keys).agg(slope.alias("slope"), intercept.alias("intercept"))


def fit_appliance_regression(
    appliance: DataFrame, sensors: Sequence[str], lag: int, cfg: Config,
    held_out: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(dataid, sensor, slope, intercept) from the wide appliance table: one window and one grouped
    aggregate for all sensors, unpivoted when only one row per household is left."""
    _check_lag(lag, cfg)
    first, last = training_targets(cfg)
    order = Window.partitionBy("dataid").orderBy("index")
    needed = appliance.where(F.col("index").between(first - lag, last))
    lagged = needed.select("dataid", "index", *sensors, *[F.lag(s, lag).over(order).alias(f"{s}_lag") for s in sensors])
    if held_out is not None:
        lagged = lagged.withColumn("_w", target_weight(F.col("index"), cfg, held_out))
    fits = []
    for s in sensors:
        slope, intercept = _line(s, f"{s}_lag", "_w" if held_out is not None else None)
        fits.append(F.struct(F.lit(s).alias("sensor"), slope.alias("slope"), intercept.alias("intercept")))
    grouped = lagged.where(F.col("index") >= first).groupBy("dataid").agg(F.array(*fits).alias("fits"))
    return grouped.select("dataid", F.inline("fits"))


def fit_lines(table: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, intercept, weights): least squares of `y` by the lag columns of each group, from co-moments.

    The lags that others explain, and constant ones, get weight 0.
    """
    states = table.groupBy(*by).agg(moments(["y", *names]).alias("_state"))
    fits = states.select(*by, line(F.col("_state"), 0, range(1, len(names) + 1)).alias("_fit"))
    return fits.select(*by, "_fit.intercept", "_fit.weights")


def fit_regression(
    series: DataFrame, keys: Sequence[str], target: str, lags: Sequence[int], cfg: Config, by: Sequence[str] = (),
) -> DataFrame:
    """(by, intercept, weights) of a linear model over several lags: one for all entities, or one for each group
    of the keys in `by`."""
    for lag in lags:
        _check_lag(lag, cfg)
    table, names = lagged_table(series, keys, target, lags, *training_targets(cfg))
    return fit_lines(table, names, by)


def lagged_table(
    series: DataFrame, keys: Sequence[str], target: str, lags: Sequence[int], first: int, last: int
) -> tuple[DataFrame, list[str]]:
    """(keys, index, y, lag columns) for targets at first..last with all lags known."""
    order = Window.partitionBy(*keys).orderBy("index")
    names = [f"lag_{lag}" for lag in lags]
    columns = [F.lag(target, lag).over(order).alias(n) for lag, n in zip(lags, names)]
    needed = series.where(F.col("index").between(first - max(lags), last))
    table = needed.select(*keys, "index", F.col(target).alias("y"), *columns)
    return table.where(F.col("index").between(first, last)).dropna(subset=names), names


def lagged_appliances(
    appliance: DataFrame, households: DataFrame, lags: Sequence[int], cfg: Config, first: int, last: int,
) -> tuple[DataFrame, list[str]]:
    """(city, community, dataid, sensor, index, y, lag columns) of the sensors each household has.

    Wide rows are gathered per household once; lags are look-ups in its arrays, made into rows sensor by sensor.
    """
    reach, names = max(lags), [f"lag_{lag}" for lag in lags]
    blocks = series_blocks(appliance, ["dataid"], cfg.appliances, reach + 1, first - reach, last - reach)
    placed = blocks.join(households.select("city", "community", "dataid", "sensors"), "dataid")
    keys = ["city", "community", "dataid"]
    long = placed.select(*keys, "_first", "_last", F.inline(per_sensor(cfg, lambda s: F.col(f"rows.{s}"))))

    def row(start: Column) -> Column:
        at = start - F.col("_first") + reach
        past = [F.get("values", at - lag).alias(n) for lag, n in zip(lags, names)]
        return F.struct((start + reach).alias("index"), F.get("values", at).alias("y"), *past)

    rows = long.select(*keys, "sensor", F.inline(F.transform(F.sequence("_first", "_last"), row)))
    return rows.dropna(subset=names), names


def _add_scaled(total: Column, part: Column, weight: Column) -> Column:
    return F.zip_with(total, part, lambda acc, v: acc + v * weight)


def lags_part(lags: Sequence[int], cfg: Config) -> tuple[int, int]:
    """(offset, length) of the input window that a regression over `lags` reads."""
    for lag in lags:
        _check_lag(lag, cfg)
    return cfg.input_size - max(lags), max(lags) - min(lags) + cfg.output_size


def apply_regression(
    windows: DataFrame, keys: Sequence[str], fits: DataFrame, lags: Sequence[int], cfg: Config, start: int = 0
) -> DataFrame:
    """Forecasts of `fit_regression`: a fit for all entities is a scalar subquery of one row, fits of groups are joined.
    The input `x` of the windows begins at `start`."""
    by = [c for c in fits.columns if c not in ("intercept", "weights")]
    coefficients = F.struct("intercept", "weights").alias("_fit")
    if by:
        beside = windows.join(fits.select(*by, coefficients), by)
    else:
        beside = windows.withColumn("_fit", fits.select(coefficients).scalar())
    y_hat = F.array_repeat(F.col("_fit.intercept"), cfg.output_size)
    for i, lag in enumerate(lags):
        y_hat = _add_scaled(y_hat, _lagged(F.col("x"), lag, cfg, start), F.get("_fit.weights", F.lit(i)))
    carried = ["y"] if "y" in windows.columns else []
    return beside.select(*keys, "win", y_hat.alias("y_hat"), *carried)


def _series_forecasts(
    name: dict, index, inputs, outputs, n_in: int, n_out: int, fit_predict: Callable, train: tuple[int, int],
    predict: tuple[int, int],
):
    """What a user model gives for one series: arrays sorted by index, inputs of shape (rows, columns)."""
    import numpy as np

    first = int(index[0]) if len(index) else 0
    # Windows are views by position: a late start, a gap or a short series would shift them unnoticed.
    if not len(index) or first > train[0] or index[-1] < predict[1] + n_in - 1 or (np.diff(index) != 1).any():
        raise ValueError(f"{name}: the series must run without gaps from {train[0]} to {predict[1] + n_in - 1}; it has "
                         f"{len(index)} rows from {first} to {int(index[-1]) if len(index) else 0}")
    x = np.lib.stride_tricks.sliding_window_view(inputs, n_in, axis=0).transpose(0, 2, 1)
    y = np.lib.stride_tricks.sliding_window_view(outputs, n_out)

    def part(array, bounds, offset=0):
        return array[bounds[0] - first + offset: bounds[1] - first + offset + 1]

    return fit_predict(part(x, train), part(y, train, n_in), part(x, predict))


def user_model(
    series: DataFrame, keys: Sequence[str], cfg: Config, fit_predict: Callable, columns: Sequence[str],
    target: str, train: tuple[int, int], predict: tuple[int, int], normalized: DataFrame | None = None,
) -> DataFrame:
    """Forecasts of a user-supplied model per entity: (keys, win, y_hat).

    Columns other than the target are read from `normalized` where it is given, a table with the same rows: both travel
    to the entity's task once and are paired there by index, without a join of all rows.

    `fit_predict(x_train, y_train, x_test)` gets numpy arrays: inputs of shape (windows, input,
    columns), raw outputs (windows, output), and returns (test windows, output). Only the series
    of an entity crosses to Python (the grid bounds its rows); windows are views of it, never
    copies. Rows of one entity go to one task, entities to many.
    """
    fields = {f.name: f for f in series.schema}
    schema = T.StructType(
        [fields[k] for k in keys]
        + [T.StructField("win", T.IntegerType()), T.StructField("y_hat", T.ArrayType(T.DoubleType()))]
    )
    n_in, n_out, names, key_names = cfg.input_size, cfg.output_size, list(columns), list(keys)

    def run(group, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("index")
        if normalized_names is not None:
            scaled = pdf["_scaled"].to_numpy(dtype=bool)
            pdf, other = pdf[~scaled].copy(), pdf[scaled]
            if not np.array_equal(pdf["index"].to_numpy(), other["index"].to_numpy()):
                raise ValueError(f"{dict(zip(key_names, group))}: raw and normalised rows differ")
            pdf[normalized_names] = other[normalized_names].to_numpy(dtype="float64")
        y_hat = _series_forecasts(
            dict(zip(key_names, group)), pdf["index"].to_numpy(), pdf[names].to_numpy(dtype="float64"),
            pdf[target].to_numpy(dtype="float64"), n_in, n_out, fit_predict, train, predict)
        out = pd.DataFrame({"win": np.arange(predict[0], predict[1] + 1, dtype="int32"), "y_hat": list(y_hat)})
        for i, (name, value) in enumerate(zip(key_names, group)):
            out.insert(i, name, value)
        return out

    if normalized is None:
        normalized_names = None
        rows = series.select(*dict.fromkeys([*keys, "index", *columns, target]))
    else:
        normalized_names = [c for c in columns if c != target]
        raw = series.select(*keys, "index", target, F.lit(False).alias("_scaled"))
        rows = raw.unionByName(
            normalized.select(*keys, "index", *normalized_names, F.lit(True).alias("_scaled")), allowMissingColumns=True)
    return rows.groupBy(*keys).applyInPandas(run, schema)


def user_model_by_sensor(
    appliance: DataFrame, normalized: DataFrame, households: DataFrame, cfg: Config, fit_predict: Callable,
    columns: Sequence[str], train: tuple[int, int], predict: tuple[int, int],
) -> DataFrame:
    """Forecasts of a user model for each sensor that a household has: (city, community, dataid, sensor, win, y_hat).

    Raw and normalised rows of a household stay wide and travel to its task once; its path and its sensors travel beside
    them as one row of their own. Rows arrive as a stream of Arrow batches; the model then runs sensor by sensor and each
    sensor's forecasts leave as a batch of their own, so a task holds one household's rows (the grid bounds them) and one
    sensor's windows.
    """
    sensors, features = list(cfg.appliances), [c for c in columns if c in FEATURES]
    id_type = appliance.schema["dataid"].dataType
    homes = households.where(F.col("dataid").isNotNull()).select(
        F.col("dataid").cast(id_type).alias("dataid"), F.lit(2).alias("_kind"), "city", "community",
        F.col("sensors").alias("_owned"))
    raw = appliance.select("dataid", "index", F.lit(0).alias("_kind"), *sensors)
    scaled = normalized.select("dataid", "index", F.lit(1).alias("_kind"), *sensors, *features)
    rows_of = raw.unionByName(scaled, allowMissingColumns=True)
    known = rows_of.join(homes.select("dataid").distinct(), "dataid", "left_semi")
    wide = known.unionByName(homes, allowMissingColumns=True)
    keys, n_in, n_out = ["city", "community", "dataid"], cfg.input_size, cfg.output_size
    types = {f.name: f.dataType for f in wide.schema}
    schema = T.StructType(
        [T.StructField(k, types[k]) for k in keys]
        + [T.StructField("sensor", T.StringType()), T.StructField("win", T.IntegerType()),
           T.StructField("y_hat", T.ArrayType(T.DoubleType()))])
    arrow_types = [to_arrow_type(types[k]) for k in keys]

    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        parts, places, dataid = [], [], group[0].as_py()
        for batch in batches:
            kind = batch.column("_kind").to_numpy(zero_copy_only=False)
            home, batch = batch.filter(pa.array(kind == 2)), batch.filter(pa.array(kind != 2))
            places.extend(zip(*[home.column(c).to_pylist() for c in ("city", "community", "_owned")]))
            if batch.num_rows:
                parts.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("index", "_kind", *sensors, *features)})
        if not parts or not places:
            return
        if len({place[:2] for place in places}) < len(places):
            raise ValueError(f"household {dataid}: the hierarchy has it more than once at one place")
        rows = {c: np.concatenate([p.pop(c) for p in parts]) for c in list(parts[0])}
        is_scaled = rows.pop("_kind") == 1
        order = {kind: np.flatnonzero(is_scaled == kind)[np.argsort(rows["index"][is_scaled == kind], kind="stable")]
                 for kind in (False, True)}
        index = rows["index"][order[False]]
        if not np.array_equal(index, rows["index"][order[True]]):
            raise ValueError(f"household {dataid}: raw and normalised rows differ")
        wins = pa.array(np.arange(predict[0], predict[1] + 1, dtype="int32"))
        for city, community, owned in places:
            for sensor in sensors:
                if sensor not in (owned or []):
                    continue
                source = {"scaled": (sensor, True), "total": (sensor, False)} | {f: (f, True) for f in features}
                inputs = np.column_stack([
                    rows[name][order[kind]].astype("float64") for name, kind in (source[c] for c in columns)])
                y_hat = _series_forecasts(
                    {"dataid": dataid, "sensor": sensor}, index, inputs, rows[sensor][order[False]].astype("float64"),
                    n_in, n_out, fit_predict, train, predict)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(wins), type=t) for k, t in zip((city, community, dataid), arrow_types)]
                    + [pa.array([sensor] * len(wins)), wins,
                       pa.array([row.tolist() for row in np.asarray(y_hat, dtype="float64")], type=pa.list_(pa.float64()))],
                    names=[*keys, "sensor", "win", "y_hat"])

    return wide.groupBy("dataid").applyInArrow(run, schema)
