from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterload.config import FEATURES, Config
from meterload.operators import bottomup, evaluate, forecast, report, search, windows
from meterload.operators.clean import add_time
from meterload.operators.rollup import city_totals, community_totals, household_totals

START = datetime(2018, 6, 4)
N, I, O = 60, 8, 3
CFG = Config(from_time=START, end_time=START + timedelta(minutes=15 * (N - 1)), input_size=I, output_size=O,
             sensors=("air1", "car1", "solar", "grid"))


def series(spark, entities=("x", "y"), seed=0):
    rng = np.random.default_rng(seed)
    data = {e: rng.integers(0, 100, N).astype(float) for e in entities}
    rows = [(e, i + 1, float(v)) for e, vs in data.items() for i, v in enumerate(vs)]
    return data, spark.createDataFrame(rows, "city string, index int, total double").repartition(3)


@pytest.mark.parametrize("block", [None, 5, 1, 1000])
def test_windows_equal_brute_force(spark, block):
    data, df = series(spark)
    first, last = 2, CFG.last_window
    pairs = windows.value_windows(df, ["city"], "total", CFG, first, last, block=block).collect()
    outs = windows.output_windows(df, ["city"], "total", CFG, first, last, block=block).collect()
    assert len(pairs) == len(outs) == 2 * (last - first + 1)
    for r in pairs:
        at = r.win - 1
        assert r.x == data[r.city][at: at + I].tolist() and r.y == data[r.city][at + I: at + I + O].tolist()
    for r in outs:
        assert r.y == data[r.city][r.win - 1 + I: r.win - 1 + I + O].tolist()


def test_input_structs_hold_target_and_features(spark):
    data, df = series(spark, ("x",))
    table = add_time(df, CFG)
    row = windows.input_windows(table, ["city"], "total", CFG, 5, 5).first()
    assert [s.y for s in row.x] == data["x"][4: 4 + I].tolist()
    assert [s.minuteofhour for s in row.x] == [(15 * (4 + k)) % 60 for k in range(I)]
    assert list(row.x[0].asDict()) == ["y", *FEATURES]
    pair = windows.training_pairs(table.withColumn("z", F.col("total") * 2), ["city"], "total", "z", CFG, 5, 5).first()
    assert [s.y for s in pair.x] == (2 * data["x"][4: 4 + I]).tolist()
    assert pair.y == data["x"][4 + I: 4 + I + O].tolist()


def test_models_and_search(spark):
    data, df = series(spark)
    keys, first, last = ["city"], CFG.test_start, CFG.last_window
    cut = windows.value_windows(df, keys, "total", CFG, first, last)
    naive = {(r.city, r.win): r.y_hat for r in forecast.forecast(cut, keys, forecast.SeasonalNaive(5), CFG).collect()}
    mean = {(r.city, r.win): r.y_hat for r in forecast.forecast(cut, keys, forecast.WindowMean(), CFG).collect()}
    for (city, win), got in naive.items():
        at = win - 1 + I - 5
        assert got == data[city][at: at + O].tolist()
        assert mean[city, win] == pytest.approx([data[city][win - 1: win - 1 + I].mean()] * O)
    start, length = part = forecast.input_part([forecast.SeasonalNaive(5)], CFG)
    narrow = windows.value_windows(df, keys, "total", CFG, first, last, part=part)
    again = forecast.forecast(narrow, keys, forecast.SeasonalNaive(5), CFG, start).collect()
    assert length == O and {(r.city, r.win): r.y_hat for r in again} == naive

    candidates = (forecast.SeasonalNaive(3), forecast.SeasonalNaive(8), forecast.WindowMean())
    scores = {(r.city, r.candidate): r.val_mae for r in search.score_candidates(cut, keys, candidates, CFG).collect()}
    for city in data:
        errors = [abs(data[city][w - 1 + I + h] - data[city][w - 1 + I + h - 3]) for w in range(first, last + 1) for h in range(O)]
        assert scores[city, "naive_3"] == pytest.approx(np.mean(errors))
    best = search.best_candidates(search.score_candidates(cut, keys, candidates, CFG), keys)
    for r in best.collect():
        assert r.val_mae == min(v for (c, _), v in scores.items() if c == r.city)
    chosen = search.forecast_with_best(cut, keys, best, candidates, CFG)
    assert chosen.where("size(y_hat) = 3").count() == cut.count()
    with pytest.raises(ValueError):
        forecast.SeasonalNaive(2).reads(CFG)


def test_regressions(spark):
    data, df = series(spark)
    fits = {r.city: r for r in forecast.fit_lag_regression(df, ["city"], "total", 4, CFG).collect()}
    xs, ys = [], []
    for city, values in data.items():
        y, x = values[I: CFG.boundary], values[I - 4: CFG.boundary - 4]
        slope, intercept = np.polyfit(x, y, 1)
        assert (fits[city].slope, fits[city].intercept) == pytest.approx((slope, intercept))
        xs.append(x), ys.append(y)
    model = forecast.fit_regression(df, ["city"], "total", [4], CFG).first()
    slope, intercept = np.polyfit(np.concatenate(xs), np.concatenate(ys), 1)
    assert (model.weights[0], model.intercept) == pytest.approx((slope, intercept))
    for by in ([], ["city"]):
        two = forecast.fit_regression(df, ["city"], "total", [4, 7], CFG, by)
        cut = windows.value_windows(df, ["city"], "total", CFG, 10, 10)
        got = forecast.apply_regression(cut, ["city"], two, [4, 7], CFG).where("city = 'x'").first().y_hat
        v, at = data["x"], 9 + I
        fit = two.where("city = 'x'").first() if by else two.first()
        names = list(data) if not by else ["x"]
        rows = np.vstack([np.column_stack([np.ones(CFG.boundary - I), data[c][I - 4: CFG.boundary - 4],
                                           data[c][I - 7: CFG.boundary - 7]]) for c in names])
        want, *_ = np.linalg.lstsq(rows, np.concatenate([data[c][I: CFG.boundary] for c in names]), rcond=None)
        assert [fit.intercept, *fit.weights] == pytest.approx(list(want))
        want = [fit.intercept + fit.weights[0] * v[at + h - 4] + fit.weights[1] * v[at + h - 7] for h in range(O)]
        assert got == pytest.approx(want)
    flat = df.withColumn("total", F.lit(3.0))
    assert forecast.fit_lag_regression(flat, ["city"], "total", 4, CFG).first()[1:] == (0.0, 3.0)


def test_user_model_sees_the_windows(spark):
    data, df = series(spark)
    n_in, n_out = I, O

    def echo(x_train, y_train, x_test):
        assert x_train.shape[1:] == (n_in, 1) and y_train.shape == (x_train.shape[0], n_out)
        return x_test[:, -n_out:, 0] + y_train[0, 0]

    out = forecast.user_model(df, ["city"], CFG, echo, ["total"], "total", (1, CFG.last_train_window),
                              (CFG.test_start, CFG.last_window))
    rows = out.collect()
    assert len(rows) == 2 * (CFG.last_window - CFG.test_start + 1)
    for r in rows:
        at = r.win - 1 + I
        assert r.y_hat == (data[r.city][at - O: at] + data[r.city][I]).tolist()


def hierarchy_fixture(spark):
    rng = np.random.default_rng(3)
    homes = [("A", 1, 10), ("A", 1, 11), ("A", 2, 12), ("B", 3, 13)]
    meta = spark.createDataFrame(homes, "city string, community int, dataid int")
    meta = meta.withColumn("sensors", F.array(F.lit("air1"), F.lit("car1"), F.lit("solar")))
    rows = [(h, i, *map(float, rng.integers(0, 50, 3))) for _, _, h in homes for i in range(1, N + 1)]
    return meta, spark.createDataFrame(rows, "dataid int, index int, air1 double, car1 double, solar double")


def test_perfect_appliance_forecasts_are_perfect_at_every_level(spark):
    meta, appliance = hierarchy_fixture(spark)
    first, last = CFG.test_start, CFG.last_window
    cut = windows.appliance_windows(appliance, meta, CFG, first, last)
    only_y = windows.appliance_windows(appliance, meta, CFG, first, last, with_input=False)
    assert cut.drop("x").exceptAll(only_y).count() == 0 and cut.count() == 12 * (last - first + 1)
    household = household_totals(appliance, CFG)
    community = community_totals(household, meta)
    assert city_totals(community).exceptAll(city_totals(household, meta)).count() == 0
    tables = {"household": (household, ["dataid"]), "community": (community, ["community"]), "city": (city_totals(community), ["city"])}
    actuals = {lv: windows.output_windows(df, k, "total", CFG, first, last) for lv, (df, k) in tables.items()}
    actuals["appliance"] = only_y
    perfect = only_y.withColumnRenamed("y", "y_hat")
    errors = evaluate.evaluate_base(perfect, "appliance", actuals, CFG)
    worst = errors.groupBy("level").agg(F.max("mae").alias("mae"), F.max("sse").alias("sse"), F.count("*").alias("n"))
    got = {r.level: r for r in worst.collect()}
    assert set(got) == {"appliance", "household", "community", "city"}
    assert all(r.mae < 1e-9 and r.sse < 1e-9 for r in got.values())
    assert got["city"].n == 2 * (last - first + 1)
    paired = bottomup.bottom_up_pairs(perfect.join(only_y, [*bottomup.PATH_KEYS["appliance"], "win"]), "appliance", CFG)
    assert paired["city"].where("abs(y[0] - y_hat[0]) > 1e-9").count() == 0


def test_generators_count_negative_above_their_own_level(spark):
    meta, appliance = hierarchy_fixture(spark)
    cut = windows.appliance_windows(appliance, meta, CFG, 50, 50, with_input=False).withColumnRenamed("y", "y_hat")
    levels = bottomup.bottom_up(cut, "appliance", CFG)
    assert levels["appliance"].where("sensor = 'solar' AND y_hat[0] < 0").count() == 0
    want = appliance.where("dataid = 10 AND index = 58").first()
    got = levels["household"].where("dataid = 10").first().y_hat[0]
    assert got == want.air1 + want.car1 - want.solar


def test_summary_and_report(spark):
    rows = [("city", "city", "A", 1, [1.0, 2.0, 3.0], [1.0, 2.0, 6.0]), ("city", "city", "A", 2, [0.0] * 3, [0.0, 3.0, 0.0]),
            ("city", "city", "B", 1, [1.0] * 3, [2.0] * 3)]
    paired = spark.createDataFrame(
        rows, "base_level string, level string, city string, win int, y array<double>, y_hat array<double>"
    ).selectExpr("base_level", "level", "city", "CAST(NULL AS INT) AS community", "CAST(NULL AS BIGINT) AS dataid",
                 "CAST(NULL AS STRING) AS sensor", "win", "y", "y_hat")
    errors = evaluate.window_errors(paired, CFG)
    table = evaluate.evaluation_table(errors, CFG)
    a = table.where("city = 'A'").orderBy("win").collect()
    assert [r.mae for r in a] == [1.0, 1.0] and [r.rmse for r in a] == pytest.approx([3 ** 0.5] * 2)
    summary = {r.city: r for r in evaluate.summarize(errors, CFG).collect()}
    assert summary["A"].rmse_mean == pytest.approx(3 ** 0.5) and summary["A"].rmse_std == 0.0
    assert summary["B"].mae_std is None and summary["B"].rmse_std is None
    stored = {r.city: r for r in evaluate.summarize_table(table).collect()}
    for city, r in stored.items():
        assert (r.mae_mean, r.rmse_mean) == pytest.approx((summary[city].mae_mean, summary[city].rmse_mean))
    only = evaluate.level_report(evaluate.summarize(errors, CFG)).first()
    assert only.mae_mean == 1.0 and only.rmse_mean == pytest.approx((3 ** 0.5 + 1) / 2)


def test_load_statistics(spark):
    meta, appliance = hierarchy_fixture(spark)
    flags = meta.withColumns({s: F.lit(True) for s in CFG.sensors})
    household = household_totals(appliance, CFG)
    std = report.std_of_totals(household, "dataid", CFG).first().std
    table = appliance.toPandas()
    table["total"] = table.air1 + table.car1 - table.solar
    test = table[table["index"] >= CFG.test_start]
    assert std == pytest.approx(test.groupby("dataid").total.std().mean())
    by_sensor = test.groupby("dataid")[["air1", "car1", "solar"]].std().to_numpy().mean()
    assert report.std_of_appliances(appliance, flags, CFG).first().std == pytest.approx(by_sensor)
