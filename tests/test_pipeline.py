"""CSV files through the whole pipeline, against a brute-force computation in pandas."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterload.config import FEATURES, LEVELS, Config
from meterload.operators.forecast import GlobalRegression, LagRegression, SeasonalNaive, UserModel, WindowMean
from meterload.operators.hierarchy import subtree
from meterload.plans.experiment import evaluate, evaluate_stored, load_statistics
from meterload.plans.preprocess import Store, build_levels, preprocess
from meterload.sources.csv import read_evaluations, read_profile_csv, read_training_logs
from meterload.sources.tables import read_entity, read_table

N, I, O = 64, 8, 3
START = datetime(2018, 6, 1, 5)
CFG = Config(
    from_time=START, end_time=START + timedelta(minutes=15 * (N - 1)), input_size=I, output_size=O,
    sensors=("air1", "car1", "solar", "grid"), community_size=2,
)
# id -> (city, year of its readings); one city has an odd household, one home starts too late.
HOMES = {3: ("Austin", 2018), 5: ("Austin", 2017), 8: ("Austin", 2018), 9: ("Austin", 2016), 12: ("Austin", 2018),
         20: ("Boulder", 2018), 21: ("Boulder", 2015), 30: ("Boulder", 2018), 40: (None, 2018)}
LATE = 30
PLACED = {3: 1, 5: 1, 8: 2, 9: 2, 20: 4, 21: 4}
CITY = {1: "Austin", 2: "Austin", 4: "Boulder"}
SIGN = {"air1": 1, "car1": 1, "solar": -1}


def raw_readings():
    rng = np.random.default_rng(11)
    rows = []
    for home, (_, year) in HOMES.items():
        start = START.replace(year=year) - timedelta(minutes=30)
        for k in range(N + 4):
            moment = start + timedelta(minutes=15 * k)
            inner = 2 < k < N + 1
            if (inner and rng.random() < 0.3) or (home == LATE and k < 10):
                continue
            values = [round(float(v), 2) if rng.random() < 0.8 else None for v in rng.uniform(0, 9, 4)]
            if home == 5:
                values[2] = None                      # this household has no solar
            local = moment - timedelta(hours=5)
            for _ in range(2 if rng.random() < 0.1 else 1):
                rows.append((home, f"{local:%Y-%m-%d %H:%M:%S}-05", *values))
    return pd.DataFrame(rows, columns=["dataid", "local_15min", "air1", "car1", "solar", "grid"])


def expected(raw):
    """Filled sensors by household: {home: DataFrame over index 1..N}."""
    moments = pd.to_datetime(raw.local_15min, utc=True).dt.tz_localize(None)
    raw = raw.assign(ts=[m.replace(year=2018) for m in moments])
    raw["index"] = ((raw.ts - START).dt.total_seconds() / 900 + 1).astype(int)
    out = {}
    for home in PLACED:
        part = raw[raw.dataid == home].groupby("index")[list(SIGN)].mean().reindex(range(1, N + 1))
        out[home] = part.ffill(limit=CFG.fill_rows).fillna(0.0)
    return out


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    raw = raw_readings()
    (root / "in").mkdir()
    orders = (["unused", "grid", "solar", "air1", "dataid", "car1", "local_15min"],
              ["dataid", "local_15min", "air1", "car1", "grid", "solar"])
    for part, rows in raw.groupby(raw.dataid % 2):  # a folder for each order of columns, as deliveries have them
        (root / "in" / f"part_{part}").mkdir()
        rows.assign(unused=1)[orders[part]].to_csv(
            root / "in" / f"part_{part}" / "minutes.csv", index=False, na_rep=("", "NaN")[part])
    lines = ["dataid,extra,city,state", "unique id,note,city of home,state of home"]
    lines += [f"{h},n{h},{c},TX" for h, (c, _) in HOMES.items() if c]
    (root / "meta.csv").write_text("\n".join(lines) + "\n")
    store = Store(str(root / "out"))
    tables = preprocess(spark, f"{root}/in/part_*/minutes.csv", f"{root}/meta.csv", store, CFG, extra=["extra"])
    return {"root": root, "raw": raw, "store": store, "tables": tables, "want": expected(raw)}


def totals(want):
    household = {h: sum(SIGN[s] * t[s] for s in SIGN) for h, t in want.items()}
    community = {c: sum(household[h] for h, k in PLACED.items() if k == c) for c in CITY}
    city = {n: sum(community[c] for c, k in CITY.items() if k == n) for n in set(CITY.values())}
    return {"household": household, "community": community, "city": city}


def test_hierarchy_and_profile(spark, run):
    meta = run["tables"]["metadata"].toPandas().set_index("dataid")
    assert meta.community.to_dict() == PLACED
    assert meta.delta_year.to_dict() == {3: 0, 5: 1, 8: 0, 9: 2, 20: 0, 21: 3}
    assert not meta.solar[5] and meta.solar[3]
    counts = run["raw"].groupby("dataid").size()
    for home in PLACED:
        assert meta.data_availability[home] == pytest.approx(counts[home] / (N + 4))
    shown = read_profile_csv(spark, f"{run['store'].root}/metadata_csv", CFG, extra=["extra"]).toPandas().set_index("dataid")
    assert shown.community.to_dict() == PLACED and shown.extra[9] == "n9"
    assert shown.egauge_1min_data_availability[3] == np.floor(counts[3] / (N + 4) * 10000) / 100


def test_levels(run):
    tables, want = run["tables"], run["want"]
    appliance = tables["appliance"].toPandas().sort_values(["dataid", "index"])
    assert set(appliance.dataid) == set(PLACED) and "grid" not in appliance
    for home, part in appliance.groupby("dataid"):
        for s in SIGN:
            assert part[s].tolist() == pytest.approx(want[home][s].tolist())
    assert appliance.local_15min.iloc[-1] == pd.Timestamp(CFG.end_time)
    for level, key in (("household", "dataid"), ("community", "community"), ("city", "city")):
        table = tables[level].toPandas().sort_values([key, "index"])
        assert set(FEATURES) <= set(table.columns)
        for entity, part in table.groupby(key):
            assert part.total.tolist() == pytest.approx(totals(want)[level][entity].tolist())
        scaled = tables[f"normalized_{level}"].toPandas()
        assert scaled.total.mean() == pytest.approx(0, abs=1e-9) and scaled.total.std() == pytest.approx(1)
        assert scaled.hourofday.between(0, 1).all()
    z = tables["normalized_appliance"].toPandas()
    for s in SIGN:
        assert z[s].mean() == pytest.approx(0, abs=1e-9) and z[s].std() == pytest.approx(1)


def test_pruned_reads_of_one_household(spark, run):
    got = read_entity(spark, run["store"].level("household"), "dataid", 9, ["index", "total"])
    assert got.orderBy("index").toPandas().total.tolist() == pytest.approx(totals(run["want"])["household"][9].tolist())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(entity_bucket_of_256" in plan or "PartitionFilters: [entity_bucket_of_256" in plan, plan
    late = read_table(spark, run["store"].level("city"), ["total"], F.col("index") > 60)
    assert "GreaterThan(index,60)" in late._jdf.queryExecution().executedPlan().toString()


def test_rerun_is_idempotent(spark, run):
    before = run["tables"]["household"].count()
    readings_path, meta_path = f"{run['root']}/in/part_*/minutes.csv", f"{run['root']}/meta.csv"
    again = preprocess(spark, readings_path, meta_path, run["store"], CFG, extra=["extra"])
    assert again["household"].count() == before == N * len(PLACED)
    run["tables"] = again                              # the files the old frames list are gone


def naive_errors(want, lags):
    """{(base, level): (mean mae, mean rmse)} of seasonal naive forecasts, by loops."""
    windows = range(CFG.test_start, CFG.last_window + 1)
    actual = totals(want)
    sensors = {(h, s): want[h][s] for h in PLACED for s in SIGN if not (h == 5 and s == "solar")}

    def cut(series, lag):
        v = series.to_numpy()
        return np.array([v[w - 1 + I - lag: w - 1 + I - lag + O] for w in windows])

    report = {}
    for base in LEVELS:
        series = sensors if base == "appliance" else actual[base]
        level_hat = {k: cut(v, lags[base]) for k, v in series.items()}
        level_true = {k: cut(v, 0) for k, v in series.items()}
        for level in LEVELS[LEVELS.index(base):]:
            errors = [level_hat[k] - level_true[k] for k in level_hat]
            report[base, level] = (
                np.mean([np.abs(e).mean(axis=1).mean() for e in errors]),
                np.mean([np.sqrt((e ** 2).mean()) for e in errors]),
            )
            if level == "city":
                break
            parent = LEVELS[LEVELS.index(level) + 1]
            up = {"household": lambda k: k[0], "community": PLACED.get, "city": CITY.get}[parent]
            sign = (lambda k: SIGN[k[1]]) if level == "appliance" else (lambda k: 1)
            level_hat = {p: sum(sign(k) * v for k, v in level_hat.items() if up(k) == p) for p in actual[parent]}
            level_true = {p: cut(actual[parent][p], 0) for p in level_hat}
    return report


def test_evaluation_of_every_path(spark, run):
    lags = {"appliance": 3, "household": 5, "community": 8, "city": 4}
    models = {level: SeasonalNaive(lag) for level, lag in lags.items()}
    result = evaluate(spark, run["tables"], run["store"], "naive", CFG, models)
    want = naive_errors(run["want"], lags)
    got = {(r.base_level, r.level): (r.mae_mean, r.rmse_mean) for r in result["report"].collect()}
    assert set(got) == set(want) and len(got) == 10
    for key, pair in want.items():
        assert got[key] == pytest.approx(pair)
    rows = result["evaluation"].where("base_level = 'appliance' AND level = 'city'")
    assert rows.count() == 2 * (CFG.last_window - CFG.test_start + 1)
    again = evaluate_stored(spark, run["store"], "naive", CFG, run["tables"]["metadata"])["report"]
    assert {(r.base_level, r.level): r.mae_mean for r in again.collect()} == {k: v[0] for k, v in got.items()}


def test_variants_without_appliances_and_with_regression(spark, run):
    levels = ("household", "community", "city")
    result = evaluate(spark, run["tables"], run["store"], "regression", CFG, LagRegression(4), levels)
    assert result["report"].count() == 6
    full = evaluate(spark, run["tables"], run["store"], "regression_all", CFG, LagRegression(4), ("appliance",))
    assert {r.level for r in full["report"].collect()} == set(LEVELS)


def test_search_on_a_subtree(spark, run):
    candidates = (SeasonalNaive(3), LagRegression(4), LagRegression(8), WindowMean())
    scope = subtree(run["tables"]["metadata"], city="Austin", community=1)
    result = evaluate(
        spark, run["tables"], run["store"], "search", CFG, levels=("appliance", "household"),
        candidates=candidates, scope=scope)
    got = {(r.base_level, r.level) for r in result["report"].collect()}
    assert len(got) == 7
    best = spark.read.parquet(run["store"].run("search", "best/household"))
    assert {r.dataid for r in best.collect()} == {3, 5}
    assert {r.candidate for r in best.collect()} <= {c.name for c in candidates}


def test_user_and_global_models_at_every_level(spark, run):
    def last_value(x_train, y_train, x_test):
        assert x_train.shape[1:] == (I, 8) and len(y_train) == CFG.last_train_window
        return x_test[:, -1:, 0].repeat(O, axis=1)

    for name, model in (("user", UserModel(last_value)), ("global", GlobalRegression((3, 5)))):
        result = evaluate(spark, run["tables"], run["store"], name, CFG, model)
        assert result["report"].count() == 10


def test_a_missing_forecast_fails(spark, run):
    store, name = run["store"], "holes"
    evaluate(spark, run["tables"], store, name, CFG, SeasonalNaive(4), ("city",))
    path = store.run(name, "forecasts")
    kept = spark.read.parquet(path).where("city <> 'Austin' OR win > 55").toPandas()
    spark.createDataFrame(kept, spark.read.parquet(path).schema).write.mode("overwrite").partitionBy(
        "base_level", "level").parquet(path)
    with pytest.raises(Exception, match="no forecast for the actual"):
        evaluate_stored(spark, store, name, CFG, run["tables"]["metadata"], ("city",))


def test_load_statistics(run):
    got = {r.level: (r["mean"], r["std"]) for r in load_statistics(run["tables"], CFG).collect()}
    actual, test = totals(run["want"]), slice(CFG.test_start - 1, None)
    mean = np.mean([v.iloc[test].mean() for v in actual["city"].values()])
    sensors = [run["want"][h][s].iloc[test].std() for h in PLACED for s in SIGN if not (h == 5 and s == "solar")]
    counts = {"appliance": len(sensors), "household": 6, "community": 3, "city": 2}
    for level in LEVELS:
        std = np.mean(sensors if level == "appliance" else [v.iloc[test].std() for v in actual[level].values()])
        assert got[level] == pytest.approx((mean * 2 / counts[level], std))


def test_entity_layout_gives_the_same_levels(spark, run, tmp_path):
    readings = run["tables"]["appliance"].withColumn("grid", F.lit(None).cast("double"))
    cfg = CFG.with_(years=False)
    tables = build_levels(spark, readings, run["tables"]["metadata"], Store(str(tmp_path)), cfg, layout="entity")
    for level in LEVELS:
        columns = [c for c in run["tables"][level].columns]
        assert tables[level].select(*columns).exceptAll(run["tables"][level]).count() == 0
    one = read_entity(spark, Store(str(tmp_path)).level("household"), "dataid", 9, ["index"])
    assert one.count() == N


def test_log_and_evaluation_trees(spark, tmp_path):
    for home in (1, 2):
        folder = tmp_path / "appliances" / f"household={home}" / "appliance=air1"
        folder.mkdir(parents=True)
        (folder / "history_log_full.csv").write_text(f"epoch,loss,root_mean_squared_error\n0,{home}.0,2.0\n1,0.5,1.0\n")
        (folder / "evaluation.csv").write_text("mae,rmse\n1.0,2.0\n3.0,2.0\n")
    from meterload.operators.evaluate import summarize_table
    from meterload.operators.report import curve_by_appliance, curve_of_appliances, key_from_path

    logs = key_from_path(read_training_logs(spark, f"{tmp_path}/appliances/household=*/appliance=*/history_log_full.csv"), "appliance")
    curve = curve_by_appliance(logs)
    assert {tuple(r) for r in curve.collect()} == {("air1", 0, 1.5, 2.0), ("air1", 1, 0.5, 1.0)}
    assert curve_of_appliances(curve).count() == 2
    evaluations = key_from_path(read_evaluations(spark, str(tmp_path)), "household")
    rows = summarize_table(evaluations, ["household"]).collect()
    assert {r.household for r in rows} == {"1", "2"}
    assert all(r.mae_mean == 2.0 and r.mae_std == pytest.approx(2 ** 0.5) and r.rmse_std == 0.0 for r in rows)
