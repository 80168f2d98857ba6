"""Steps that many queries share: tables written without a second shuffle, trees of small files, sums of windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterload.config import FEATURES
from meterload.fixtures import HOURLY
from meterload.operators import bottomup, evaluate, windows
from meterload.operators.forecast import apply_regression, lags_part, user_model, user_model_by_sensor
from meterload.sources.csv import write_tree
from meterload.sources.tables import read_entities, read_table, write_table

CFG = HOURLY.with_(input_size=6, output_size=2)
HOMES = "city STRING, community INT, dataid BIGINT, sensors ARRAY<STRING>"




def test_a_copy_of_a_dealt_table_is_not_shuffled(spark, tmp_path, monkeypatch):
    rows = spark.range(60).selectExpr("id % 12 AS dataid", "CAST(id DIV 12 AS INT) AS index", "id * 1.5D AS total")
    write_table(rows, f"{tmp_path}/raw", key="dataid", buckets=4, finish=lambda df: df.withColumn("twice", F.col("total") * 2))
    raw = read_table(spark, f"{tmp_path}/raw")
    assert raw.where("twice <> total * 2").isEmpty() and raw.count() == 60
    dealt = []
    monkeypatch.setattr("meterload.sources.tables.spread", lambda df, *keys: dealt.append(keys) or df)
    write_table(raw.withColumn("total", -F.col("total")), f"{tmp_path}/copy", key="dataid", buckets=4, dealt=True)
    assert dealt == []
    copy = read_table(spark, f"{tmp_path}/copy")
    assert sorted(map(tuple, copy.collect())) == sorted((r[0], r[1], -r[2], r[3]) for r in raw.collect())
    assert read_entities(spark, f"{tmp_path}/copy", "dataid", [7]).count() == 5


def test_a_tree_of_small_files_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(200).selectExpr("CAST(id % 40 AS STRING) AS household", "id AS value")
    write_tree(rows, f"{tmp_path}/tree", ["household"])
    back = spark.read.option("header", True).csv(f"{tmp_path}/tree")
    assert sorted(int(r["value"]) for r in back.collect()) == list(range(200))
    parts = {r[0] for r in back.select(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)).distinct().collect()}
    assert len(parts) > 1


def appliances(spark, ids=(1, 2)):
    n = 40
    rows = [(d, i, *[float((d * 7 + i * k) % 11) for k in range(1, len(CFG.appliances) + 1)]) for d in ids for i in range(1, n + 1)]
    raw = spark.createDataFrame(rows, "dataid BIGINT, index INT, " + ", ".join(f"{s} DOUBLE" for s in CFG.appliances))
    scaled = raw.withColumns({s: F.col(s) / 10 for s in CFG.appliances})
    return raw, scaled.withColumns({f: F.col("index") / (k + 2.0) for k, f in enumerate(FEATURES)})


@pytest.mark.parametrize("block", [None, 5])
def test_totals_of_windows_are_the_sums_of_their_inputs(spark, block):
    raw, scaled = appliances(spark)
    homes = spark.createDataFrame([("X", 1, 1, ["car1", "solar"]), ("X", 1, 2, ["car1"])], HOMES)
    cut = windows.appliance_pairs(raw, scaled, homes, CFG, 2, 25, block, totals=True)
    rows = cut.collect()
    assert len(rows) == 3 * 24
    for r in rows:
        for f in ("y", *FEATURES):
            assert r[f"total_{f}"] == pytest.approx(sum(v[f] for v in r["x"]), abs=1e-9)


def test_sensors_of_a_user_model_keep_their_path(spark):
    raw, scaled = appliances(spark, (1, 2, 3))
    homes = spark.createDataFrame([("X", 1, 1, ["car1", "solar"]), ("Y", 2, 2, []), ("Y", 2, 9, ["car1"])], HOMES)

    def last(x_train, y_train, x_test):
        return x_test[:, -1, :1].repeat(CFG.output_size, axis=1)

    out = user_model_by_sensor(raw, scaled, homes, CFG, last, ("scaled", *FEATURES), (1, 10), (20, 22))
    got = sorted((r["city"], r["community"], r["dataid"], r["sensor"], r["win"], tuple(r["y_hat"])) for r in out.collect())
    values = {(r["dataid"], r["index"]): r for r in scaled.collect()}
    want = sorted(("X", 1, 1, s, w, (values[1, w + 5][s],) * 2) for s in ("car1", "solar") for w in (20, 21, 22))
    assert got == want


def test_a_user_model_pairs_raw_and_normalised_rows_in_its_task(spark):
    raw = spark.range(1, 41).selectExpr("'X' AS city", "CAST(id AS INT) AS index", "CAST(id AS DOUBLE) AS total")
    normal = raw.selectExpr("city", "index", "total / 10 AS scaled")

    def both(x_train, y_train, x_test):
        return x_test.sum(axis=1) + y_train.mean()

    args = (["city"], CFG, both, ("scaled", "total"), "total", (1, 10), (20, 22))
    want = user_model(raw.join(normal, ["city", "index"]), *args).collect()
    got = user_model(raw, *args, normal).collect()
    for a, b in zip(sorted(got), sorted(want)):
        assert (a["city"], a["win"]) == (b["city"], b["win"]) and np.allclose(a["y_hat"], b["y_hat"])
    with pytest.raises(Exception, match="raw and normalised rows differ"):
        user_model(raw, *args, normal.where("index <> 5")).collect()


def test_a_regression_reads_only_the_lagged_part_of_a_window(spark):
    series = spark.range(1, 41).selectExpr("'X' AS city", "CAST(id AS INT) AS index", "CAST(id * id % 13 AS DOUBLE) AS total")
    fits = spark.createDataFrame([(1.0, [0.5, 0.25])], "intercept DOUBLE, weights ARRAY<DOUBLE>")
    start, length = part = lags_part((2, 4), CFG)
    assert part == (2, 4)
    whole = windows.value_windows(series, ["city"], "total", CFG, 1, 20)
    narrow = windows.value_windows(series, ["city"], "total", CFG, 1, 20, part=part)
    want = apply_regression(whole, ["city"], fits, (2, 4), CFG).collect()
    assert sorted(apply_regression(narrow, ["city"], fits, (2, 4), CFG, start).collect()) == sorted(want)


def paired_blocks(spark, wins, ids=(1, 2)):
    series = spark.range(1, 41).selectExpr("CAST(id AS INT) AS index", "CAST(id * id % 13 AS DOUBLE) AS total")
    series = series.selectExpr("explode(array(1L, 2L)) AS dataid", "index", "total + 1D AS total")
    cut = windows.output_windows(series, ["dataid"], "total", CFG, 5, 20)
    blocks = windows.output_blocks(series, ["dataid"], "total", CFG, 5, 20)
    kept = cut.where(F.col("dataid").isin(list(ids)) & F.col("win").isin(list(wins)))
    made = kept.selectExpr("'X' AS city", "3 AS community", "dataid", "win", "transform(y, v -> v * 2 + 1) AS y_hat")
    return made, cut, blocks


def test_stored_outputs_hold_each_value_once(spark):
    _, cut, blocks = paired_blocks(spark, range(5, 21))
    rows = {r["dataid"]: r for r in blocks.collect()}
    assert all((r["_first"], r["_last"], len(r["values"])) == (5, 20, 17) for r in rows.values()) and len(rows) == 2
    for r in cut.collect():
        values = rows[r["dataid"]]["values"]
        assert values[r["win"] - 5:r["win"] - 5 + CFG.output_size] == r["y"]


def test_errors_against_blocks_equal_those_against_windows(spark):
    cfg = CFG.with_(test_fraction=0.2)
    made, cut, blocks = paired_blocks(spark, range(5, 21))
    copies = made.unionByName(made.where("dataid = 2").withColumn("community", F.lit(4)))
    both = evaluate.pair_actuals(copies, cut, "household").select("city", "community", "dataid", "win", "y", "y_hat")
    want = evaluate.window_errors(both, cfg)
    got = evaluate.block_errors(copies, blocks, "household", cfg)
    assert got.count() == 48 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("wins, ids, text", [
    ([*range(5, 9), *range(10, 21)], (1, 2), "no forecast for the actual of 1/9|no forecast for the actual of 2/9"),
    (range(6, 21), (1, 2), "no forecast for the actual of [12]/5"), (range(5, 20), (1, 2), "no forecast for the actual of [12]/20"),
    (range(5, 21), (1,), "no forecast for the actual of 2/5"),
])
def test_windows_and_entities_without_a_forecast_fail(spark, wins, ids, text):
    made, _, blocks = paired_blocks(spark, wins, ids)
    with pytest.raises(Exception, match=text):
        evaluate.block_errors(made, blocks, "household", CFG).collect()


def test_forecasts_without_an_actual_fail(spark):
    made, _, blocks = paired_blocks(spark, range(5, 21))
    for rest in (blocks.where("dataid = 1"), blocks.withColumn("_last", F.lit(19))):
        with pytest.raises(Exception, match="no actual for the forecast of"):
            evaluate.block_errors(made, rest, "household", CFG).collect()


def test_errors_of_entities_are_not_shuffled_again(spark):
    made, _, blocks = paired_blocks(spark, range(5, 21))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = evaluate.evaluation_table(bottomup.tag(
            evaluate.block_errors(made, blocks, "household", CFG).where("win > 0"), "household", "household"), CFG)
        plan = table._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32MB")
    assert "Window" in plan and "mae" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
