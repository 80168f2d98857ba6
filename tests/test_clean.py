from datetime import datetime, timedelta

import numpy as np
import pytest

from meterload.config import Config
from meterload.functions.rows import balance_error, signed_total, smallest_row_for
from meterload.operators.clean import bounded_fill, clean_slots, fill_grid, mask_limit, mask_row_zscore
from meterload.operators.grid import align_readings, expose_gaps, one_per_slot
from meterload.operators.normalize import zscore
from meterload.operators.profile import display_profile, profile_readings


def config(n, sensors=("a", "b"), **changes):
    start = datetime(2018, 6, 1)
    return Config(from_time=start, end_time=start + timedelta(minutes=15 * (n - 1)), sensors=sensors,
                  balance_sensor="grid", generators=(), **changes)


def filled_by_hand(n, readings, limit):
    """Brute force: the latest reading at most `limit` rows back, else 0."""
    out = np.zeros(n + 1)
    for i in range(1, n + 1):
        for k in range(limit + 1):
            if i - k in readings:
                out[i] = readings[i - k]
                break
    return out[1:]


def test_fill_reaches_five_rows(spark):
    cfg = config(9, ("a",))
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 9, 4.0)], "dataid int, index int, a double")
    got = [r.a for r in fill_grid(rows, rows, ["a"], cfg).orderBy("index").collect()]
    assert got == [2.0] * 6 + [0.0, 0.0, 4.0]


@pytest.mark.parametrize("block_rows", [16384, 10, 7])
def test_fill_equals_brute_force_for_any_block_length(spark, block_rows):
    rng, n = np.random.default_rng(5), 60
    cfg = config(n, block_rows=block_rows)
    rows, want = [], {}
    for home in range(1, 9):
        values = {s: {} for s in "ab"}
        for i in range(1, n + 1):
            if rng.random() < (0.05 if home < 4 else 0.5):
                pair = [float(rng.integers(1, 99)) if rng.random() < 0.7 else None for _ in "ab"]
                rows.append((home, i, *pair))
                for s, v in zip("ab", pair):
                    if v is not None:
                        values[s][i] = v
        want[home] = {s: filled_by_hand(n, values[s], cfg.fill_rows) for s in "ab"}
    want[99] = {s: np.zeros(n) for s in "ab"}       # a household without readings
    readings = spark.createDataFrame([*rows, (500, 3, 1.0, 1.0)], "dataid int, index int, a double, b double")
    homes = spark.createDataFrame([(h,) for h in want], "dataid int")
    one_pass = fill_grid(readings, homes, ["a", "b"], cfg)
    two_steps = bounded_fill(expose_gaps(readings, homes, cfg), ["a", "b"], cfg)
    for table in (one_pass, two_steps):
        got = table.orderBy("dataid", "index").toPandas()
        assert set(got.dataid) == set(want)
        for home, part in got.groupby("dataid"):
            assert part["index"].tolist() == list(range(1, n + 1))
            for s in "ab":
                assert part[s].tolist() == want[home][s].tolist()


def test_duplicates_combine_and_may_be_trusted(spark):
    cfg = config(3, ("a",))
    rows = spark.createDataFrame([(1, 2, 1.0), (1, 2, 3.0), (1, 3, None)], "dataid int, index int, a double")
    for rule, want in (("avg", 2.0), ("sum", 4.0), ("min", 1.0), ("max", 3.0)):
        got = clean_slots(rows, rows, cfg.with_(duplicates=rule)).orderBy("index").collect()
        assert [r.a for r in got] == [0.0, want, want]
    assert one_per_slot(rows, cfg.with_(duplicates=None)).count() == 3
    with pytest.raises(ValueError):
        one_per_slot(rows, cfg.with_(duplicates="median"))


def test_row_zscore_needs_eleven_values(spark):
    assert smallest_row_for(3.0) == 11
    for n, kept in ((10, True), (11, False)):
        names = [f"s{i}" for i in range(n)]
        row = spark.createDataFrame([tuple([0.0] * (n - 1) + [100.0])], ", ".join(f"{s} double" for s in names))
        got = mask_row_zscore(row, names, 3.0).first()
        assert (got[names[-1]] is not None) == kept
        assert all(got[s] == 0.0 for s in names[:-1])


def test_row_zscore_skips_missing_values(spark):
    names = [f"s{i}" for i in range(14)]
    values = [1.0, None, None, 1.0] + [2.0] * 9 + [900.0]
    row = spark.createDataFrame([tuple(values)], ", ".join(f"{s} double" for s in names))
    got = mask_row_zscore(row, names, 3.0).first()
    assert got["s13"] is None and got["s1"] is None and got["s4"] == 2.0


def test_limit_masks_both_signs(spark):
    row = spark.createDataFrame([(5.0, -2000.0, None)], "a double, b double, c double")
    assert mask_limit(row, ["a", "b", "c"], 1000.0).first()[:] == (5.0, None, None)


def test_totals_and_balance_of_an_empty_row(spark):
    cfg = Config(sensors=("air1", "car1", "solar", "grid"))
    rows = spark.createDataFrame(
        [(None, None, None, None), (3.0, None, 1.0, 4.0), (3.0, 1.0, 5.0, None)],
        "air1 double, car1 double, solar double, grid double")
    got = rows.select(signed_total(cfg).alias("t"), balance_error(cfg).alias("e")).collect()
    assert [tuple(r) for r in got] == [(0.0, None), (2.0, 2.0), (-1.0, None)]


def test_constant_column_has_no_zscore(spark):
    rows = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "index int, a double, b double")
    got = zscore(rows, ["a", "b"]).orderBy("index").collect()
    assert [r.a for r in got] == [None, None]
    assert [round(r.b, 6) for r in got] == [-0.707107, 0.707107]


def test_profile_and_its_display(spark):
    cfg = Config(sensors=("air1", "solar", "grid"))
    rows = spark.createDataFrame(
        [(7, "2018-06-01 05:00:00", 2.0, None, 1.0), (7, "2018-06-01 05:45:00", 1.0, None, None),
         (8, "2018-06-01 05:00:00", None, 1.5, None)],
        "dataid int, t string, air1 double, solar double, grid double",
    ).selectExpr("dataid", "CAST(t AS TIMESTAMP_NTZ) AS local_15min", "air1", "solar", "grid")
    profile = profile_readings(rows, cfg)
    seven, eight = profile.orderBy("dataid").collect()
    assert seven.data_availability == 0.5 and eight.data_availability == 1.0
    assert seven.aggregation_abs_error_max == 1.0 and eight.aggregation_abs_error_max is None
    assert (seven.air1, seven.solar, seven.grid) == (True, False, True)
    shown = display_profile(profile, cfg).orderBy("dataid").collect()
    assert shown[0].egauge_1min_data_availability == "50.0%" and shown[0].solar == ""
    assert shown[0].aggregation_abs_error_max == "1.0" and shown[1].solar == "yes"


def test_alignment_shifts_whole_years(spark):
    cfg = Config(from_time=datetime(2018, 2, 27), end_time=datetime(2018, 3, 1, 23), step_seconds=86400, sensors=("a",),
                 balance_sensor="grid", generators=(), time_column="ts")
    rows = spark.createDataFrame(
        [(1, "2016-02-28 00:00:00", 1.0), (1, "2016-02-29 00:00:00", 3.0), (1, "2016-03-01 00:00:00", 5.0),
         (1, "2017-02-28 00:00:00", 90.0), (2, "2018-02-27 00:00:00", 7.0), (2, "2018-02-27 12:00:00", 8.0),
         (3, "2018-02-27 00:00:00", 9.0), (2, "2018-03-02 00:00:00", 10.0)],
        "dataid int, t string, a double").selectExpr("dataid", "CAST(t AS TIMESTAMP_NTZ) AS ts", "a")
    meta = spark.createDataFrame([(1, 2), (2, 0), (4, 0)], "dataid int, delta_year int")
    got = align_readings(rows, meta, cfg).collect()
    # 28 and 29 February 2016 share a slot in 2018; year 2017 belongs to no shift of household 1.
    assert {tuple(r) for r in got} == {(1, 2, 2.0), (1, 3, 5.0), (2, 1, 7.0)}


def test_alignment_over_new_year(spark):
    cfg = Config(from_time=datetime(2017, 12, 31), end_time=datetime(2018, 1, 2), step_seconds=86400, sensors=("a",),
                 balance_sensor="grid", generators=(), time_column="ts")
    rows = spark.createDataFrame(
        [(1, "2015-12-31 00:00:00", 1.0), (1, "2016-01-01 00:00:00", 2.0), (1, "2016-01-03 00:00:00", 3.0)],
        "dataid int, t string, a double").selectExpr("dataid", "CAST(t AS TIMESTAMP_NTZ) AS ts", "a")
    meta = spark.createDataFrame([(1, 2)], "dataid int, delta_year int")
    assert {tuple(r) for r in align_readings(rows, meta, cfg).collect()} == {(1, 1, 1.0), (1, 2, 2.0)}


def test_large_metadata_shares_the_shuffle_of_the_fill(spark):
    """Without broadcast, readings are shuffled twice: by slot, then by household for join and fill."""
    cfg = config(50, ("a",), years=True)
    rows = spark.range(100).selectExpr("CAST(id % 5 AS INT) AS dataid", "TIMESTAMP_NTZ'2018-06-01 00:15:00' AS local_15min", "1D AS a")
    meta = spark.range(5).selectExpr("CAST(id AS INT) AS dataid", "0 AS delta_year")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = align_readings(rows, meta, cfg)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32MB")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 3          # slots, slots by household, metadata
    assert "SortMergeJoin [dataid" in plan and "shift" not in plan.split("SortMergeJoin")[1].split(",")[0]


def test_nan_is_a_missing_reading(spark):
    names = [f"s{i:02d}" for i in range(12)]
    schema = "dataid int, index int, " + ", ".join(f"{n} double" for n in names)
    rows = [(1, 1, *([1.0, 2.0] * 5), float("nan"), None), (1, 2, *([0.0] * 11), 100.0)]
    got = {r["index"]: r for r in mask_row_zscore(spark.createDataFrame(rows, schema), names, 3.0).collect()}
    assert [got[1][n] for n in names] == [1.0, 2.0] * 5 + [None, None]
    assert got[2]["s11"] is None and got[2]["s00"] == 0.0
