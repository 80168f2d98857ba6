from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meterload.config import Config
from meterload.functions.features import calendar_columns, scale_calendar
from meterload.functions.time import add_years, grid_index, grid_time, parse_utc, seconds_between
from meterload.operators.grid import time_spine


@pytest.fixture(params=["UTC", "America/Chicago"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def one(spark, expr):
    return spark.range(1).select(expr.alias("v").cast("string")).first()["v"]


def test_parse_takes_offsets_and_defaults_to_utc(spark, zone):
    texts = {
        "2018-06-01 00:00:00-05": "2018-06-01 05:00:00", "2018-06-01 05:00:00+00": "2018-06-01 05:00:00",
        "2018-06-01 05:00:00": "2018-06-01 05:00:00", "2018-06-01 02:00:00Z": "2018-06-01 02:00:00",
        "2018-03-11 02:30:00": "2018-03-11 02:30:00",
    }
    for text, want in texts.items():
        assert one(spark, parse_utc(F.lit(text))) == want


def test_leap_day_moves_to_the_28th(spark, zone):
    leap = F.expr("timestamp_ntz'2016-02-29 05:15:00'")
    assert one(spark, add_years(leap, F.lit(2))) == "2018-02-28 05:15:00"


def test_grid_index_and_time_invert_each_other(spark, zone):
    cfg = Config(from_time=datetime(2018, 3, 10, 22), end_time=datetime(2018, 3, 12, 3))
    spine = time_spine(spark, cfg)
    back = spine.select("index", grid_index(F.col(cfg.time_column), cfg).alias("i"))
    assert back.where("index = i").count() == cfg.n_steps == spine.count()
    assert spine.agg(F.min("index"), F.max("index")).first()[:] == (1, cfg.n_steps)


def test_grid_index_rejects_times_off_the_grid_or_window(spark, zone):
    cfg = Config()
    for text in ("2018-06-01 04:45:00", "2018-09-01 05:00:00", "2018-06-01 05:07:00", "2018-06-01 05:00:00.5"):
        assert one(spark, grid_index(F.expr(f"timestamp_ntz'{text}'"), cfg)) is None
    assert one(spark, grid_index(F.expr("timestamp_ntz'2018-09-01 04:45:00'"), cfg)) == "8832"
    assert one(spark, grid_time(F.lit(8832), cfg)) == "2018-09-01 04:45:00"


def test_seconds_between_ignores_clock_changes(spark, zone):
    a, b = (F.expr(f"timestamp_ntz'{t}'") for t in ("2018-03-11 00:00:00", "2018-03-12 00:00:00.25"))
    assert float(one(spark, seconds_between(a, b))) == 86400.25


def test_calendar_of_a_monday(spark, zone):
    row = spark.range(1).select(F.expr("timestamp_ntz'2018-06-04 23:45:00'").alias("ts"))
    row = row.withColumns(calendar_columns(F.col("ts")))
    got = row.first()
    assert (got.dayofweek, got.typeofday, got.season, got.dayofyear, got.hourofday) == (0, -1, 2, 155, 23)
    scaled = scale_calendar(row).first()
    assert scaled.dayofweek == pytest.approx(-1 / 6) and scaled.hourofday == 1.0
    assert scaled.dayofyear == pytest.approx(154 / 365) and scaled.minuteofhour == pytest.approx(45 / 59)
    assert scale_calendar(row, zero_based_weekday=True).first().dayofweek == 0


def test_a_grid_index_reads_its_timestamp_a_few_times(spark):
    """Where the timestamp is itself computed, each reading repeats the computation."""
    cfg = Config(from_time=datetime(2024, 1, 1), end_time=datetime(2024, 1, 30, 23), step_seconds=3600)
    index = grid_index(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT))"), cfg)
    plan = spark.range(9).select(index.alias("i"))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("make_dt_interval") <= 4
    assert [r["i"] for r in spark.range(3).select(index.alias("i")).collect()] == [1, 2, 3]
