"""Readings, hierarchy and logs derived from the test tables, one row in for one row out or by
plain aggregation, so that their size follows the tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterload.config import Config
from meterload.functions.time import grid_time, in_window, slot_index
from meterload.operators.clean import clean_slots
from meterload.operators.grid import expose_gaps
from meterload.operators.hierarchy import assign_communities
from meterload.sources.tables import stored

# Hourly meters: event types of a user stand for the sensors of a household.
SENSOR_OF = {"view": "air1", "click": "kitchen1", "signup": "car1", "purchase": "solar", "error": "grid"}
HOURLY = Config(
    from_time=datetime(2024, 1, 1), end_time=datetime(2024, 1, 30, 23), step_seconds=3600,
    input_size=72, output_size=12, sensors=tuple(SENSOR_OF.values()), duplicates="sum",
    time_column="ts", years=False,
)
# Daily meters with twenty sensors, for rules that need long rows.
DAILY = Config(
    from_time=datetime(2024, 1, 1), end_time=datetime(2024, 1, 30), step_seconds=86400,
    input_size=7, output_size=2, sensors=tuple(f"s{i:02d}" for i in range(20)), duplicates="sum",
    time_column="ts", years=False,
)
# Orders of several years moved to one summer.
ORDERS = Config(
    from_time=datetime(2000, 7, 1), end_time=datetime(2000, 9, 30), step_seconds=86400,
    sensors=("price",), duplicates="sum", time_column="ts",
)


# Declared so that opening a table starts no schema job.
SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def slot_readings(spark: SparkSession, folder: str) -> DataFrame:
    """(dataid, index, sensors): one row per event, its value in the column of its sensor."""
    events = table(spark, folder, "events")
    inside = events.where(in_window(F.col("ts"), HOURLY))
    slots = inside.withColumn("index", slot_index(F.col("ts"), HOURLY))
    sensors = [f"CASE WHEN event_type = '{e}' THEN value END AS {s}" for e, s in SENSOR_OF.items()]
    return slots.selectExpr("user_id AS dataid", "index", *sensors)


def hourly_readings(spark: SparkSession, folder: str) -> DataFrame:
    """(dataid, ts, sensors): one row per household and hour with any event."""
    sums = [F.sum(s).alias(s) for s in HOURLY.sensors]
    hourly = slot_readings(spark, folder).groupBy("dataid", "index").agg(*sums)
    return hourly.select("dataid", grid_time(F.col("index"), HOURLY).alias("ts"), *HOURLY.sensors)


def households(spark: SparkSession, folder: str) -> DataFrame:
    """(dataid, city, state) of every user with events."""
    users = table(spark, folder, "events").select(F.col("user_id").alias("dataid")).distinct()
    customer = table(spark, folder, "customer").selectExpr("c_custkey AS dataid", "c_nationkey AS nation")
    nation = table(spark, folder, "nation").selectExpr("n_nationkey AS nation", "n_name AS state", "n_regionkey AS region")
    region = table(spark, folder, "region").selectExpr("r_regionkey AS region", "r_name AS city")
    located = users.join(customer, "dataid").join(nation, "nation").join(region, "region")
    return located.select("dataid", "city", "state")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """(dataid, city, state, segment) of every customer."""
    customer = table(spark, folder, "customer").selectExpr(
        "c_custkey AS dataid", "c_nationkey AS nation", "c_mktsegment AS segment")
    nation = table(spark, folder, "nation").selectExpr("n_nationkey AS nation", "n_name AS state", "n_regionkey AS region")
    region = table(spark, folder, "region").selectExpr("r_regionkey AS region", "r_name AS city")
    return customer.join(nation, "nation").join(region, "region").select("dataid", "city", "state", "segment")


def placed_households(spark: SparkSession, folder: str) -> DataFrame:
    """Households in complete communities, stored: jobs read the hierarchy several times."""
    return stored(assign_communities(households(spark, folder), HOURLY.community_size), "placed")


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Placed households with their sensor flags."""
    flags = [F.bool_or(F.col(s).isNotNull()).alias(s) for s in HOURLY.sensors]
    present = slot_readings(spark, folder).groupBy("dataid").agg(*flags)
    return assign_communities(households(spark, folder), HOURLY.community_size).join(present, "dataid")


def appliance_table(spark: SparkSession, folder: str, homes: DataFrame | None = None) -> DataFrame:
    """(dataid, index, sensors): gap-free and filled, of all active users or of given households."""
    work = HOURLY.with_(sensors=HOURLY.appliances)
    readings = slot_readings(spark, folder).drop(HOURLY.balance_sensor)
    users = table(spark, folder, "events").select(F.col("user_id").alias("dataid")) if homes is None else homes
    return clean_slots(readings, users, work)


def daily_grid(spark: SparkSession, folder: str) -> DataFrame:
    """(dataid, index, s00..s19) with gaps exposed, nothing cleaned."""
    events = table(spark, folder, "events")
    sensor = F.col("user_id") % 20
    dataid = F.floor(F.col("user_id") / 20)
    columns = [F.when(sensor == i, F.col("value")).alias(s) for i, s in enumerate(DAILY.sensors)]
    inside = events.where(in_window(F.col("ts"), DAILY))
    rows = inside.select(dataid.alias("dataid"), slot_index(F.col("ts"), DAILY).alias("index"), *columns)
    return expose_gaps(rows, events.select(dataid.alias("dataid")), DAILY)


def order_readings(spark: SparkSession, folder: str) -> DataFrame:
    """(dataid, ts, price): one row per order."""
    orders = table(spark, folder, "orders")
    return orders.select(
        F.col("o_custkey").alias("dataid"), F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("price"),
    )


def training_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, epoch, mae, rmse): one row per event, the entity only in the path."""
    events = table(spark, folder, "events")
    path = F.concat(
        F.lit("/appliances/household="), F.col("user_id").cast("string"), F.lit("/appliance="),
        F.col("event_type"), F.lit("/history_log_full.csv"),
    )
    return events.select(
        path.alias("path"), (F.dayofmonth("ts") - 1).alias("epoch"),
        (F.col("value") / 100).alias("mae"), (F.col("value") / 50).alias("rmse"),
    )
