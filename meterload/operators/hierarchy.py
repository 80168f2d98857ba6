"""Hierarchy city -> community -> household -> appliance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterload.config import Config
from meterload.sources.tables import stored

_BEFORE = (Window.unboundedPreceding, -1)


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str, ranges: int | None = None) -> DataFrame:
    """Adds `name`: the sum of `value` over all rows that sort before, in one total order.

    Rows are dealt out in ranges of the order, `ranges` of them or as many as Spark's shuffles have, and
    written, so that ranges stay what they are. A running sum inside each range meets the sums of earlier
    ranges, one row per range. No task sees more than its range, and the result does not depend on the cuts.
    """
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    marked = stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    sums = marked.groupBy("_range").agg(F.sum(value).alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(*_BEFORE)), F.lit(0))
    sums = sums.select("_range", earlier.alias("_earlier"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(*_BEFORE)
    local = marked.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(sums, "_range").withColumn(name, F.col("_earlier") + F.col("_local")).drop(
        "_range", "_local", "_earlier")


def assign_communities(households: DataFrame, size: int = 5, ranges: int | None = None) -> DataFrame:
    """Adds `community`: runs of `size` households by id within a city, numbered across cities.

    Ids count every run, complete or not; a household in a short last run of its city is dropped, so ids can
    have gaps. Households without a city are dropped. A household's rank in its city is its place in the order
    (city, dataid) less the households of earlier cities, so a city of any size is ranked by many tasks.
    """
    located = households.where(F.col("city").isNotNull()).withColumn("_one", F.lit(1))
    placed = running_total(located, ["city", "dataid"], "_one", "_place", ranges).drop("_one")
    cities = placed.groupBy("city").agg(F.min("_place").alias("_first"), F.count("*").alias("_size"))
    chunks = cities.withColumn("_chunks", F.ceil(F.col("_size") / F.lit(float(size))).cast("bigint"))
    cities = running_total(chunks, ["city"], "_chunks", "_offset", ranges)
    numbered = placed.join(cities, "city").withColumn(
        "_chunk", F.floor((F.col("_place") - F.col("_first")) / size).cast("bigint"))
    complete = numbered.where((F.col("_chunk") + 1) * size <= F.col("_size"))
    community = (F.col("_offset") + F.col("_chunk") + 1).cast("int")
    return complete.withColumn("community", community).select(*households.columns, "community")


def presence(profile: DataFrame, cfg: Config) -> DataFrame:
    """(dataid, sensor) of every sensor that ever has a value, the balance sensor excepted."""
    flags = profile.groupBy("dataid").agg(*[F.bool_or(s).alias(s) for s in cfg.appliances])
    sensors = list(cfg.appliances)
    return flags.unpivot("dataid", sensors, "sensor", "present").where("present").drop("present")


def sensor_list(cfg: Config):
    """ARRAY of the sensors a household has, from its presence flags, in sensor order."""
    flags = [F.when(F.col(s), F.lit(s)) for s in cfg.appliances]
    return F.filter(F.array(*flags), lambda s: s.isNotNull())


def household_map(metadata: DataFrame, cfg: Config) -> DataFrame:
    """(city, community, dataid, sensors) — one row per household."""
    return metadata.select("city", "community", "dataid", sensor_list(cfg).alias("sensors"))


def edges(metadata: DataFrame, cfg: Config) -> DataFrame:
    """The hierarchy as long rows (city, community, dataid, sensor)."""
    households = household_map(metadata, cfg)
    return households.select("city", "community", "dataid", F.explode("sensors").alias("sensor"))


def nested_cities(metadata: DataFrame, cfg: Config) -> DataFrame:
    """Per community, a MAP<dataid, ARRAY<sensor>>: the tree for display, of bounded row size."""
    pairs = F.collect_list(F.struct("dataid", "sensors"))
    grouped = household_map(metadata, cfg).groupBy("city", "community").agg(pairs.alias("_pairs"))
    return grouped.select("city", "community", F.map_from_entries(F.array_sort("_pairs")).alias("households"))


def appliances_of(metadata: DataFrame, household: int, cfg: Config) -> DataFrame:
    return presence(metadata.where(F.col("dataid") == household), cfg).select("sensor")


def entity_list(metadata: DataFrame, level: str) -> DataFrame:
    """Distinct entities of a level above appliances."""
    key = {"household": "dataid", "community": "community", "city": "city"}[level]
    return metadata.select(key).distinct()


def entity_counts(metadata: DataFrame, cfg: Config) -> DataFrame:
    """(level, n) for all four levels, from one pass over the households."""
    per_household = metadata.select("city", "community", "dataid", F.size(sensor_list(cfg)).alias("n"))
    counted = per_household.agg(
        F.sum("n").cast("bigint").alias("appliance"), F.count("*").alias("household"),
        F.count_distinct("community").alias("community"), F.count_distinct("city").alias("city"),
    )
    return counted.unpivot([], ["appliance", "household", "community", "city"], "level", "n")


def subtree(
    metadata: DataFrame, city: str | None = None, community: int | None = None,
    households: Sequence[int] | None = None,
) -> DataFrame:
    """Restrict the hierarchy to one city, one community or some of its households."""
    if city is not None:
        metadata = metadata.where(F.col("city") == city)
    if community is not None:
        metadata = metadata.where(F.col("community") == community)
    if households is not None:
        metadata = metadata.where(F.col("dataid").isin(list(households)))
    return metadata
