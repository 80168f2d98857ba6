"""Roll-up of cleaned readings: appliance -> household -> community -> city."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterload.config import FEATURES, Config
from meterload.functions.rows import signed_total
from meterload.operators.clean import add_time


def household_totals(appliance: DataFrame, cfg: Config) -> DataFrame:
    """(dataid, index, total): consumption minus generation; a projection, no shuffle."""
    return appliance.select("dataid", "index", signed_total(cfg).alias("total"))


def community_totals(household: DataFrame, metadata: DataFrame) -> DataFrame:
    """(city, community, index, total)."""
    placed = household.join(metadata.select("dataid", "city", "community"), "dataid", "left")
    return placed.groupBy("city", "community", "index").agg(F.sum("total").alias("total"))


def city_totals(totals: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(city, index, total) from community totals, or from household totals and their city.

    The key is (city, index) and the sum combines map-side, so one large city spreads over as many
    groups as the grid has steps.
    """
    if metadata is not None:
        totals = totals.join(metadata.select("dataid", "city"), "dataid", "left")
    return totals.groupBy("city", "index").agg(F.sum("total").alias("total"))


def totals_by_grouping_sets(household: DataFrame, metadata: DataFrame) -> DataFrame:
    """Community and city totals in one grouped pass: (city, community or NULL, index, total)."""
    placed = household.join(metadata.select("dataid", "city", "community"), "dataid", "left")
    keys = [F.col("city"), F.col("community"), F.col("index")]
    sets = [keys, [keys[0], keys[2]]]
    grouped = placed.groupingSets(sets, *keys).agg(
        F.sum("total").alias("total"), F.grouping("community").alias("_no_community")
    )
    level = F.when(F.col("_no_community") == 1, "city").otherwise("community")
    return grouped.select(level.alias("level"), "city", "community", "index", "total")


def join_totals(features: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """De-duplicated features of each (key, index) joined with the totals of the same key."""
    distinct = features.dropDuplicates([key, "index"])
    return distinct.join(totals.select(key, "index", "total"), [key, "index"], "left")


def with_features(totals: DataFrame, cfg: Config) -> DataFrame:
    """Adds time and calendar features. They depend on the index alone, so they are computed per
    row after the last aggregation instead of being carried through it."""
    columns = [c for c in totals.columns if c not in ("index", "total")]
    return add_time(totals, cfg).select(*columns, cfg.time_column, "index", *FEATURES, "total")


def household_table(appliance: DataFrame, cfg: Config) -> DataFrame:
    """Household totals beside the time and features that the stored appliance rows have: read, not computed again."""
    return appliance.select("dataid", cfg.time_column, "index", *FEATURES, signed_total(cfg).alias("total"))


def cities_of_communities(community: DataFrame, metadata: DataFrame) -> DataFrame:
    """(city, index, total) from stored community totals. Communities lie inside one city, so each row finds its city."""
    cities = metadata.select("community", "city").distinct()
    return city_totals(community.select("community", "index", "total").join(cities, "community", "left"))
