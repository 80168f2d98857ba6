"""From raw CSV files to normalised level tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from meterload.config import LEVELS, Config
from meterload.operators.bottomup import ENTITY_KEYS
from meterload.operators.clean import add_time, clean_readings
from meterload.operators.hierarchy import assign_communities
from meterload.operators.normalize import normalize_level
from meterload.operators.profile import (
    add_source_metadata,
    align_years,
    display_profile,
    profile_readings,
)
from meterload.operators.rollup import cities_of_communities, community_totals, household_table, with_features
from meterload.plans.actuals import store_actuals
from meterload.sources.csv import read_readings, read_source_metadata, write_report
from meterload.sources.tables import read_table, write_table


@dataclass(frozen=True)
class Store:
    """Where the tables of a run live."""

    root: str

    @property
    def readings(self) -> str:
        return f"{self.root}/readings"

    @property
    def profile(self) -> str:
        return f"{self.root}/profile"

    @property
    def metadata(self) -> str:
        return f"{self.root}/metadata"

    def level(self, name: str, normalized: bool = False) -> str:
        return f"{self.root}/{'normalized/' if normalized else ''}final_{name}"

    @property
    def actuals(self) -> str:
        return f"{self.root}/actuals"

    def run(self, name: str, part: str) -> str:
        return f"{self.root}/runs/{name}/{part}"


def generate_metadata(
    spark: SparkSession, readings: DataFrame, source: DataFrame, store: Store, cfg: Config,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Profile the readings, keep households that cover the window, place them in communities.

    The profile (one row per household) is stored before the hierarchy is derived from it, so the
    readings are scanned once.
    """
    write_table(profile_readings(readings, cfg), store.profile)
    profile = add_source_metadata(read_table(spark, store.profile), source, extra)
    placed = assign_communities(align_years(profile, cfg), cfg.community_size)
    write_table(placed, store.metadata)
    return read_table(spark, store.metadata)


def preprocess(
    spark: SparkSession, readings_path: str | Sequence[str], metadata_path: str | Sequence[str],
    store: Store, cfg: Config, extra: Sequence[str] = (), prefix: str = "egauge_1min_",
    normalize_until: int | None = None, layout: str = "bucket",
) -> dict[str, DataFrame]:
    """Profile, clean, roll up and normalise; returns the stored tables by name.

    The CSV files are parsed once, into Parquet; profile and levels read that.
    """
    write_table(read_readings(spark, readings_path, cfg), store.readings)
    readings = read_table(spark, store.readings)
    source = read_source_metadata(spark, metadata_path, extra)
    metadata = generate_metadata(spark, readings, source, store, cfg, extra)
    write_report(display_profile(metadata, cfg, prefix).orderBy("city", "dataid"), f"{store.root}/metadata_csv")
    return build_levels(spark, readings, metadata, store, cfg, normalize_until, layout)


def build_levels(
    spark: SparkSession, readings: DataFrame, metadata: DataFrame, store: Store, cfg: Config,
    normalize_until: int | None = None, layout: str = "bucket",
) -> dict[str, DataFrame]:
    """Clean, roll up and normalise readings of known households into stored tables. `layout` is that of the
    tables below cities; cities get a directory each.

    Readings and community totals are dealt to their buckets once, without the features that follow from the index.
    Household totals and normalised copies are made row by row from stored tables of the same layout, so they are not
    shuffled again. Each level is summed from the stored table below it.
    """
    layouts = {"appliance": layout, "household": layout, "community": layout, "city": "entity"}
    keys = {level: ENTITY_KEYS[level][0] for level in LEVELS}
    tables = {}

    def store_level(level: str, df: DataFrame, normalized: bool = False, **how) -> DataFrame:
        path = store.level(level, normalized)
        write_table(df, path, keys[level], layouts[level], **how)
        return read_table(spark, path)

    tables["appliance"] = store_level(
        "appliance", clean_readings(readings, metadata, cfg), finish=lambda rows: add_time(rows, cfg))
    tables["household"] = store_level("household", household_table(tables["appliance"], cfg), dealt=True)
    community = community_totals(tables["household"].select("dataid", "index", "total"), metadata).drop("city")
    tables["community"] = store_level("community", community, finish=lambda rows: with_features(rows, cfg))
    city = cities_of_communities(tables["community"], metadata)
    tables["city"] = store_level("city", city, finish=lambda rows: with_features(rows, cfg))
    for level in LEVELS:
        scaled = normalize_level(tables[level], level, cfg, normalize_until)
        tables[f"normalized_{level}"] = store_level(level, scaled, normalized=True, dealt=True)
    tables["metadata"] = metadata
    store_actuals(tables, metadata, store.actuals, cfg)
    return tables
