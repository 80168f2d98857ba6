"""CSV readers and writers."""

from __future__ import annotations

import csv
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterload.config import Config
from meterload.functions.time import parse_utc, utc_ntz
from meterload.sources.local import NO_KEY, list_files, local_path, read_lines, write_lines
from meterload.sources.schema import (
    EVALUATION,
    TRAINING_LOG,
    profile_csv_schema,
    readings_schema,
    source_metadata_schema,
)
from meterload.sources.tables import stored


#: Texts that mean a missing value (fixed values of the delivered files and of common writers).
NULL_TEXTS = ("", "NA", "N/A", "NaN", "nan", "NULL", "null")
#: Most different headers that the files of one read may have.
MAX_LAYOUTS = 1000


def _by_header(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Read CSV columns by the header of each file, whatever their order or number.

    Spark's CSV reader takes the names of one file for all, so files are read as lines. A first pass finds the first line
    of each file on the executors and writes a table of (file, layout), one row per file; only the few different headers
    reach the driver. The second pass maps each line's cells by the layout of its file. With one layout that is a plain
    projection, otherwise lines are joined with the table. A line equal to its file's header is no row, nor is a blank one.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    first = lines.where("_start = 0").withColumn("_no", F.monotonically_increasing_id())
    headers = stored(first.groupBy("_file").agg(F.min_by("value", "_no").alias("_header")), "csv-headers")
    texts = sorted(r["_header"] for r in headers.select("_header").distinct().limit(MAX_LAYOUTS + 1).collect())
    if not texts:
        raise ValueError(f"no CSV file at {path}")
    if len(texts) > MAX_LAYOUTS:
        raise ValueError(f"CSV files at {path} have more than {MAX_LAYOUTS} different headers")
    layouts = [next(csv.reader([text]), []) for text in texts]
    for text, columns in zip(texts, layouts):
        missing = [f.name for f in schema if f.name not in columns]
        if missing:
            raise ValueError(f"CSV with header {text!r} lacks columns {missing}")
    width = max(map(len, layouts))
    cells = F.from_csv("value", ", ".join(f"c{i} STRING" for i in range(width)))
    places = {f.name: [columns.index(f.name) for columns in layouts] for f in schema}
    rows = lines.where(F.trim("value") != "")
    if len(texts) == 1:
        parsed = rows.where(F.col("value") != texts[0]).select(cells.alias("_cells"))
        found = {name: F.col(f"_cells.c{at[0]}") for name, at in places.items()}
    else:
        number = F.lit(None).cast("int")
        for i, text in enumerate(texts):
            number = F.when(F.col("_header") == text, F.lit(i)).otherwise(number)
        files = headers.select("_file", "_header", number.alias("_layout"))
        parsed = rows.join(files, "_file").where("value <> _header").select("_layout", cells.alias("_cells"))
        parsed = parsed.select("_layout", F.array(*[F.col(f"_cells.c{i}") for i in range(width)]).alias("_cells"))
        found = {name: F.get("_cells", F.get(F.array(*[F.lit(i) for i in at]), F.col("_layout")))
                 for name, at in places.items()}
    named = parsed.select(*[value.alias(name) for name, value in found.items()])
    return named.select(*[_value(f).alias(f.name) for f in schema])


def _value(field: T.StructField) -> "F.Column":
    text = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return text
    return F.when(~F.trim(text).isin(list(NULL_TEXTS)), text).cast(field.dataType)


def read_readings(
    spark: SparkSession, path: str | Sequence[str], cfg: Config, sensors: Sequence[str] | None = None,
) -> DataFrame:
    """Raw readings with the time parsed to UTC. `sensors` restricts the sensor columns; NULL_TEXTS are NULL."""
    sensors = cfg.sensors if sensors is None else tuple(sensors)
    df = _by_header(spark, path, readings_schema(cfg.with_(sensors=sensors)))
    return df.withColumn(cfg.time_column, parse_utc(F.col(cfg.time_column)))


def read_source_metadata(
    spark: SparkSession, path: str | Sequence[str], extra: Sequence[str] = ()
) -> DataFrame:
    """Household metadata; the descriptor row under the header has no numeric id and drops out."""
    df = _by_header(spark, path, source_metadata_schema(extra))
    return df.withColumn("dataid", F.col("dataid").try_cast("int")).where(F.col("dataid").isNotNull())


def percent_value(text: "F.Column") -> "F.Column":
    """`"99.87%"` -> 99.87; empty or missing -> 0."""
    return F.coalesce(F.rtrim(text, F.lit("%")).try_cast("double"), F.lit(0.0))


def read_profile_csv(
    spark: SparkSession, path: str | Sequence[str], cfg: Config, prefix: str = "egauge_1min_",
    extra: Sequence[str] = (), columns: Sequence[str] | None = None,
) -> DataFrame:
    """Generated metadata with its display text turned back into values."""
    df = _by_header(spark, path, profile_csv_schema(cfg, prefix, extra))
    parsed = {s: F.coalesce(F.col(s) == "yes", F.lit(False)) for s in cfg.sensors}
    parsed[f"{prefix}data_availability"] = percent_value(F.col(f"{prefix}data_availability"))
    for c in ("aggregation_abs_error_max", "aggregation_abs_error_mean"):
        parsed[c] = F.col(c).try_cast("double")
    for c in (f"{prefix}min_time", f"{prefix}max_time"):
        parsed[c] = parse_utc(F.col(c))
    df = df.withColumns(parsed)
    return df.select(*columns) if columns else df


def write_report(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV report. `single_file` is for results that are small by their nature, such as one row per level."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_tree(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """CSV files in a tree of one folder per entity. Small files cost by their number, not by their bytes, so as many tasks
    write them as shuffles have; AQE would join them by bytes into few."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = local_path(spark, path)
    if root is None or os.path.lexists(root):  # Spark refuses a path that exists
        df.repartition(tasks, *keys).write.partitionBy(*keys).option("header", True).csv(path)
        return
    named = {k: F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit(NO_KEY)) for k in keys}
    write_lines(df.withColumns(named).repartition(tasks, *keys).sortWithinPartitions(*keys), root, keys)


def read_training_logs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Training logs of many entities, with the file path of every row."""
    files = list_files(spark, path) if isinstance(path, str) else None
    if files is None:
        df = spark.read.option("header", True).schema(TRAINING_LOG).csv(path).withColumn("path", F.col("_metadata.file_path"))
    else:
        df = read_lines(files).select("path", F.from_csv("value", TRAINING_LOG.toDDL()).alias("_row"))
        df = df.select("_row.*", "path")
    return df.select("epoch", F.col("loss").alias("mae"), F.col("root_mean_squared_error").alias("rmse"), "path")


def read_evaluations(spark: SparkSession, root: str, name: str = "evaluation.csv") -> DataFrame:
    """Every evaluation file below a folder, with the file path of every row."""
    df = (
        spark.read.option("header", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", name).schema(EVALUATION).csv(root)
    )
    return df.select("mae", "rmse", F.col("_metadata.file_path").alias("path"))


def zoned_to_utc(df: DataFrame, column: str) -> DataFrame:
    """Turn a zoned TIMESTAMP column of a Parquet source into the engine's UTC wall clock."""
    if isinstance(df.schema[column].dataType, T.TimestampType):
        return df.withColumn(column, utc_ntz(F.col(column)))
    return df
