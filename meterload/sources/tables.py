"""Level tables at rest: Parquet, pruned by entity.

Two layouts hold the same rows. "bucket" (the default for entities) hashes entities into a fixed number
of directories and sorts files by entity, so that min/max statistics prune row groups; it works for any
number of entities. The number of buckets is part of the name of the partition column, so it stays with
the table. "entity" gives each entity its own directory, as a reader of single-entity folders expects;
the caller asks for it where entities are few, such as cities.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterload.session import scratch_path

#: Results written at a time.
WRITERS = 4
#: Prefix of the partition column of bucketed tables; the number of buckets follows.
BUCKET = "entity_bucket_of_"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Output sizing: Spark merges small and splits large partitions to the advisory size."""
    return df.hint("rebalance", *keys)


def _bucket_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.startswith(BUCKET)]


def _check_layout(spark: SparkSession, path: str, column: str) -> None:
    """Refuse to add rows of another layout, or of another number of buckets, to a table."""
    try:
        columns = spark.read.parquet(path).columns
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return
        raise
    have = _bucket_columns(columns)
    if (have or [column]) != [column] or (column.startswith(BUCKET) and not have):
        raise ValueError(f"the table at {path} is laid out by {have or 'entity'}, not by {column}")


def write_table(
    df: DataFrame, path: str, key: str | None = None, layout: str = "bucket",
    mode: str = "overwrite", buckets: int = 256, order: Sequence[str] = ("index",),
    dealt: bool = False, finish: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Write a table by entity. "overwrite" replaces the whole table, "overwrite_partitions" only
    the partitions that get rows, "append" adds files.

    `dealt` says that the rows are those of a stored table of the same layout and key, row by row: tasks read whole files
    or large parts of one, so rows are sorted where they are, without a shuffle, and files stay as few. `finish` adds
    columns that follow from a row after the shuffle, which then need not carry them.
    """
    place = (lambda rows, by: rows) if dealt else spread
    finish = finish or (lambda rows: rows)
    if key is None:
        writer = finish(df if dealt else spread(df)).write
    elif layout == "entity":
        writer = finish(place(df, key).sortWithinPartitions(key, *order)).write.partitionBy(key)
    elif layout == "bucket":
        name = f"{BUCKET}{buckets}"
        out = df.withColumn(name, bucket_of(F.col(key), buckets))
        writer = finish(place(out, name).sortWithinPartitions(name, key, *order)).write.partitionBy(name)
    else:
        raise ValueError(f"unknown layout {layout!r}")
    if key is not None and mode != "overwrite":
        _check_layout(df.sparkSession, path, key if layout == "entity" else f"{BUCKET}{buckets}")
    overwrite = "dynamic" if mode == "overwrite_partitions" else "static"
    writer = writer.option("partitionOverwriteMode", overwrite)
    writer.mode("append" if mode == "append" else "overwrite").parquet(path)


def read_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None,
    where: Column | str | None = None, schema: T.StructType | None = None,
) -> DataFrame:
    """Parquet scan with column projection and a predicate that reaches the scan."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    if where is not None:
        df = df.where(where)
    if columns is not None:
        return df.select(*columns)
    return df.drop(*_bucket_columns(df.columns))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from the file: its lineage ends
    there, it survives lost executors, and branches that use it do not repeat the work."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_all(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """`stored` for several results that do not depend on each other, at the same time: the tail of one job leaves
    executors to the others."""
    with ThreadPoolExecutor(max(1, min(len(frames), WRITERS))) as pool:
        written = {name: pool.submit(inheritable_thread_target(df.sparkSession)(stored), df, name) for name, df in frames.items()}
    return {name: job.result() for name, job in written.items()}


def read_entities(
    spark: SparkSession, path: str, key: str, values: Sequence, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of a few entities: partition pruning in either layout. The bucket numbers are constants that
    follow from the values and from the number of buckets in the table."""
    df = spark.read.parquet(path)
    predicate = F.col(key).isin(list(values))
    for name in _bucket_columns(df.columns):
        buckets = int(name.removeprefix(BUCKET))
        predicate = predicate & F.col(name).isin([bucket_of(F.lit(v), buckets) for v in values])
    df = df.where(predicate).drop(*_bucket_columns(df.columns))
    return df.select(*columns) if columns is not None else df


def read_entity(
    spark: SparkSession, path: str, key: str, value, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of one entity."""
    return read_entities(spark, path, key, [value], columns)
