"""Shared pieces: table reads, the word rule, and Arrow map helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the control characters TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Texts of a batch that a task turns into Python objects at a time.
SLICE = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def words_of(text: bytes | None) -> list[bytes]:
    """The words of an UTF-8 text: bytes.split() cuts at exactly the characters that WORD leaves out."""
    return text.split() if text else []


def as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding."""
    values = batch.column(column)
    binary = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return values.cast(binary).to_pylist()


def map_arrow(df: DataFrame, one: Callable[[pa.RecordBatch], dict[str, list]], schema: str) -> DataFrame:
    """Rows to rows by Arrow batch; `one` gives the output columns of a batch."""
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = one(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
