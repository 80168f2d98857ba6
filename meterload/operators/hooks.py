"""User functions over a distributed table: an aggregate of three functions, and a function of each file's rows.

Both run on pandas frames inside tasks. What crosses between tasks are the aggregate's states, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: States that meet in one step of the tree, and rows of states that a task holds before it merges them.
FAN_IN, HELD = 64, 50_000


@dataclass(frozen=True)
class UserAggregate:
    """`chunk` turns the rows of each group into a state, `agg` turns states of each group into one, `finalize` turns
    states into results.

    `chunk` and `agg` get a pandas DataFrameGroupBy and return one row per group, in the groups' order and indexed by
    group; `finalize` gets the frame of states and returns a frame of results, row by row. Groups are numbers, the keys
    stay outside. `agg` must not care how often and in which order states are merged. `state` and `result` are the DDL of
    their columns.
    """

    chunk: Callable
    agg: Callable
    finalize: Callable
    state: str
    result: str


def _schema(spark_schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(spark_schema)


def _grouped(table: pa.Table, keys: Sequence[str], values: Sequence[str], function: Callable, types: pa.Schema) -> pa.Table:
    """`function` over the groups of a table: one row per group, keys beside it."""
    numbered = table.append_column("_row", pa.array(range(table.num_rows), type=pa.int64()))
    firsts = numbered.group_by(list(keys), use_threads=False).aggregate([("_row", "min")]) if keys else None
    if keys:
        codes = pd.MultiIndex.from_arrays(
            [table.column(k).combine_chunks().dictionary_encode("encode").indices.to_pandas() for k in keys])
        group, _ = pd.factorize(codes)
        first = sorted(firsts.column("_row_min").to_pylist())
    else:
        group, first = pd.Series([0] * table.num_rows).to_numpy(), [0]
    out = function(table.select(list(values)).to_pandas().groupby(group, sort=True, dropna=False))
    out = out.to_frame() if isinstance(out, pd.Series) else out
    fields = [types.field(v) for v in types.names if v not in keys]
    if len(out) != len(first) or len(out.columns) != len(fields):
        raise ValueError(f"a user aggregate's function must give one row per group and columns {[f.name for f in fields]}")
    picked = table.select(list(keys)).take(pa.array(first, type=pa.int64()))
    made = [pa.array(out.iloc[:, i], type=f.type, from_pandas=True) for i, f in enumerate(fields)]
    return pa.Table.from_arrays([*[picked.column(k) for k in keys], *made], names=[*keys, *[f.name for f in fields]])


def user_aggregate(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], function: UserAggregate, levels: int = 2,
) -> DataFrame:
    """(keys, results) of a user-defined aggregate.

    Each task merges its own states, so a group of any size leaves as one state per task (or per HELD states). Then states
    of a group meet by task number, FAN_IN^levels tasks to a group of tasks at first and all in the end, so that a group
    that every task holds is merged as a tree, not in one place. NULL keys form a group of their own; an empty table has
    no groups.
    """
    fields = {f.name: f for f in df.schema}
    key_fields = [fields[k] for k in keys]
    state_fields = list(T.StructType.fromDDL(function.state))
    state_schema = T.StructType(key_fields + state_fields)
    arrow, state_names = _schema(state_schema), [f.name for f in state_fields]
    key_names, value_names = list(keys), list(values)

    def merge(held: list[pa.Table]) -> pa.Table:
        return _grouped(pa.concat_tables(held), key_names, state_names, function.agg, arrow)

    def to_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if batch.num_rows:
                held.append(_grouped(pa.Table.from_batches([batch]), key_names, value_names, function.chunk, arrow))
            if sum(t.num_rows for t in held) > HELD:
                held = [merge(held)]
                if held[0].num_rows > HELD:
                    yield from held.pop().to_batches()
        if held:
            yield from merge(held).to_batches()

    def merge_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch.select(arrow.names)]))
            if sum(t.num_rows for t in held) > HELD:
                done = merge(held)
                # Rows are sorted by key: only the last group can go on.
                yield from done.slice(0, done.num_rows - 1).to_batches()
                held = [done.slice(done.num_rows - 1)]
        if held:
            yield from merge(held).to_batches()

    states = df.select(*keys, *values).mapInArrow(to_states, state_schema)
    for level in range(levels, -1, -1):
        states = states.withColumn("_part", F.floor(F.spark_partition_id() / F.lit(FAN_IN ** (levels - level + 1))))
        by = [*keys, "_part"] if level else list(keys)
        dealt = states.repartition(*by) if by else states.coalesce(1)
        if keys:
            dealt = dealt.sortWithinPartitions(*by)
        states = dealt.mapInArrow(merge_states, state_schema)
    result_fields = list(T.StructType.fromDDL(function.result))
    result_schema = T.StructType(key_fields + result_fields)
    result_arrow = _schema(result_schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function.finalize(batch.select(state_names).to_pandas())
            out = out.to_frame() if isinstance(out, pd.Series) else out
            made = [pa.array(out.iloc[:, i], type=result_arrow.field(f.name).type, from_pandas=True)
                    for i, f in enumerate(result_fields)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key_names], *made], schema=result_arrow)

    return states.mapInArrow(finish, result_schema)


def map_files(df: DataFrame, function: Callable[[pd.DataFrame, str], pd.DataFrame], schema: str, path: str = "path") -> DataFrame:
    """Rows of a function that gets rows of one file at a time and the file's path, and declares what it returns.

    `path` is the column that holds each row's file, as `read_training_logs` gives it. Rows are gathered by file first, so
    the function runs about once per file, not once per run of rows that lie side by side. Still a file's rows come in one
    or more pieces: a file of very many rows is cut by Spark and by the size of Arrow batches, so a function must not need
    all of a file at once. Pieces leave joined to batches.
    """
    wanted = _schema(T.StructType.fromDDL(schema))

    def joined(made: list[list[pa.Array]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(column) for column in zip(*made)], schema=wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            paths = frame.pop(path).to_numpy()
            same = [a == b or (a is None and b is None) for a, b in zip(paths[1:], paths)]
            starts = [0, *[i for i, again in enumerate(same, 1) if not again]] if len(paths) else []
            made, held = [], 0
            for start, stop in zip(starts, [*starts[1:], len(paths)]):
                out = function(frame.iloc[start:stop].reset_index(drop=True), paths[start])
                made.append([pa.array(out[f.name], type=f.type, from_pandas=True) for f in wanted])
                held += len(out)
                if held >= HELD:
                    yield joined(made)
                    made, held = [], 0
            if made:
                yield joined(made)

    return df.hint("rebalance", path).sortWithinPartitions(path).mapInArrow(run, schema)
