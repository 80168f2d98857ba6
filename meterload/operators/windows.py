"""Sliding windows over complete series.

A series is cut into blocks of window starts. A block's rows (its own and the overlap its last
windows need) are gathered once into an array, and windows are slices of that array. An array is
therefore bounded by `block + span` rows however long the series is, and rows are shuffled once
(plus the overlap), not once per window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterload.config import FEATURES, Config


def _blocks_of(index: Column, first: int, last: int, span: int, block: int) -> Column:
    """Blocks whose windows contain a row."""
    low = F.greatest(index - (span - 1), F.lit(first)) - first
    high = F.least(index, F.lit(last)) - first
    return F.sequence(F.floor(low / block).cast("int"), F.floor(high / block).cast("int"))


def _placed(series: DataFrame, span: int, first: int, last: int, block: int) -> DataFrame:
    """Rows of the wanted windows with the blocks they belong to; others are filtered before the shuffle."""
    needed = series.where(F.col("index").between(first, last + span - 1))
    if last - first + 1 <= block:
        return needed.withColumn("block", F.lit(0))
    return needed.withColumn("block", F.explode(_blocks_of(F.col("index"), first, last, span, block)))


def block_length(span: int) -> int:
    """Window starts in a block, unless the caller says how many."""
    return max(4 * span, 2048)


def series_blocks(
    series: DataFrame, keys: Sequence[str], values: Sequence[str], span: int,
    first: int, last: int, block: int | None = None, running: Sequence[str] = (),
) -> DataFrame:
    """(keys, rows): rows sorted by index, for windows of `span` rows starting at first..last.

    The series must have one row per key and index, as the grid operators give. Columns in `running` get a running
    sum over the block beside them, `sum_<name>`; it needs the block's own shuffle only.
    """
    block = block_length(span) if block is None else block
    placed = _placed(series, span, first, last, block)
    so_far = Window.partitionBy(*keys, "block").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumns({f"sum_{c}": F.sum(c).over(so_far) for c in running})
    rows = F.array_sort(F.collect_list(F.struct("index", *values, *[f"sum_{c}" for c in running])))
    starts = F.lit(first) + F.col("block") * block
    return placed.groupBy(*keys, "block").agg(rows.alias("rows")).select(
        *keys, starts.alias("_first"), F.least(starts + (block - 1), F.lit(last)).alias("_last"), "rows"
    )


def cut_windows(
    blocks: DataFrame, keys: Sequence[str], columns: dict[str, tuple[Column, int, int]],
    keep: Callable[[Column], Column] | None = None, means: dict[str, tuple[Column, int, int]] | None = None,
    totals: dict[str, tuple[Column, int, int]] | None = None,
) -> DataFrame:
    """(keys, win, columns..., means..., totals...) from blocks.

    `columns` maps a name to (array column, offset from the window start, length). `keep` decides
    by window number which windows are cut at all. `means` maps a name to (running sums, offset, length): the mean of
    that part of the window by two look-ups. `totals` gives sums instead of means.
    """
    means, totals = means or {}, totals or {}
    sources = [*columns.values(), *means.values(), *totals.values()]
    arrays = {f"_a{i}": source for i, (source, _, _) in enumerate(sources)}
    staged = blocks.select(*keys, "_first", "_last", *[a.alias(n) for n, a in arrays.items()])
    wins = F.sequence("_first", "_last")
    if keep is not None:
        wins = F.filter(wins, keep)
    # Window numbers are exploded first: a row holds one window's slices, never those of its whole block.
    numbered = staged.select(*keys, "_first", *arrays, F.explode(wins).alias("win"))
    start = F.col("win") - F.col("_first") + 1

    def total(sums: str, offset: int, length: int) -> Column:
        before = start + (offset - 2)
        return F.get(sums, before + length) - F.when(before < 0, 0.0).otherwise(F.get(sums, before))

    names = list(arrays)
    return numbered.select(*keys, "win", *[
        F.slice(F.col(array), start + offset, F.lit(length)).alias(name)
        for array, (name, (_, offset, length)) in zip(names, columns.items())
    ], *[
        (total(array, offset, length) / float(length)).alias(name)
        for array, (name, (_, offset, length)) in zip(names[len(columns):], means.items())
    ], *[
        total(array, offset, length).alias(name)
        for array, (name, (_, offset, length)) in zip(names[len(columns) + len(means):], totals.items())
    ])


def window_statistics(
    series: DataFrame, keys: Sequence[str], target: str, length: int, first: int, last: int, block: int | None = None,
) -> DataFrame:
    """(keys, win, mean, std): mean and sample deviation of the `length` values from each window's start on.

    Sums and sums of squares run along a block, from its first value, so a window is the difference of two rows
    `length` apart, whatever its length; no window's values are gathered.
    """
    block = block_length(length) if block is None else block
    placed = _placed(series, length, first, last, block)
    order = Window.partitionBy(*keys, "block").orderBy("index")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    off = placed.withColumn("_base", F.first(target).over(so_far)).withColumn("_off", F.col(target) - F.col("_base"))
    sums = off.withColumns({"_s": F.sum("_off").over(so_far), "_q": F.sum(F.col("_off") * F.col("_off")).over(so_far)})
    s, q = [F.col(c) - F.coalesce(F.lag(c, length).over(order), F.lit(0.0)) for c in ("_s", "_q")]
    starts = F.lit(first) + F.col("block") * block
    cut = sums.select(*keys, "block", "_base", (F.col("index") - (length - 1)).alias("win"), s.alias("_s"), q.alias("_q"))
    own = cut.where(F.col("win").between(starts, F.least(starts + (block - 1), F.lit(last))))
    n = float(length)
    spread = F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / n, F.lit(0.0))
    std = F.sqrt(spread / (n - 1)) if length > 1 else F.lit(None).cast("double")
    return own.select(*keys, F.col("win").cast("int"), (F.col("_base") + F.col("_s") / n).alias("mean"), std.alias("std"))


def input_windows(
    normalized: DataFrame, keys: Sequence[str], target: str, cfg: Config, first: int, last: int,
    block: int | None = None,
) -> DataFrame:
    """(keys, win, x): x is an array of `input_size` structs, target and calendar features."""
    blocks = series_blocks(normalized, keys, [target, *FEATURES], cfg.input_size, first, last, block)
    rows = F.transform("rows", lambda r: F.struct(r[target].alias("y"), *[r[f].alias(f) for f in FEATURES]))
    return cut_windows(blocks, keys, {"x": (rows, 0, cfg.input_size)})


def output_windows(
    series: DataFrame, keys: Sequence[str], target: str, cfg: Config, first: int, last: int,
    block: int | None = None,
) -> DataFrame:
    """(keys, win, y): the `output_size` raw values that follow the input of each window."""
    start = cfg.input_size
    blocks = series_blocks(series, keys, [target], cfg.output_size, first + start, last + start, block)
    cut = cut_windows(blocks, keys, {"y": (F.col(f"rows.{target}"), 0, cfg.output_size)})
    return cut.withColumn("win", F.col("win") - start)


def output_blocks(
    series: DataFrame, keys: Sequence[str], target: str, cfg: Config, first: int, last: int,
    block: int | None = None,
) -> DataFrame:
    """(keys, _first, _last, values): the outputs of the windows _first.._last in one array, each value once."""
    start = cfg.input_size
    blocks = series_blocks(series, keys, [target], cfg.output_size, first + start, last + start, block)
    return unshifted(blocks.withColumn("values", F.col(f"rows.{target}")).drop("rows"), start)


def unshifted(blocks: DataFrame, start: int) -> DataFrame:
    """Blocks cut from the outputs on, `start` steps into a window, numbered by their windows."""
    return blocks.withColumns({"_first": F.col("_first") - start, "_last": F.col("_last") - start})


def value_windows(
    series: DataFrame, keys: Sequence[str], target: str, cfg: Config, first: int, last: int,
    block: int | None = None, keep: Callable[[Column], Column] | None = None,
    part: tuple[int, int] | None = None, mean: bool = False,
) -> DataFrame:
    """(keys, win, x, y[, x_mean]): raw input and output values of each window, cut from the same array.

    `part` (offset, length) narrows x to the input values a model reads; `mean` adds the mean of the whole input.
    """
    blocks = value_blocks(series, keys, target, cfg, first, last, block, mean)
    return cut_values(blocks, keys, target, cfg, keep, part, mean)


def value_blocks(
    series: DataFrame, keys: Sequence[str], target: str, cfg: Config, first: int, last: int,
    block: int | None = None, mean: bool = False,
) -> DataFrame:
    """The blocks that `cut_values` reads; worth storing where windows are cut several times."""
    return series_blocks(series, keys, [target], cfg.span, first, last, block, [target] if mean else ())


def cut_values(
    blocks: DataFrame, keys: Sequence[str], target: str, cfg: Config, keep: Callable[[Column], Column] | None = None,
    part: tuple[int, int] | None = None, mean: bool = False,
) -> DataFrame:
    values = F.col(f"rows.{target}")
    offset, length = part or (0, cfg.input_size)
    columns = {"x": (values, offset, length), "y": (values, cfg.input_size, cfg.output_size)}
    return cut_windows(blocks, keys, columns, keep, _input_mean(F.col(f"rows.sum_{target}"), cfg) if mean else None)


def _input_mean(sums: Column, cfg: Config) -> dict[str, tuple[Column, int, int]]:
    return {"x_mean": (sums, 0, cfg.input_size)}


def training_pairs(
    series: DataFrame, keys: Sequence[str], target: str, scaled: str, cfg: Config, first: int,
    last: int, block: int | None = None,
) -> DataFrame:
    """(keys, win, x, y): normalised input structs paired with raw outputs.

    `series` carries the scaled target and features beside the raw target, so pairing needs no
    join: both are slices of one array.
    """
    blocks = series_blocks(series, keys, [target, scaled, *FEATURES], cfg.span, first, last, block)
    rows = F.transform("rows", lambda r: F.struct(r[scaled].alias("y"), *[r[f].alias(f) for f in FEATURES]))
    return cut_windows(blocks, keys, {
        "x": (rows, 0, cfg.input_size), "y": (F.col(f"rows.{target}"), cfg.input_size, cfg.output_size),
    })


def per_sensor(
    cfg: Config, values: Callable[[str], Column], sums: Callable[[str], Column] | None = None,
) -> Column:
    """Array of (sensor, values[, sums]) for the sensors that a household has (column `sensors`)."""
    every = F.array(*[
        F.struct(F.lit(s).alias("sensor"), values(s).alias("values"), *([sums(s).alias("sums")] if sums else []))
        for s in cfg.appliances])
    return F.filter(every, lambda p: F.array_contains(F.col("sensors"), p["sensor"]))


def appliance_pairs(
    appliance: DataFrame, normalized: DataFrame, households: DataFrame, cfg: Config, first: int, last: int,
    block: int | None = None, with_output: bool = True, totals: bool = False,
) -> DataFrame:
    """(city, community, dataid, sensor, win, x[, y]): normalised input structs of each sensor, target and
    calendar features, paired with its raw outputs. `totals` adds the sum of each input field, `total_<field>`, from
    running sums along a block: two look-ups a window, whatever its length.

    Raw and normalised rows of a household meet once, wide; sensors are told apart afterwards as arrays.
    """
    sensors = list(cfg.appliances)
    span = cfg.span if with_output else cfg.input_size
    scaled = normalized.select("dataid", "index", *FEATURES, *[F.col(s).alias(f"{s}_z") for s in sensors])
    table = scaled.join(appliance.select("dataid", "index", *sensors), ["dataid", "index"]) if with_output else scaled
    columns = [*FEATURES, *[f"{s}_z" for s in sensors], *(sensors if with_output else [])]
    summed = [*FEATURES, *[f"{s}_z" for s in sensors]] if totals else []
    blocks = series_blocks(table, ["dataid"], columns, span, first, last, block, summed)
    placed = blocks.join(households.select("city", "community", "dataid", "sensors"), "dataid")

    def values(sensor: str) -> Column:
        return F.transform("rows", lambda r: F.struct(
            r[f"{sensor}_z"].alias("y"), *[r[f].alias(f) for f in FEATURES],
            *([r[sensor].alias("raw")] if with_output else []),
            *([r[f"sum_{sensor}_z"].alias("sum_y"), *[r[f"sum_{f}"].alias(f"sum_{f}") for f in FEATURES]] if totals else [])))

    long = placed.select("city", "community", "dataid", "_first", "_last", F.inline(per_sensor(cfg, values)))
    inputs = F.transform("values", lambda r: F.struct(r["y"].alias("y"), *[r[f].alias(f) for f in FEATURES]))
    parts = {"x": (inputs, 0, cfg.input_size)}
    if with_output:
        parts["y"] = (F.col("values.raw"), cfg.input_size, cfg.output_size)
    fields = ["y", *FEATURES] if totals else []
    sums = {f"total_{f}": (F.col(f"values.sum_{f}"), 0, cfg.input_size) for f in fields}
    return cut_windows(long, ["city", "community", "dataid", "sensor"], parts, totals=sums)


def appliance_blocks(
    appliance: DataFrame, households: DataFrame, cfg: Config, first: int, last: int, span: int,
    block: int | None = None, mean: bool = False,
) -> DataFrame:
    """(city, community, dataid, sensor, _first, _last, values[, sums]) for the sensors each household has: the values
    of windows of `span` rows starting at first..last, and their running sums.

    Wide rows are gathered per household first and unpivoted as arrays afterwards: one shuffle of
    the wide table instead of a long row per sensor and step.
    """
    sensors = list(cfg.appliances)
    blocks = series_blocks(appliance, ["dataid"], sensors, span, first, last, block, sensors if mean else ())
    placed = blocks.join(households.select("city", "community", "dataid", "sensors"), "dataid")
    owned = per_sensor(cfg, lambda s: F.col(f"rows.{s}"), (lambda s: F.col(f"rows.sum_{s}")) if mean else None)
    return placed.select("city", "community", "dataid", "_first", "_last", F.inline(owned))


def appliance_windows(
    appliance: DataFrame, households: DataFrame, cfg: Config, first: int, last: int,
    with_input: bool = True, block: int | None = None,
    keep: Callable[[Column], Column] | None = None, part: tuple[int, int] | None = None, mean: bool = False,
) -> DataFrame:
    """(city, community, dataid, sensor, win[, x], y[, x_mean]) for the sensors each household has."""
    shift = 0 if with_input else cfg.input_size
    span = cfg.span if with_input else cfg.output_size
    long = appliance_blocks(appliance, households, cfg, first + shift, last + shift, span, block, mean)
    keys = ["city", "community", "dataid", "sensor"]
    columns = {}
    if with_input:
        columns["x"] = (F.col("values"), *(part or (0, cfg.input_size)))
    columns["y"] = (F.col("values"), cfg.input_size - shift, cfg.output_size)
    cut = cut_windows(long, keys, columns, keep, _input_mean(F.col("sums"), cfg) if mean else None)
    return cut if with_input else cut.withColumn("win", F.col("win") - shift)
