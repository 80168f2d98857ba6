"""Mixing sources to target weights by repetition rates.

Words are counted per source, every source gets a target, target / size is its repetition rate, and each
document is emitted floor(rate) times plus one more time with probability rate - floor(rate). The extra copy is
a Bernoulli draw from a hash of doc_id, so reruns agree and no task needs to see another one's rows.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating. Together they share `share` times all
words, but none more than `cap` times its own; what a capped source leaves is shared again by weight. The fixed
point of that is target = min(cap * size, level * weight), and the level is found with running sums over one row
per source.

The draw: a document's SHA-256 gives eight 32-bit numbers, one for each of eight seeds. Each source takes the
seed whose draw comes nearest to its target. Sums for all eight are one aggregation.

Defined cases: a null text counts 0 words and an empty one too; a null source is a source of its own; documents
of a source without words are emitted once for each whole unit of a rate of 0, that is never; rows that repeat a
doc_id share one draw; a null doc_id draws as the empty string. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterload.llm.common import count_words
from meterload.sources.tables import stored

#: Draws per document: the eight groups of eight digits of a SHA-256.
SEEDS = 8


def _draw(doc_id: Column, seed: int) -> Column:
    digest = F.sha2(F.coalesce(doc_id.cast("string"), F.lit("")), 256)
    return F.conv(F.substring(digest, 8 * seed + 1, 8), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[int] = (5, 2, 1),
) -> DataFrame:
    """One row per source of `sizes` (doc_id, source, size): source_size, target, rate, seed."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = by_source.select(
        "source", "source_size",
        F.element_at(cycle, (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
        .alias("weight"),
    )
    # Sources in the order in which they reach their cap; the level stands where the first one does not.
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    full = F.coalesce(F.sum("source_size").over(before), F.lit(0))
    levels = ranked.select(
        "*", ((F.lit(share) * total - F.lit(cap) * full) / F.sum("weight").over(after)).alias("level"))
    fits = F.col("level") * F.col("weight") <= F.lit(cap) * F.col("source_size")
    level = F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), "level"))).over(everything)["level"]
    targets = levels.select(
        "source", "source_size",
        F.least(F.lit(cap) * F.col("source_size"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
        .alias("target"))
    rates = stored(targets.select(
        "*", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    ), "mix-rates")
    drawn = _with_rates(sizes, rates).groupBy("source").agg(*[
        F.sum(F.col("size") * _copies(F.col("rate"), _draw(F.col("doc_id"), k))).alias(f"taken_{k}")
        for k in range(SEEDS)])
    nearest = F.array_min(F.array(*[
        F.struct(F.abs(F.col(f"taken_{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed"))
        for k in range(SEEDS)]))["seed"]
    return stored(_with_rates(drawn, rates).select(
        "source", "source_size", "target", "rate", nearest.alias("seed")), "mix-targets")


def _with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """`rates` is a written table of one row per source: Spark knows its size and broadcasts it only if small."""
    named = rates.select(F.col("source").alias("_mix_source"), *[c for c in rates.columns if c != "source"])
    return rows.join(named, F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_source")


def _copies(rate: Column, draw: Column) -> Column:
    whole = F.floor(rate)
    return whole + F.when(draw < (rate - whole) * F.lit(2.0 ** 32), 1).otherwise(0)


def _seeded(doc_id: Column, seed: Column) -> Column:
    digest = F.sha2(F.coalesce(doc_id.cast("string"), F.lit("")), 256)
    return F.conv(F.substring(digest, F.lit(8) * seed + 1, F.lit(8)), 16, 10).cast("long")


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size), written once: the text is read a single time."""
    return stored(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")), "mix-sizes")


def mix(docs: DataFrame, **rule) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken."""
    sizes = document_sizes(docs)
    rows = _with_rates(sizes, source_targets(sizes, **rule))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        _copies(F.col("rate"), _seeded(F.col("doc_id"), F.col("seed"))).cast("long").alias("copies"),
    ).withColumn("taken", F.col("size") * F.col("copies"))


def emit(docs: DataFrame, **rule) -> DataFrame:
    """The mixed corpus: the rows of `docs`, each as often as it is taken, numbered from 1 in `copy_no`."""
    targets = source_targets(document_sizes(docs), **rule).select(
        F.col("source"), F.struct("rate", "seed").alias("_mix_rule"))
    copies = _copies(F.col("_mix_rule.rate"), _seeded(F.col("doc_id"), F.col("_mix_rule.seed"))).cast("int")
    rows = _with_rates(docs, targets).withColumn("_mix_copies", copies).where("_mix_copies > 0")
    number = F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))).alias("copy_no")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c != "copy_no"], number)


#: The same in SQL for DuckDB, with the columns of op8.
ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0
         ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         sha256(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
ranked AS (
  SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source)),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (
             ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(
    (SELECT min_by(level, source_size / weight) FROM levels WHERE level * weight <= 2.0::DOUBLE * source_size),
    'inf'::DOUBLE) * weight) AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
draws AS (
  SELECT s.doc_id, s.source, s.size, k, r.source_size, r.target, (floor(r.rate) + CASE WHEN
    ('0x' || substr(digest, 8 * k + 1, 8))::BIGINT < (r.rate - floor(r.rate)) * 4294967296.0::DOUBLE
    THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source, range(8) t(k)),
seeds AS (
  SELECT source, list_sort(list({off: abs(taken - target), k: k}))[1].k AS k
  FROM (SELECT source, k, any_value(target) AS target, sum(size * copies) AS taken FROM draws GROUP BY source, k)
  GROUP BY source)
SELECT d.doc_id, d.size, d.source_size, d.target, (d.size * d.copies)::BIGINT AS taken
FROM draws d JOIN seeds s ON d.source IS NOT DISTINCT FROM s.source AND d.k = s.k
"""
