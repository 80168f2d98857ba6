"""SimHash near-duplicates with generalised pigeonhole search.

Fingerprint: 64 bits over the word shingles of a text (repeats included), each hashed with XXH64, seed 42.

Search for pairs within `max_bits` differing bits, over distinct fingerprints:

1. Means and products of all bits are summed over all fingerprints (a 64 x 64 table). Correlated bits are
   grouped into partitions.
2. General pigeonhole: with thresholds T_1..T_m that add up to max_bits - m + 1 (-1 switches a partition off),
   two fingerprints within max_bits differ in at most T_i bits of some partition i. Dynamic programming picks the
   thresholds with the least estimated cost: candidates by the distribution of differing bits in the partition,
   plus signatures to shuffle. The number of partitions is the cheapest of `parts`. Any choice is exact.
3. Signatures: both sides of a pair flip up to half of T_i bits of partition i, so they meet in a bucket.
   Buckets of one are dropped by a count, large ones are cut into blocks, and pairs of blocks go to
   different tasks, each of a bounded number of rows.
4. Every bucket is verified on whole fingerprints. What leaves it is its links if they are few, else a spanning
   forest of them: the same components, but never all pairs of a dense group.
5. Components by star contraction; a class is named by its smallest doc_id.

Defined cases: a text without words, or null, has fingerprint 0 and is linked like any other. Fewer words than a
shingle make one shingle. Rows that repeat a doc_id each keep a row. A null doc_id takes part, but names a class
only as null, where no member has an id. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterload.llm.common import SLICE, as_bytes, map_arrow, words_of
from meterload.llm.components import components
from meterload.sources.tables import stored

BITS = 64
#: Rows of a block of a large bucket; a task holds two blocks at a time.
BLOCK = 4096
#: A signature row costs about as much as verifying so many pairs.
ROW_COST = 50.0
#: Buckets up to this size are compared side by side, larger ones breadth first.
SHIFTS = 128
#: Links that leave a task at once where all of them do.
PORTION = 1 << 18


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Fingerprint of one UTF-8 text."""
    words = words_of(text.lower()) if text else []  # bytes.lower() touches A-Z only
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        parts = [line[a:b] for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1:].tolist())]
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.uint64, len(parts))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at: at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, tag, fp) of every row; tag is a hash of the whole row, fp the fingerprint as a signed long."""
    def one(batch: pa.RecordBatch) -> dict[str, list]:
        found = np.array([fingerprint(t, shingle) for at in range(0, batch.num_rows, SLICE)
                          for t in as_bytes(batch.slice(at, SLICE), "text")], np.uint64)
        return {"doc_id": batch.column("doc_id"), "tag": batch.column("tag"), "fp": found.view(np.int64)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_tag(docs).alias("tag"), "text")
    return map_arrow(rows, one, "doc_id long, tag long, fp long")


def row_tag(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def bit_products(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Count of fingerprints and, for each pair of bits, of those with both set: 4,096 sums at most."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(values)
        yield pa.RecordBatch.from_pydict({
            "cell": np.arange(BITS * BITS + 1), "c": np.append(total.ravel(), n).astype(np.int64)})

    rows = prints.select("fp").mapInArrow(partial, "cell long, c long").groupBy("cell").agg(F.sum("c")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for cell, c in rows:
        cells[cell] = c
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in `parts` groups of like size; a group grows by the bit most correlated with it."""
    mean = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    strength = np.abs((both / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        room = len(free) // (parts - k)
        order = sorted(free)
        group = [max(order, key=lambda b: (strength[b, order].sum(), -b))]
        free.remove(group[0])
        while len(group) < room:
            best = max(sorted(free), key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _ball(size: int, radius: int) -> int:
    return sum(comb(size, r) for r in range(radius + 1))


def allocate(n: int, both: np.ndarray, groups: Sequence[Sequence[int]], max_bits: int) -> tuple[float, list[int]]:
    """Least estimated cost and its thresholds, which add up to max_bits - len(groups) + 1."""
    mean = np.diag(both) / max(n, 1)
    differ = 2 * mean * (1 - mean)
    rows = max(n, 1)  # signatures cost something even where there are none yet
    pairs = rows * (rows - 1) / 2
    costs = []
    for group in groups:
        chance = np.array([1.0])  # of 0, 1, 2, ... differing bits
        for b in group:
            chance = np.convolve(chance, [1 - differ[b], differ[b]])
        within = np.cumsum(chance)
        costs.append([0.0] + [
            pairs * within[min(t, len(group))] + ROW_COST * rows * _ball(len(group), (t + 1) // 2)
            for t in range(max_bits + 1)])  # position t + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t in range(-1, max_bits + 1):
                option = (spent + cost[t + 1], [*chosen, t])
                if total + t not in step or option < step[total + t]:
                    step[total + t] = option
        best = step
    return best[max_bits - len(groups) + 1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _flips(group: Sequence[int], radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(group, r)]


def signatures(prints: DataFrame, groups: Sequence[Sequence[int]], thresholds: Sequence[int]) -> DataFrame:
    """(part, key, fp): the bits of each used partition with up to half of its threshold, rounded up, flipped."""
    frames = []
    for part, (group, t) in enumerate(zip(groups, thresholds)):
        if t >= 0:
            own = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in group))).cast("long"))
            flips = F.array(*[F.lit(_signed(m)).cast("long") for m in _flips(group, (t + 1) // 2)])
            frames.append(prints.select(F.lit(part).alias("part"), own.alias("own"), "fp", F.explode(flips).alias("flip"))
                          .select("part", F.col("own").bitwiseXOR(F.col("flip")).alias("key"), "fp"))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _forest(values: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among `values`, breadth first."""
    rest = values
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            node = front.pop()
            near = np.bitwise_count(rest ^ node) <= max_bits
            if near.any():
                found = rest[near]
                yield np.full(len(found), node), found
                front.extend(found)
                rest = rest[~near]


def _links(groups: np.ndarray, values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal `groups`: all of them where they are few, else a spanning forest."""
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    sizes = np.diff(np.append(starts, len(groups)))
    left = (starts + sizes).repeat(sizes) - np.arange(len(groups)) - 1  # rows of the run after this one
    run = np.arange(len(starts)).repeat(sizes)
    left[sizes[run] > SHIFTS] = 0
    a, b, found = [], [], np.zeros(len(starts), np.int64)
    at = np.flatnonzero(left >= 1)
    for step in range(1, SHIFTS):
        at = at[left[at] >= step]
        if not len(at):
            break
        near = at[np.bitwise_count(values[at] ^ values[at + step]) <= max_bits]
        a.append(near)
        b.append(near + step)
        found += np.bincount(run[near], minlength=len(starts))
    none = np.empty(0, np.int64)
    a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
    dense = (sizes > SHIFTS) | (found >= sizes)
    few = ~dense[run[a]]
    left_ends, right_ends = [values[a[few]]], [values[b[few]]]
    for start, size in zip(starts[dense].tolist(), sizes[dense].tolist()):
        for x, y in _forest(values[start: start + size], max_bits):
            left_ends.append(x)
            right_ends.append(y)
    return np.concatenate(left_ends), np.concatenate(right_ends)


def links(prints: DataFrame, max_bits: int = 4, parts: Sequence[int] = (2, 3, 4)) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp) that have the components of all links."""
    n, both = bit_products(prints)
    options = []
    for m in parts:
        if m <= max_bits + 1:
            groups = correlated_groups(n, both, m)
            options.append((*allocate(n, both, groups, max_bits), groups))
    _, thresholds, groups = min(options, key=lambda o: o[0])
    rows = signatures(prints, groups, thresholds)
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    shared = rows.join(sizes, ["part", "key"]).select(
        "part", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    tasks = shared.select(
        F.xxhash64("part", "key", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "fp")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_task, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(tasks_: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = _links(tasks_, values, max_bits)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_pydict({
                "a": np.ascontiguousarray(pairs[:, 0]).view(np.int64),
                "b": np.ascontiguousarray(pairs[:, 1]).view(np.int64)})

        for batch in batches:
            held_task = np.append(held_task, batch.column("task").to_numpy(zero_copy_only=False))
            held_fp = np.append(held_fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            if len(held_task):
                done = int(np.searchsorted(held_task, held_task[-1]))  # the last run may go on in the next batch
                if done:
                    yield from out(held_task[:done], held_fp[:done])
                    held_task, held_fp = held_task[done:], held_fp[done:]
        if len(held_task):
            yield from out(held_task, held_fp)

    ordered = tasks.repartition("task").sortWithinPartitions("task", "fp")
    return ordered.mapInArrow(verify, "a long, b long").distinct()


def classes(docs: DataFrame, shingle: int = 4, max_bits: int = 4, parts: Sequence[int] = (2, 3, 4)) -> DataFrame:
    """(doc_id, fp, component_id) of every row: its fingerprint and the smallest doc_id of its class."""
    rows = stored(fingerprints(docs, shingle), "simhash")
    first = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(first, max_bits, parts))
    named = first.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = named.join(least, "root").select("fp", "root", "component_id")
    names = first.join(linked, "fp", "left").select("fp", F.when(
        F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))
    # Written, so that the join below has two plain shuffles and Spark can split a fingerprint of very many rows.
    return rows.join(stored(names, "simhash-names"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(
    docs: DataFrame, shingle: int = 4, max_bits: int = 4, parts: Sequence[int] = (2, 3, 4),
) -> DataFrame:
    """The rows of `docs` without near duplicates: of each class, as `classes` finds it, one row stays.

    That is the one with the smallest doc_id; null ids come last, rows that share an id go by a hash of all columns, and
    of equal rows one stays. Only fingerprints are grouped; texts are met again by the hash of their row.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    first = stored(fingerprints(docs, shingle).groupBy("fp").agg(F.min(order).alias("place")), "simhash-first")
    roots = components(links(first, max_bits, parts)).withColumnRenamed("node", "fp")
    named = first.join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "place")
    winners = stored(named.groupBy("root").agg(F.min("place").alias("place")).select(
        F.col("place.tag").alias("_row_tag")), "simhash-winners")
    kept = docs.withColumn("_row_tag", row_tag(docs)).join(winners, "_row_tag", "left_semi")
    return kept.dropDuplicates(["_row_tag"]).drop("_row_tag")
