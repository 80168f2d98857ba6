"""Nearest neighbours by inner product: stable projections, a kd-tree, and a chi-square stopping test.

Largest inner product becomes smallest distance: vectors get one more component, sqrt(M^2 - |x|^2) with M the
largest norm, and queries are scaled to norm M. All are projected by M_DIMS Gaussian directions. Gaussians are
2-stable: a point at distance d lies at a projected distance r with r^2 / d^2 chi-square distributed, M_DIMS degrees of
freedom. So once all projected neighbours up to r are verified and the k-th best distance is d_k, a missing
neighbour would need r^2 / d_k^2 below its value, and the search stops when that has probability CONFIDENCE.

1. The top of the kd-tree is fitted on a bounded sample (SAMPLE rows), every row is put into its cell. Large cells
   are cut into blocks, queries of a cell into chunks; a task holds one block and streams one chunk, so no cell,
   however full, lands in one task.
2. Each query searches its own cell, which gives a first d_k, then all cells whose box passes the stopping test.
3. In a block, the kd-tree goes on to leaves. They are visited nearest first; a query stops at the first leaf whose
   box, a lower bound of the projected distances of all that is left, passes the test with its d_k of that moment.
4. Lists of the tasks are merged per query.

Every row is indexed, none is left out. Copies: of equal vectors the k + 1 smallest ids can be among the k nearest;
only those are searched.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
vectors of another length than most (the smaller length if two are equally frequent), nor rows with a null vec_id.
Rows that repeat a vec_id count once, by the vector with the smallest hash. Ties go to the smaller vec_id. A query has
fewer than k neighbours if there are fewer candidates. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterload.sources.tables import stored

M_DIMS = 8
CONFIDENCE = 0.97
SEED = 20
#: Vectors that the top of the tree is fitted on, at most (about).
SAMPLE = 20_000
#: Rows of a block and of a chunk of queries: what a task holds, and what it streams.
BLOCK_ROWS, CHUNK_ROWS = 16_384, 8_192
LEAF_ROWS = 512
#: Queries that go through the leaves together.
TOGETHER = 256
SALTS = 64


def chi_square_bound(confidence: float, dims: int) -> float:
    """The value below which a chi-square variable of an even number of degrees stays with this probability."""
    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < confidence else (low, middle)
    return high


@dataclass(frozen=True)
class Space:
    """What all tasks need to project: fixed size."""

    dims: int
    norm: float  # M
    directions: np.ndarray

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm ** 2 - (x ** 2).sum(axis=1), 0))
        return np.column_stack([x, rest]) @ self.directions

    def queries(self, q: np.ndarray) -> np.ndarray:
        scale = self.norm / np.sqrt((q ** 2).sum(axis=1))
        return (q * scale[:, None]) @ self.directions[:-1]

    def squared_distance(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Of scaled queries with these norms to points with these inner products."""
        return np.maximum(2 * self.norm ** 2 - 2 * self.norm / norms * scores, 0)


@dataclass(frozen=True)
class Cells:
    """The top of the kd-tree: inner nodes in heap order, and the boxes that their cuts leave to the cells."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def of(self, y: np.ndarray) -> np.ndarray:
        node = np.zeros(len(y), np.int64)
        for _ in range((len(self.axis) + 1).bit_length() - 1):
            node = 2 * node + 1 + (y[np.arange(len(y)), self.axis[node]] > self.cut[node])
        return node - len(self.axis)

    def gaps(self, y: np.ndarray) -> np.ndarray:
        """Squared distances of points to all cells."""
        return _gaps(y, self.low, self.high)


def _gaps(y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(y), len(low)))
    for k in range(y.shape[1]):
        off = np.maximum(low[None, :, k] - y[:, None, k], y[:, None, k] - high[None, :, k])
        out += np.maximum(off, 0) ** 2
    return out


def fit_cells(y: np.ndarray, depth: int) -> Cells:
    """Median cuts of the widest axis of a sample, `depth` times."""
    inner = (1 << depth) - 1
    axis, cut = np.zeros(inner, np.int64), np.zeros(inner)
    members = {0: y}
    boxes = {0: (np.full(M_DIMS, -np.inf), np.full(M_DIMS, np.inf))}
    for node in range(inner):
        own, (low, high) = members.pop(node), boxes.pop(node)
        axis[node] = int(np.argmax(own.var(axis=0))) if len(own) else 0
        cut[node] = float(np.median(own[:, axis[node]])) if len(own) else 0.0
        right = own[:, axis[node]] > cut[node]
        upper, lower = high.copy(), low.copy()
        upper[axis[node]] = lower[axis[node]] = cut[node]
        members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
        boxes[2 * node + 1], boxes[2 * node + 2] = (low, upper), (lower, high)
    order = sorted(boxes)
    return Cells(axis, cut, np.array([boxes[n][0] for n in order]), np.array([boxes[n][1] for n in order]))


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vec, copy): one row for each vec_id with a usable vector; copy is a hash of the vector."""
    vec = F.col(column).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id is not null")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(fine & F.exists("vec", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("vec") == (lengths[0]["n"] if lengths else 0))
    rows = rows.select("vec_id", "vec", F.xxhash64("vec").alias("copy"))
    return rows.groupBy("vec_id").agg(F.min_by("vec", "copy").alias("vec"), F.min("copy").alias("copy"))


def without_far_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of each set of equal vectors the k + 1 smallest ids. Large sets are ranked in SALTS parts first."""
    many = stored(rows.groupBy("copy").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("copy"), "copies")
    salted = rows.join(many, "copy").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    for keys in (("copy", "salt"), ("copy",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
        salted = salted.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    return rows.join(many, "copy", "left_anti").select("vec_id", "vec").unionByName(salted.select("vec_id", "vec"))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


class Block:
    """A block of rows, in the leaves of a kd-tree over their projections."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, space: Space) -> None:
        y = space.points(x)
        parts = [np.arange(len(ids))]
        while len(parts[0]) > LEAF_ROWS:
            cut = []
            for part in parts:
                along = y[part, int(np.argmax(y[part].var(axis=0)))]
                order = part[np.argsort(along, kind="stable")]
                cut += [order[: len(order) // 2], order[len(order) // 2:]]
            parts = cut
        self.space = space
        self.low = np.array([y[p].min(axis=0) for p in parts])
        self.high = np.array([y[p].max(axis=0) for p in parts])
        self.leaves = [(ids[p], np.ascontiguousarray(x[p])) for p in parts]

    def search(self, ids: np.ndarray, q: np.ndarray, worst: np.ndarray, k: int, bound: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, vec_ids) of the k best found for each query, given a k-th score known from elsewhere."""
        norms = np.sqrt((q ** 2).sum(axis=1))
        gaps = _gaps(self.space.queries(q), self.low, self.high)
        slack = 1e-9 * self.space.norm * norms
        known = worst.copy()
        best = [(np.empty(0), np.empty(0, np.int64)) for _ in ids]
        for leaf in np.argsort(gaps.mean(axis=0), kind="stable").tolist():
            open_ = np.flatnonzero(gaps[:, leaf] <= bound * self.space.squared_distance(norms, known))
            if not len(open_):
                continue
            rows, x = self.leaves[leaf]
            near = q[open_] @ x.T >= (known - slack)[open_][:, None]
            for i, hits in zip(open_.tolist(), near):
                at = np.flatnonzero(hits)
                at = at[rows[at] != ids[i]]
                if len(at):
                    # One sum per pair, so that equal vectors have equal scores wherever they stand.
                    scores = np.append(best[i][0], (x[at] * q[i]).sum(axis=1))
                    found = np.append(best[i][1], rows[at])
                    order = np.lexsort((found, -scores))[:k]
                    best[i] = scores[order], found[order]
                    if len(order) == k:
                        known[i] = max(known[i], scores[order[-1]])
        return best


def _tasks(data: DataFrame, visits: DataFrame, rows: dict[int, int], k: int, space: Space, bound: float) -> DataFrame:
    """(query_id, vec_id, score): lists of `visits` (vec_id, vec, cell, worst) in the cells of `data`."""
    asked = {r.cell: r.n for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    shape = {c: (math.ceil(n / BLOCK_ROWS), math.ceil(asked[c] / CHUNK_ROWS)) for c, n in rows.items() if c in asked}
    if not shape:
        return data.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    plan = data.sparkSession.createDataFrame(
        [(c, b, n) for c, (b, n) in shape.items()], "cell int, blocks int, chunks int")  # one row per cell
    own = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    left = data.join(plan, "cell").select(
        "cell", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.lit(0).alias("kind"), "vec_id", "vec", F.lit(0.0).alias("worst"))
    chunk = F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")
    right = visits.join(plan, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), chunk.alias("chunk"),
        F.lit(1).alias("kind"), "vec_id", "vec", "worst")
    together = left.unionByName(right).select(F.xxhash64("cell", "block", "chunk").alias("task"), "kind", "vec_id", "vec", "worst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, ids, parts = None, None, [], []
        for batch in batches:
            key = batch.column("task").to_numpy(zero_copy_only=False)
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            vec_id = batch.column("vec_id").to_numpy(zero_copy_only=False)
            worst = batch.column("worst").to_numpy(zero_copy_only=False)
            vec = _matrix(batch.column("vec"), space.dims)
            edges = np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip(np.append(0, edges).tolist(), np.append(edges, len(key)).tolist()):
                if a == b:
                    continue
                if key[a] != task:
                    task, block, ids, parts = key[a], None, [], []
                if kind[a] == 0:
                    ids.append(vec_id[a:b])
                    parts.append(vec[a:b])
                    continue
                if block is None and ids:
                    block = Block(np.concatenate(ids), np.concatenate(parts), space)
                    ids, parts = [], []
                for at in range(a, b, TOGETHER) if block else ():
                    end = min(at + TOGETHER, b)
                    lists = block.search(vec_id[at:end], vec[at:end], worst[at:end], k, bound)
                    yield pa.RecordBatch.from_pydict({
                        "query_id": np.repeat(vec_id[at:end], [len(s) for s, _ in lists]),
                        "vec_id": np.concatenate([f for _, f in lists]),
                        "score": np.concatenate([s for s, _ in lists])})

    ordered = together.repartition("task").sortWithinPartitions("task", "kind", "vec_id")
    return ordered.mapInArrow(run, "query_id long, vec_id long, score double")


def _ranked(lists: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, k: int = 20, query_every: int = 20, column: str = "embedding", confidence: float = CONFIDENCE,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row whose vec_id is divisible by
    `query_every`."""
    rows = stored(usable(vectors, column), "vectors")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    facts = rows.agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.max(F.size("vec")).alias("dims")).first()
    if not facts["n"]:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    n, dims = facts["n"], facts["dims"]
    rng = np.random.default_rng(SEED)
    space = Space(dims, facts["norm"], rng.standard_normal((dims + 1, M_DIMS)))
    bound = chi_square_bound(confidence, M_DIMS)

    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(SAMPLE / n * (1 << 30))
    sample = rows.where(share).select("vec").limit(2 * SAMPLE).toArrow().column("vec").combine_chunks()
    sample = _matrix(sample, dims)
    depth = max(0, min(math.ceil(math.log2(n / BLOCK_ROWS)), int(math.log2(max(len(sample), 8) / 8))))
    cells = fit_cells(space.points(sample), depth)

    def placed(frame: DataFrame, as_queries: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vec = _matrix(batch.column("vec"), dims)
                y = space.queries(vec) if as_queries else space.points(vec)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("vec"), pa.array(cells.of(y).astype(np.int32))],
                    ["vec_id", "vec", "cell"])

        return frame.select("vec_id", "vec").mapInArrow(run, "vec_id long, vec array<double>, cell int")

    data = stored(placed(without_far_copies(rows, k), False), "cells")
    filled = {r.cell: r.n for r in data.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per cell
    asked = placed(rows.where(F.col("vec_id") % query_every == 0), True)
    none = F.lit(-float("inf"))
    home = stored(_tasks(data, asked.withColumn("worst", none), filled, k, space, bound), "home-lists")

    known = _ranked(home, k).where(F.col("rank") == k).select(F.col("query_id").alias("_query"), F.col("score").alias("worst"))
    again = asked.join(known, F.col("vec_id") == F.col("_query"), "left").select(
        "vec_id", "vec", "cell", F.coalesce("worst", none).alias("worst"))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = _matrix(batch.column("vec"), dims)
            worst = batch.column("worst").to_numpy(zero_copy_only=False)
            reach = bound * space.squared_distance(np.sqrt((vec ** 2).sum(axis=1)), worst)
            wanted = cells.gaps(space.queries(vec)) <= reach[:, None]
            wanted[np.arange(len(vec)), batch.column("cell").to_numpy(zero_copy_only=False)] = False
            query, cell = np.nonzero(wanted)
            at = pa.array(query)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(at), batch.column("vec").take(at), pa.array(cell.astype(np.int32)),
                 batch.column("worst").take(at)], ["vec_id", "vec", "cell", "worst"])

    further = stored(again.mapInArrow(visits, "vec_id long, vec array<double>, cell int, worst double"), "visits")
    lists = home.unionByName(_tasks(data, further, filled, k, space, bound))
    return _ranked(lists, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
