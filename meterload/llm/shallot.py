"""Centroid clustering of integer vectors by Lloyd's rounds, with Shallot search for the nearest centroids.

Each vector remembers its nearest and its second-nearest centroid, an upper bound of its distance to the first and a
lower bound of its distance to all others. A round moves the bounds by how far centroids went and leaves a vector alone
if its nearest centroid cannot have changed. Otherwise it measures the two remembered centroids, starts from the closer
one and goes through that one's neighbours, sorted by distance. The search ball around the start has the distance to
the start plus the distance to the second-best centroid found so far, so it shrinks while the search goes on, and the
first neighbour outside ends it. Survivors are compared by squared distances in integers (ties: smaller number), so
results are exact; bounds are floating-point numbers, widened by MARGIN.

A round is one map over the vectors, which writes them with their bounds to the shared folder, followed by the sums
that each task adds up for the vectors that moved (at most one row per centroid and task). Only centroids and their
sums pass through the driver: k rows. The table of the round before is removed once the next one is written.

Defined cases: a vector takes part if it has exactly `dims` components, none null or non-finite; a component becomes
floor(scale * x) and fails loudly beyond 2^26, where squared distances would leave 64 bits. First centroids are the `k`
vectors with the smallest hash of their vec_id (a null one hashes as the empty text; ties by vec_id and components), or
all if fewer. Repeated rows are vectors of their own; an empty cluster keeps its centroid; rounds end early once no
centroid moves, as all later ones would be the same. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterload.session import scratch_path

#: Largest component, and how much bounds are widened against rounding.
LIMIT, MARGIN = 2 ** 26, 1e-9
#: Vectors that a task holds at once.
BATCH = 8192

_STATE = ("sums boolean, vec_id long, vector array<int>, cluster int, second int, upper double, lower double, "
          "measured long, total array<long>, members long")
_ARROW = pa.schema([
    ("sums", pa.bool_()), ("vec_id", pa.int64()), ("vector", pa.list_(pa.int32())), ("cluster", pa.int32()),
    ("second", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("measured", pa.int64()),
    ("total", pa.list_(pa.int64())), ("members", pa.int64())])


def integer_vectors(rows: DataFrame, column: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    whole = F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    checked = F.transform("whole", lambda x: F.when(F.abs(x) <= LIMIT, x).otherwise(
        F.raise_error(F.lit("a vector component is too large for 64-bit squared distances"))).cast("int"))
    kept = rows.where((F.size(column) == dims) & fine).select(F.col("vec_id").cast("long"), whole.alias("whole"))
    return kept.select("vec_id", checked.alias("vector"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors with the smallest hash of seed and vec_id, k at most."""
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = vectors.orderBy(key, "vec_id", "vector").limit(k).select("vector").collect()
    return np.array([row["vector"] for row in found], dtype=np.int64)


def _squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row (or to one centroid)."""
    off = points - centroids
    return np.einsum("ij,ij->i", off, off)


class Search:
    """What a round knows of its centroids: how far each one went, distances between them, sorted neighbours."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None) -> None:
        self.centroids, k = centroids, len(centroids)
        between = np.stack([_squared(centroids, c) for c in centroids])
        np.fill_diagonal(between, -1)  # a centroid stands before its equals
        self.neighbours = np.argsort(between, axis=1, kind="stable")[:, 1:]
        self.between = np.sqrt(np.maximum(between, 0))
        # Half the distance to the closest other centroid.
        self.half = np.array([self.between[i, n[0]] / 2 if k > 1 else np.inf for i, n in enumerate(self.neighbours)])
        went = np.zeros(k) if before is None else np.sqrt(_squared(centroids, before))
        self.went = went * (1 + MARGIN)
        ranked = np.argsort(-self.went)
        # The farthest that any other centroid went.
        self.others = np.full(k, self.went[ranked[0]])
        self.others[ranked[0]] = self.went[ranked[1]] if k > 1 else 0.0

    def assign(self, points: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray,
               lower: np.ndarray) -> np.ndarray:
        """Bring the remembered centroids and bounds up to date, in place; the number of distances measured per row."""
        measured = np.zeros(len(points), dtype=np.int64)
        upper += self.went[cluster]
        lower -= self.others[cluster]
        open_ = np.flatnonzero(~self._settled(upper, lower, cluster))
        nearest = _squared(points[open_], self.centroids[cluster[open_]])
        measured[open_] += 1
        upper[open_] = np.sqrt(nearest) * (1 + MARGIN)
        still = ~self._settled(upper[open_], lower[open_], cluster[open_])
        rows, best_d, best = open_[still], nearest[still], cluster[open_[still]]
        if not len(rows) or len(self.centroids) == 1:
            return measured
        next_ = second[rows]
        next_d = _squared(points[rows], self.centroids[next_])
        measured[rows] += 1
        swap = (next_d < best_d) | ((next_d == best_d) & (next_ < best))
        best, next_ = np.where(swap, next_, best), np.where(swap, best, next_)
        best_d, next_d = np.where(swap, next_d, best_d), np.where(swap, best_d, next_d)
        start, reach = best.copy(), np.sqrt(best_d)
        active, remembered = np.arange(len(rows)), next_.copy()
        for place in range(self.neighbours.shape[1]):
            other = self.neighbours[start[active], place]
            ball = (reach[active] + np.sqrt(next_d[active])) * (1 + MARGIN)
            inside = self.between[start[active], other] * (1 - MARGIN) <= ball
            active, other = active[inside], other[inside]
            if not len(active):
                break
            new = other != remembered[active]
            at, other = active[new], other[new]
            d = _squared(points[rows[at]], self.centroids[other])
            measured[rows[at]] += 1
            first = (d < best_d[at]) | ((d == best_d[at]) & (other < best[at]))
            then = ~first & ((d < next_d[at]) | ((d == next_d[at]) & (other < next_[at])))
            next_[at[first]], next_d[at[first]] = best[at[first]], best_d[at[first]]
            best[at[first]], best_d[at[first]] = other[first], d[first]
            next_[at[then]], next_d[at[then]] = other[then], d[then]
        cluster[rows], second[rows] = best, next_
        upper[rows], lower[rows] = np.sqrt(best_d) * (1 + MARGIN), np.sqrt(next_d) * (1 - MARGIN)
        return measured

    def _settled(self, upper: np.ndarray, lower: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return upper < np.maximum(lower, self.half[cluster]) * (1 - MARGIN)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _round(centroids: np.ndarray, before: np.ndarray | None):
    """The map of one round: vectors with their state, then the sums of what moved in this task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids, before)
        total, members = np.zeros(centroids.shape, dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                n, points = batch.num_rows, _matrix(batch.column("vector"))
                if before is None:
                    # Nothing is remembered yet: any two centroids, and bounds that settle nothing.
                    old = np.full(n, -1)
                    cluster, second = np.zeros(n, dtype=np.int64), np.full(n, min(1, len(centroids) - 1))
                    upper, lower, measured = np.full(n, np.inf), np.zeros(n), np.zeros(n, dtype=np.int64)
                else:
                    cluster, second, upper, lower, measured = (
                        batch.column(c).to_numpy(zero_copy_only=False).copy()
                        for c in ("cluster", "second", "upper", "lower", "measured"))
                    cluster, second = cluster.astype(np.int64), second.astype(np.int64)
                    old = cluster.copy()
                measured += search.assign(points, cluster, second, upper, lower)
                moved = np.flatnonzero(cluster != old)
                np.add.at(total, cluster[moved], points[moved])
                np.add.at(members, cluster[moved], 1)
                left = moved[old[moved] >= 0]
                np.subtract.at(total, old[left], points[left])
                np.subtract.at(members, old[left], 1)
                yield _state(n, sums=np.zeros(n, dtype=bool), vec_id=batch.column("vec_id"),
                             vector=batch.column("vector"), cluster=cluster, second=second, upper=upper, lower=lower,
                             measured=measured)
        some = np.flatnonzero(members | total.any(axis=1))
        if len(some):
            yield _state(len(some), sums=np.ones(len(some), dtype=bool), cluster=some, members=members[some],
                         total=pa.array(total[some].tolist(), type=pa.list_(pa.int64())))

    return run


def _state(n: int, **columns) -> pa.RecordBatch:
    arrays = [pa.nulls(n, f.type) if f.name not in columns
              else columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array)
              else pa.array(columns[f.name]).cast(f.type) for f in _ARROW]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _remove(spark: SparkSession, path: str) -> None:
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(location, True)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, vector, cluster, second, upper, lower, measured) after `rounds` rounds and a last assignment, and the
    centroids they are assigned to. `vectors` is (vec_id, vector of integers)."""
    spark = vectors.sparkSession
    now, path = _written(vectors, "shallot-vectors")
    centroids, before = first_centroids(now, k, seed), None
    total, members = np.zeros(centroids.shape, dtype=object), np.zeros(len(centroids), dtype=object)
    for i in range(rounds + 1) if len(centroids) else ():
        after, new_path = _written(now.mapInArrow(_round(centroids, before), _STATE), f"shallot-{i}")
        _remove(spark, path)
        now, path = after.where("NOT sums"), new_path
        if i == rounds:
            break
        for row in _sums(after, centroids.shape[1]):
            members[row["cluster"]] += row["members"]
            total[row["cluster"]] += np.array(row["total"], dtype=object)
        before, centroids = centroids, np.array(
            [[int(t) // int(n) for t in ts] if n else list(old) for ts, n, old in zip(total, members, centroids)],
            dtype=np.int64)
        if (before == centroids).all():
            break
    return now.select("vec_id", "vector", *[
        c for c in ("cluster", "second", "upper", "lower", "measured") if c in now.columns]), centroids


def _sums(state: DataFrame, dims: int) -> list:
    """One row per centroid: members and componentwise totals that came less those that went."""
    return state.where("sums").groupBy("cluster").agg(
        F.sum("members").alias("members"),
        F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(dims)]).alias("total")).collect()


def _lookup(values: list, kind: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2:") -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, measured (distances
    that were computed for it in all rounds; a plain search computes k in each)."""
    state, centroids = cluster(vectors, k, rounds, seed)
    if not len(centroids):
        return vectors.limit(0).select("vec_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"),
            ("centroid_sha256", "string"), ("measured", "long"))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("cluster").to_numpy()
            distance = np.concatenate([
                _squared(_matrix(batch.column("vector").slice(at, BATCH)), centroids[numbers[at:at + BATCH]])
                for at in range(0, batch.num_rows, BATCH)] or [np.zeros(0, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("cluster"), pa.array(distance), batch.column("measured")],
                names=["vec_id", "cluster", "distance", "measured"])

    found, _ = _written(state.select("vec_id", "vector", "cluster", "measured").mapInArrow(
        measure, "vec_id long, cluster int, distance long, measured long"), "shallot-distances")
    inertia = [0] * len(centroids)
    for row in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect():
        inertia[row["cluster"]] = row["d"]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return found.select(
        "vec_id", "cluster", "distance", _lookup(inertia, "long").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"), _lookup(digests, "string").alias("centroid_sha256"),
        "measured")


def oracle(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The same in SQL for DuckDB, with the columns of op13: every distance in every round."""
    parts = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v,
         sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, vec_id) - 1)::INTEGER AS c, v
                    FROM (FROM kept ORDER BY h, vec_id LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, v, min({{d: d, c: c}}) AS n FROM (
    SELECT k.vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM kept k, c{r} c) GROUP BY vec_id, v)""")
        if r < rounds:
            parts.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT c, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS v FROM (
      SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
        SELECT n.c AS c, unnest(v) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) m ON m.c = c.c)""")
    return "WITH" + ",".join(parts) + f"""
SELECT a.vec_id, a.n.c AS cluster, a.n.d AS distance, (sum(a.n.d) OVER (PARTITION BY a.n.c))::BIGINT AS cluster_inertia,
       (sum(a.n.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.n.c
"""
