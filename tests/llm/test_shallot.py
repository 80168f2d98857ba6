"""Clusters against plain rounds over all distances, bounds under ties, and the SQL of the registered query."""

import hashlib
import math
import random

import numpy as np
import pytest

from meterload.llm import shallot
from meterload.llm.queries import ORACLES, QUERIES
from tools.compare import normalise, oracle_frame

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int"


def slow(vectors, k, rounds, seed="2:"):
    """(vec_id, cluster, distance) and centroids, measuring all distances in all rounds."""
    def key(row):
        return hashlib.sha256((seed + ("" if row[0] is None else str(row[0]))).encode()).hexdigest(), row[0] or 0, row[1]

    centroids = [v for _, v in sorted(vectors, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in vectors:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c
                     for i, c in enumerate(centroids)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in vectors], centroids


def run(spark, rows, dims, k, rounds=5, scale=256):
    vectors = shallot.integer_vectors(spark.createDataFrame(rows, SCHEMA), dims=dims, scale=scale)
    return shallot.clusters(vectors, k, rounds).collect()


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("seed, n, dims, k, spread", [(1, 400, 8, 12, 1.0), (2, 300, 3, 40, 0.05), (3, 500, 2, 7, 0.01), (4, 60, 4, 1, 1.0)])
def test_equal_to_plain_rounds(spark, seed, n, dims, k, spread):
    """Small spreads make ties and equal vectors; 40 centroids of 300 vectors make empty clusters likely."""
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, 1.0]) + rng.gauss(0, spread) for _ in range(dims)], 0) for i in range(n)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows]
    want, centroids = slow(whole, k, 5)
    got = run(spark, rows, dims, k)
    assert order((r.vec_id, r.cluster, r.distance) for r in got) == order(want)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = sum(d for _, _, d in want)
    for r in got:
        assert r.centroid_sha256 == digests[r.cluster] and r.inertia == total
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)


def test_grids_full_of_ties(spark):
    rows = [(i, [float(i % 5), float(i // 5 % 5)], 0) for i in range(125)]
    want, _ = slow([(i, [int(x) for x in v]) for i, v, _ in rows], 9, 5)
    assert order((r.vec_id, r.cluster, r.distance) for r in run(spark, rows, 2, 9, scale=1)) == order(want)


def test_what_takes_no_part_and_few_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0], 0), (2, None, 0), (3, [1.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [1.0, -inf], 0),
            (7, [1.0, 2.0, 3.0], 0), (8, [0.0, 1.0], 0), (8, [0.0, 1.0], 0), (None, [-0.001, 5.0], 0), (9, [], 0)]
    got = run(spark, rows, 2, 40)
    assert order((r.vec_id, r.distance) for r in got) == [(1, 0), (8, 0), (8, 0), (None, 0)]
    # Equal centroids: the smaller number wins.
    assert len({r.cluster for r in got}) == 2


def test_empty_table(spark):
    assert run(spark, [], 2, 3) == []
    vectors = shallot.integer_vectors(spark.createDataFrame([(1, [1.0], 0)], SCHEMA))
    assert shallot.clusters(vectors).columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "measured"]


def test_too_large_components_fail_loudly(spark):
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e9, 0.0], 0)], 2, 1)


def test_large_components_stay_exact(spark):
    rng = random.Random(9)
    edge = shallot.LIMIT
    rows = [(i, [float(rng.choice([-edge, edge]) + rng.randrange(-3, 4) * (rng.random() < 0)) for _ in range(3)], 0) for i in range(40)]
    want, _ = slow([(i, [int(x) for x in v]) for i, v, _ in rows], 5, 3)
    assert order((r.vec_id, r.cluster, r.distance) for r in run(spark, rows, 3, 5, 3, scale=1)) == order(want)


def test_bounds_and_balls_spare_distances(spark):
    """Well separated groups: a plain search measures k distances in each of up to six rounds."""
    rng = random.Random(4)
    centres = [[rng.uniform(-9, 9) for _ in range(4)] for _ in range(20)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 20]], 0) for i in range(2000)]
    got = run(spark, rows, 4, 20)
    assert sum(r.measured for r in got) / len(got) < 0.6 * 6 * 20


def test_a_search_remembers_the_two_nearest():
    rng = np.random.default_rng(0)
    centroids = rng.integers(-500, 500, (15, 6))
    points = rng.integers(-500, 500, (300, 6))
    search = shallot.Search(centroids, None)
    cluster, second = np.full(300, 3), np.full(300, 11)
    upper, lower = np.full(300, np.inf), np.zeros(300)
    measured = search.assign(points, cluster, second, upper, lower)
    squared = ((points[:, None] - centroids[None]) ** 2).sum(2)
    ranked = np.argsort(squared, axis=1, kind="stable")
    # A vector within half the distance to its centroid's closest neighbour is settled without a search.
    searched = measured > 1
    assert (cluster == ranked[:, 0]).all() and (second == ranked[:, 1])[searched].all() and searched.sum() > 250
    assert (upper >= np.sqrt(squared.min(1))).all()
    assert (lower <= np.sqrt(np.sort(squared, axis=1)[:, 1])).all()


def test_query_equals_its_sql(spark):
    got = QUERIES["op13_shallot_clusters"](spark, FOLDER).toPandas()
    assert normalise(got) == normalise(oracle_frame(FOLDER, ORACLES["op13_shallot_clusters"]))
