"""Neighbours against brute force: recall, exact scores and order, copies, and edge cases."""

import numpy as np
import pytest

from meterload.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, score string"


def brute(ids, x, k, every):
    out = {}
    for i, v in zip(ids, x):
        if i % every == 0:
            scores = [(-float((v * w).sum()), j) for j, w in zip(ids, x) if j != i]
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def run(spark, rows, **kw):
    got = {}
    frame = spark.createDataFrame([(i, v, 0, 1, "s") for i, v in rows], SCHEMA)
    for r in ann.nearest(frame, **kw).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def recall(got, want):
    return sum(len({j for j, _ in got[q]} & {j for j, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_on_the_test_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(table.embedding).astype(np.float64)
    want = brute(table.vec_id.tolist(), x, 20, 20)
    got = run(spark, [(int(i), v.tolist()) for i, v in zip(table.vec_id, table.embedding)])
    assert set(got) == set(want) and recall(got, want) >= 0.95
    place = {i: n for n, i in enumerate(table.vec_id)}
    for q, found in got.items():
        for j, score in found:
            assert abs(score - float((x[place[q]] * x[place[j]]).sum())) < 1e-12


@pytest.mark.parametrize("block", [64, 16_384])
def test_norms_cells_and_copies(spark, block, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", block)
    monkeypatch.setattr(ann, "CHUNK_ROWS", max(16, block // 8))
    monkeypatch.setattr(ann, "LEAF_ROWS", 32)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 12)) * 3
    x = (centres[rng.integers(0, 6, 1500)] + rng.standard_normal((1500, 12)) * 0.3) * rng.uniform(0.2, 3, (1500, 1))
    x[300:800] = x[300]  # a third are copies
    x = x.astype(np.float32).astype(np.float64)
    want = brute(list(range(1500)), x, 20, 20)
    got = run(spark, list(enumerate(x.tolist())))
    assert set(got) == set(want) and recall(got, want) >= 0.95
    copied = [q for q in want if 300 <= q < 800]
    for q in copied:  # ties go to the smaller id
        assert [j for j, s in got[q] if s == got[q][0][1]] == [j for j, s in want[q] if s == want[q][0][1]]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]),
            (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0, 3.0]), (40, [-1.0, 0.0])]
    got = run(spark, rows)
    assert got == {0: [(1, 0.5), (2, 0.5), (40, -1.0)], 40: [(1, -0.5), (2, -0.5), (0, -1.0)]}
    assert run(spark, rows[:1]) == {} and run(spark, []) == {} and run(spark, rows[4:6]) == {}


def test_chi_square_bound():
    assert abs(ann.chi_square_bound(0.95, 8) - 15.507) < 1e-3 and abs(ann.chi_square_bound(0.9, 2) - 4.605) < 1e-3


def test_cells_and_boxes_agree():
    y = np.random.default_rng(2).standard_normal((500, ann.M_DIMS))
    cells = ann.fit_cells(y, 4)
    own = cells.of(y)
    assert len(np.bincount(own, minlength=16)) == 16 and (cells.gaps(y)[np.arange(500), own] == 0).all()
