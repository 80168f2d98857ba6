"""SimHash classes against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from meterload.llm import simhash
from meterload.llm.components import components

SCHEMA = "doc_id long, text string, key string, fp string"


def slow_fingerprint(text, k=4):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    parts = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64(p.encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def slow_classes(rows, bits=4, shingle=4):
    prints = [slow_fingerprint(r[1], shingle) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    ids = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            ids[find(i)] = min(ids.get(find(i), rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), prints[i], str(ids.get(find(i)))) for i in range(len(rows)))


def slow_one_of_each(rows):
    """The smallest doc_id of each class."""
    return sorted({int(c) for _, _, c in slow_classes(rows)})


def got(df):
    return sorted((str(r.doc_id), r.fp & (2 ** 64 - 1), str(r.component_id)) for r in df.collect())


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["ÄÖ", "Éa"]
    rows = [(0, None), (1, ""), (2, " \t\n\x0b"), (3, "one"), (3, "ONE"), (4, "one two"), (None, "a b c d e"), (5, "a b c d e")]
    for i in range(20):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((30, 200, 900)))]
        rows.append((100 * i + 10, " ".join(base)))
        for j in range(rng.randrange(1, 12)):
            near = list(base)
            for _ in range(rng.randrange(0, 3)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append((100 * i + 11 + j, "\n".join(near).upper() if j % 3 == 0 else " ".join(near)))
    rows.append((9000, "x" * 200_000 + " y" * 50_000))
    return rows


def test_classes_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "k", "clash") for i, t in rows], SCHEMA)
    assert got(simhash.classes(df)) == slow_classes(rows)


@pytest.mark.parametrize("parts", [(2,), (3,), (4,), (5,)])
def test_every_number_of_parts_finds_all_links(spark, parts, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)  # large buckets are cut, in the driver's plan
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 6, dtype=np.int64)
    values = set(base.tolist())
    for b in base.tolist():
        for _ in range(60):
            v = b
            for bit in rng.choice(63, rng.integers(1, 6), replace=False).tolist():
                v ^= 1 << bit
            values.add(v)
    values = sorted(values)
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 4, parts)
    assert all((r.a ^ r.b).bit_count() <= 4 for r in edges.collect())
    roots = {r.node: r.root for r in components(edges).collect()}
    root = {v: v for v in values}
    for i, v in enumerate(values):  # smallest value of each class, by repeated relabelling
        for w in values[:i]:
            if (v ^ w).bit_count() <= 4 and root[v] != root[w]:
                old, new = max(root[v], root[w]), min(root[v], root[w])
                root = {k: new if r == old else r for k, r in root.items()}
    assert {v: roots.get(v, v) for v in values} == root


def test_one_of_each_matches_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for i in range(15):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((4, 30, 150, 150, 600)))]
        for _ in range(rng.choice((1, 2, 12))):
            near = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, len(base) // 6))):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            n += 1
            rows.append((n, " ".join(near)))
    rows += [(900, "same line\n" * 2000 + "a b c"), (901, "same line\n" * 2000 + "d e f"), (902, ""), (903, " \n"), (904, None)]
    df = spark.createDataFrame([(i, t, "k", "clash") for i, t in rows], SCHEMA)
    kept = simhash.one_of_each(df.union(df))
    assert kept.columns == df.columns
    want = slow_one_of_each(rows)
    assert sorted(r.doc_id for r in kept.collect()) == want and len(want) < len(rows)
    assert 902 in want and not {903, 904} & set(want)


def test_one_of_each_without_ids_and_with_equal_ids(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (None, "x y z"), (7, "x y z"), (5, "q r s t"), (5, "q r s t"), (5, "u v w")]
    df = spark.createDataFrame([(i, t, "k", "clash") for i, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.text) for r in simhash.one_of_each(df).collect())
    assert got == [("5", "q r s t"), ("5", "u v w"), ("7", "x y z"), ("None", "a b c d e")]


def test_dense_and_large_buckets_keep_their_components():
    rng = np.random.default_rng(1)
    near = np.unique(np.array([7 ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))], np.uint64))
    far = rng.integers(0, 2 ** 63, 100).astype(np.uint64)
    values = np.concatenate([near, far, near[:20]])
    groups = np.repeat([1, 2, 3], [len(near), len(far), 20])
    a, b = simhash._links(groups, values, 4)
    assert len(a) < 2 * len(values) and (np.bitwise_count(a ^ b) <= 4).all()
    assert len(np.unique(np.concatenate([a, b]))) == len(near)


def test_thresholds_add_up_and_follow_the_data():
    n, both = 1000, np.full((64, 64), 250.0)
    both[:8] = both[:, :8] = 0  # eight bits that never differ
    np.fill_diagonal(both, np.where(np.arange(64) < 8, 0, 500))
    groups = simhash.correlated_groups(n, both, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    _, chosen = simhash.allocate(n, both, groups, 4)
    assert sum(chosen) == 2


def test_empty_table(spark):
    assert simhash.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == (
        {(i, 0) for i in range(101)} | {(500, 500), (501, 500)})
