"""Targets against repeated resharing, copies against their rule, and the SQL of the registered queries."""

import random
import re

import pytest

from meterload.llm import mixing
from meterload.llm.queries import ORACLES, QUERIES
from tools.compare import normalise, oracle_frame

SCHEMA = "doc_id long, text string, source string, size string, target double, copy_no int"
FOLDER = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shared(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """Targets by literal resharing: what is above the cap goes to the others by weight, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = {}
    while True:
        rest = share * sum(sizes.values()) - sum(capped.values())
        open_ = [s for s in names if s not in capped]
        total = sum(weight[s] for s in open_)
        target = {s: rest * weight[s] / total for s in open_}
        above = [s for s in open_ if target[s] > cap * sizes[s]]
        if not above:
            return capped | target
        capped |= {s: cap * sizes[s] for s in above}


def corpus(seed):
    rng = random.Random(seed)
    sources = ["b", "a", "Z", "é", "中", "\U0001f600", "ﬁ", None, "empty"]
    rows = []
    for i in range(900):
        source = "b" if rng.random() < 0.4 else rng.choice(sources)
        text = "" if source == "empty" else rng.choice((" ", "\n", "\x0b ")).join(["w"] * int(rng.paretovariate(1.2)))
        rows.append((i, rng.choice((text, text, text, None)), source))
    return rows + [(5, "a b", "a"), (5, "a b", "a"), (None, "a b c", "a"), (None, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_copies(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "s", 0.5, 7) for r in rows], SCHEMA)
    got = mixing.mix(df).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    want = shared(sizes)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate), int(rate) + 1) and r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    largest = max(words(t) for _, t, _ in rows)
    for source, total in taken.items():
        assert abs(total - want[source]) <= max(largest, 0.1 * want[source])
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))  # reruns agree
    out = mixing.emit(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.copies for r in got)


def test_edges(spark):
    one = spark.createDataFrame([(1, "a b", "s", "x", 0.0, 1)], SCHEMA)
    assert [(r.target, r.copies in (1, 2)) for r in mixing.mix(one).collect()] == [(3.0, True)]
    assert mixing.mix(one.limit(0)).count() == 0 and mixing.emit(one.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, None, "x", 0.0, 1), (2, " ", "s", "x", 0.0, 1)], SCHEMA)
    assert [(r.size, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0), (0, 0)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_registered_queries_match_their_sql(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = oracle_frame(FOLDER, ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns) and normalise(got) == normalise(want)
