"""Containment search against brute force over all pairs."""

import random
import re

import pytest

from meterload.llm import decontaminate as D

DOCS = "doc_id long, text string, hash string, item_id int"
ITEMS = "item_id long, text string, words string"


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def brute(docs, items, threshold=0.8):
    best = {}
    for i, text in docs:
        for j, item in items:
            a, b = shingles(text), shingles(item)
            if b and len(a & b) / len(b) >= threshold:
                best[i, j] = max(best.get((i, j), (0, 0)), (len(a & b) / len(b), len(b)))
    return sorted((str(i), str(j), n, c) for (i, j), (c, n) in best.items())


def corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 3, 5, 6, 11, 40, 90))))) for i in range(40)]
    items += [(3, " ".join(rng.choice(words) for _ in range(30))), (40, None), (41, ""), (42, "?! .")]
    docs = [(None, None), (1, ""), (2, items[4][1]), (2, "other words of no interest at all"), (None, items[5][1])]
    for i in range(80):
        text = [rng.choice(words) for _ in range(rng.choice((3, 60, 2000)))]
        if i % 2:
            part = rng.choice(items[:40])[1].split()
            for _ in range(rng.randrange(0, 3)):  # up to two words changed
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() + "," for w in part]
        docs.append((10 + i, "\n".join(text)))
    docs.append((500, " ".join(t for _, t in items if t)))
    return docs, items


@pytest.fixture(params=["32MB", "-1"])
def broadcast_limit(spark, request):
    """Sketches sent to the executors, or shuffled."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_matches_brute_force(spark, broadcast_limit):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, "h", 1) for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, "w") for i, t in items], ITEMS)
    got = sorted((str(r.doc_id), str(r.item_id), r.n_item, r.containment) for r in D.contaminated(d, q).collect())
    want = brute(docs, items)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want))
    bad = {g[0] for g in got}
    kept = D.clean(d, q)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if str(i) not in bad)


def test_empty_tables(spark):
    d, q = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "a b c", "h", 1)], DOCS)
    assert D.contaminated(d, q).count() == 0 and D.contaminated(one, q).count() == 0 and D.clean(one, q).count() == 1
