"""Repeated spans against brute force over all windows."""

import random
import re

import pytest

from meterload.llm import substring as S

SCHEMA = "doc_id long, text string, doc long, place string"


def brute(rows):
    split = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    least = {}
    for i, words in split:
        if i is not None:
            for p in range(len(words) - 49):
                key = tuple(words[p:p + 50])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        if i is not None:
            for p in range(len(words) - 49):
                if least[tuple(words[p:p + 50])] < i:
                    gone.update(range(p, p + 50))
        out.append((str(i), len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)] + ["Ä", "é x"]

    def text(n):
        return [rng.choice(words) for _ in range(n)]

    passages = [text(n) for n in (49, 50, 51, 60, 75, 88, 120, 300)]
    rows = [(None, None), (0, None), (1, ""), (2, " \n\t "), (3, " ".join(text(49))), (None, " ".join(passages[-1]))]
    for i in range(60):
        body = text(rng.choice((0, 5, 40, 120, 700)))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, max(1, len(p) - 45))
            cut = p[a:] if rng.random() < 0.3 else p[: len(p) - a] if rng.random() < 0.3 else p
            at = rng.randrange(len(body) + 1)
            body[at:at] = cut
        rows.append((rng.choice((10 + i, 10 + i, 7)), rng.choice((" ", "\n", " \t")).join(body)))
    rows += [(200, rows[20][1]), (201, rows[20][1]), (201, rows[20][1]), (202, rows[25][1] + " end")]
    rows += [(300, "a " * 120), (301, "a " * 70), (302, "a b " * 80), (303, "b a " * 90), (304, "x" * 100_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 5, "p") for i, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in S.without_repeats(df).collect())
    assert got == brute(rows)


def test_paths_cover_all_windows_once():
    rng = random.Random(3)
    for n in (50, 51, 90, 400):
        words = [str(rng.randrange(40)).encode() for _ in range(n)]
        _, _, first, more = S.paths(words)
        assert [p for a, m in zip(first, more) for p in range(a, a + m + 1)] == list(range(n - 49))
        assert more.max() < 1 << 6


def test_run_hashes_do_not_depend_on_place():
    words = [b"%d" % (i % 97) for i in range(5000)]
    a, = S.run_hashes(S.word_hashes(words), (50,))
    assert (a[:97] == a[97 * 20:97 * 21]).all() and len(set(a.tolist())) == 97


def test_empty_table(spark):
    assert S.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
