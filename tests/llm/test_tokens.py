"""Attribution against brute force over bytes, and exact round trips."""

import random

import numpy as np
import pytest

from meterload.llm import tokens as T

SCHEMA = "doc_id long, text string, kind string, section string"


def encoder():
    with open(T.DEFAULT_VOCABULARY, "rb") as file:
        return T.Encoder.of(file.read(), T.PATTERN)


def brute(text, rule):
    """Tokens of each section by walking over the bytes of the decoded tokens."""
    raw = text.encode()
    starts, fresh = [0], False
    for i, b in enumerate(raw):
        if i and raw[i - 1] == 10 and b != 10 and any(c != 10 for c in raw[:i]):
            starts.append(i)
    section = [sum(s <= i for s in starts) - 1 for i in range(len(raw))]
    ids = encoder().encoding.encode_ordinary(text)
    n, cross, share, at = [0] * len(starts), [0] * len(starts), [0.0] * len(starts), 0
    joined = b""
    for i in ids:
        piece = encoder().encoding.decode_single_token_bytes(i)
        joined += piece
        held = {}
        for p in range(at, at + len(piece)):
            held[section[p]] = held.get(section[p], 0) + 1
        at += len(piece)
        owner = min(held) if rule == "start" else max(sorted(held), key=lambda s: held[s])
        n[owner] += 1
        for s, h in held.items():
            share[s] += h / len(piece)
            cross[s] += len(held) > 1
    assert joined == raw
    return [(i, starts[i], n[i], cross[i], round(share[i], 9)) for i in range(len(starts))]


def texts():
    rng = random.Random(6)
    parts = ["word", " the", "\n", "\n\n", "\n\n\n", " ", "  ", "\t\n", "é", "日本", "<|endoftext|>", "12", "a | b | c", "- x", "😀", ".\n"]
    out = ["a", "\n", "\n\n", "\na", "\n\na\n\nb", "a\n", "a\n\n", "x" * 30_000, " " * 3000 + "\n" + "y", "a\r\nb"]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(200)]


@pytest.mark.parametrize("rule", T.RULES)
def test_sections_match_brute_force(spark, rule):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "k", "s") for i, t in rows] + [(None, None, "k", "s"), (9999, "", "k", "s")], SCHEMA)
    got = {}
    for r in T.section_tokens(df, rule=rule).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.byte_start, r.n_tokens, r.n_crossing, round(r.share, 9)))
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        assert sorted(got[i]) == brute(t, rule), repr(t)


def test_kinds():
    assert [T.kind_of(*a) for a in (("Title", True, True), ("Title", True, False), ("a | b | c", False, True), ("1. x", False, True))] == [
        "heading", "prose", "table", "list"]


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b\nc", "k", "s"), (1, "a b\nc", "k", "s"), (None, "a", "k", "s")], SCHEMA)
    assert [(r.doc_id, r.section) for r in T.section_tokens(df).orderBy("doc_id", "section").collect()] == [
        (None, 0), (1, 0), (1, 0), (1, 1), (1, 1)]
    assert T.section_tokens(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        T.section_tokens(df, rule="half")
    tokens, parts, share = T.attribute(np.array([4]), np.array([0, 2]), 4, "majority")
    assert tokens.tolist() == [1, 0] and parts.tolist() == [1, 1] and share.tolist() == [0.5, 0.5]
