"""The trie against a plain one in dictionaries, radix tree layouts, and the SQL of the registered query."""

import hashlib
import random
import zlib

import pytest

from meterload.llm import trie
from meterload.llm.queries import ORACLES, QUERIES
from tools.compare import normalise, oracle_frame

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def slow_nodes(convs):
    """Nodes of {conv_id: [(role, text), ...]} by prefixes in dictionaries."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for path in members:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    leaves, saved = {}, {}
    for path, own in members.items():
        words = len(path[-1][1].split()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in children)
            saved[path[:d]] = saved.get(path[:d], 0) + (len(own) - 1) * words
    return sorted(
        (min(own), len(path), min(members[path[:-1]]) if path else None, len(own), children.get(path, 0), leaves[path],
         saved[path], hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest())
        for path, own in members.items())


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def nodes_of(spark, rows, shared=False):
    lists = trie.turn_lists(spark.createDataFrame(rows, SCHEMA))
    return found(trie.prefix_nodes(trie.sequences(trie.with_shared_heads(lists) if shared else lists)))


def grouped(rows):
    convs = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            convs.setdefault(c, []).append((role or "", text or ""))
    return convs


def random_rows(seed, n=300, vocabulary=4, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-50, 5 * n), n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), " ".join("w" for _ in range(rng.randrange(vocabulary)))))
    return rows


@pytest.mark.parametrize("tree, members", [(1, 1), (7, 2), (60, 3), (50_000, 4096)])
def test_nodes_equal_the_plain_trie_whatever_the_size_of_trees(spark, monkeypatch, tree, members):
    """Small trees make most nodes edge nodes that several trees share."""
    monkeypatch.setattr(trie, "TREE_TURNS", tree)
    monkeypatch.setattr(trie, "MEMBERS", members)
    rows = random_rows(tree)
    grown = [(c, t, r, x) for c in range(2000, 2400) for t, (r, x) in enumerate([("user", "hot"), ("assistant", "a b c")])]
    assert nodes_of(spark, rows + grown) == slow_nodes(grouped(rows + grown))


def test_shared_heads(spark):
    rows = random_rows(5, 200, vocabulary=8, longest=6)
    own = grouped(rows)
    want = {}
    for c, turns in own.items():
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        h = zlib.crc32(str(c).encode()) % 4
        want[c] = own.get(base, [])[:h] + turns[h:]
    assert any(not turns for turns in want.values())
    assert nodes_of(spark, rows, shared=True) == slow_nodes(want)


def test_a_chain_of_prefixes_and_a_very_long_conversation(spark):
    chain = [(c, t, "user", "same words here") for c in range(60) for t in range(c)]
    assert nodes_of(spark, chain) == slow_nodes(grouped(chain))
    long_ = [(1, t, "user", f"{t % 7} x") for t in range(3000)] + [(2, t, "user", f"{t % 7} x") for t in range(1500)]
    got = nodes_of(spark, long_)
    assert len(got) == 3001 and sum(n[3] for n in got) == 3001 + 1501
    assert [n[6] for n in got if n[1] == 0] == [1500 * 2]


def test_nulls_ties_and_texts(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a"), (2, None, "", ""), (2, 5, "user", "a"), (None, 0, "user", "a"),
            (3, 0, "use", "ra"), (4, 0, "user", "y " * 200_000), (5, 0, "user", "y " * 200_000)]
    got = nodes_of(spark, rows)
    assert got == slow_nodes(grouped(rows))
    same = [(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b"), (2, 0, "user", "b")]
    assert nodes_of(spark, same) == nodes_of(spark, same[::-1])
    assert max(n[1] for n in nodes_of(spark, same)) == 3


def test_turns_of_equal_number_go_by_role_and_text(spark):
    texts = ["b", "a", "ab", "B", "é", "", "c d"]
    rows = [(c, 1, role, text) for c in range(3) for role in ("user", "assistant") for text in texts[c:]]
    rows += [(c, None, None, text) for c in range(3) for text in ("z", None, "y")] + [(1, 1, "user", "ab")]
    want = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode())):
        want.setdefault(c, []).append((role or "", text or ""))
    assert nodes_of(spark, rows[::-1]) == slow_nodes(want)


def test_nodes_that_trees_of_several_tasks_share(spark):
    """Sequences that stay in several tasks: each counts the nodes on their common first turns."""
    rows = random_rows(11, 200, vocabulary=5, longest=6)
    rows += [(c, 7, "user", f"one two {c % 40}") for c in range(5000, 5200)]
    rows += [(c, t, "user", "hot head of many") for c in range(5000, 5200) for t in range(3)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = nodes_of(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == slow_nodes(grouped(rows))


def test_empty_table_has_no_nodes(spark):
    assert nodes_of(spark, []) == []
    assert nodes_of(spark, [(None, 0, "user", "x")]) == []


def test_radix_layouts_grow_and_keep_their_children():
    for n, kind in ((4, trie.Sorted), (16, trie.Sorted), (17, trie.Indexed), (48, trie.Indexed), (49, trie.Full), (256, trie.Full)):
        children, bytes_ = trie.Sorted(), random.Random(n).sample(range(256), n)
        for b in bytes_:
            children = children.put(b, trie.Node(bytes([b]), b))
        assert isinstance(children, kind)
        assert all(children.find(b).some == b for b in bytes_)
        assert [node.some for node in children] == sorted(bytes_)
        other = next((b for b in range(256) if b not in bytes_), None)
        assert other is None or children.find(other) is None
        replaced = children.put(bytes_[0], trie.Node(b"", -1))
        assert replaced is children and children.find(bytes_[0]).some == -1


def test_a_tree_takes_keys_in_any_order():
    rng = random.Random(1)
    ids = [hashlib.sha256(bytes([i])).digest()[:16] for i in range(5)]
    keys = {b"".join(rng.choice(ids) for _ in range(rng.randrange(6))) for _ in range(300)}

    def rows(order):
        tree = trie.Tree()
        for k in order:
            tree.add(k, bytes(len(k) // 4), 1, len(k), "")
        skip = ("edge", "above", "parent_first")
        return sorted(tuple(sorted((k, str(v)) for k, v in row.items() if k not in skip)) for row in tree.rows())

    assert rows(sorted(keys)) == rows(sorted(keys, key=lambda k: hashlib.md5(k).digest()))


def test_common_prefix():
    for a, b, n in ((b"", b"", 0), (b"a", b"b", 0), (b"abc", b"abd", 2), (b"ab", b"abc", 2), (b"x" * 99 + b"y", b"x" * 120, 99)):
        assert trie._common(a, b) == trie._common(b, a) == n


def test_query_equals_its_sql(spark):
    got = QUERIES["op12_prefix_trie"](spark, FOLDER).toPandas()
    assert normalise(got) == normalise(oracle_frame(FOLDER, ORACLES["op12_prefix_trie"]))
