"""Prefix trie of conversations by adaptive radix trees over fixed-width turn ids.

A turn's id is the first 16 bytes of the SHA-256 of its role and text, so a conversation is a byte string, one id after
the other, and its prefixes of whole ids are the nodes of the trie. Ids need no dictionary, and texts are never shuffled.

1. Equal conversations become one sequence. Rows are dealt by ranges of (ids, conv_id), so a conversation that half of
   all rows repeat is spread over many tasks; each task joins the ids of its members into rows of up to MEMBERS.
2. Sequences are dealt by ranges of ids and sorted. Each task grows radix trees of up to TREE_TURNS turns: layouts of 4,
   16, 48 and 256 children, each replaced by the next one when it is full, and compressed paths. Trees are walked once,
   children first; only byte depths that are multiples of 16 emit nodes, with all sums over their subtrees.
3. As sequences are sorted, a node of two trees lies on the first or last path of each. Only those nodes are merged:
   their counts add up; leaves and children that more than one tree counted are taken off, and the one member that each
   tree left out of `saved` is given back, save one, to a node and its ancestors. All others
   are final. Children of merged nodes read their parent's smallest member from the merged ones.

Memory per task is bounded by TREE_TURNS and one conversation (20 bytes a turn). The digest of a node's members is
sequential by its nature: one task reads the members of one sequence as a stream of joined rows.

Defined cases: null roles and texts count as empty; turns are ordered by number, null first, ties by role
and text; repeated rows are turns of their own; rows without a conv_id take no part. Texts of any length are hashed whole. A conversation
without turns is a member of the root only. Other columns of the input are not read. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterload.llm.common import count_words
from meterload.sources.tables import stored

#: Bytes of a turn id, and of a word count.
WIDTH, COUNT = 16, 4
#: Most ids in a row of joined members, and turns in a tree (one longer conversation is a tree of its own).
MEMBERS, TREE_TURNS = 4096, 50_000
#: Rows of an Arrow batch that a task emits.
BATCH = 5_000

NO_MEMBERS = hashlib.sha256(b"").hexdigest()


# Sequences ----------------------------------------------------------------------------------------------------------

def _turn_id(role: Column, text: Column) -> Column:
    """32 hex digits; the role's length keeps role and text apart."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)


def turn_lists(rows: DataFrame) -> DataFrame:
    """(base, conv_id, turns) of turn rows; `base` is conv_id without its remainder by 20, by which rows are dealt."""
    rows = rows.where(F.col("conv_id").isNotNull()).select(
        (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("base", "conv_id").orderBy("turn", "role", "text")
    turns = rows.repartition("base").withColumn("place", F.row_number().over(order))
    one = F.struct("place", _turn_id(F.col("role"), F.col("text")).alias("id"), count_words(F.col("text")).cast("int").alias("words"))
    return turns.select("base", "conv_id", one.alias("one")).groupBy("base", "conv_id").agg(
        F.sort_array(F.collect_list("one")).alias("turns"))


def with_shared_heads(lists: DataFrame) -> DataFrame:
    """Conversations whose first turns are those of their base: as many as the crc32 of conv_id says, at most 3."""
    own = F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 3))
    head = F.coalesce(F.first(own, ignorenulls=True).over(Window.partitionBy("base")), F.slice("turns", 1, 0))
    shared = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    return lists.select("conv_id", "turns", head.alias("head"), shared.alias("shared")).select(
        "conv_id", F.concat(F.slice("head", F.lit(1), F.col("shared")),
                            F.slice("turns", F.col("shared") + 1, F.size("turns"))).alias("turns"))


def sequences(lists: DataFrame) -> DataFrame:
    """(conv_id, ids, words): ids and word counts of all turns, each as one byte string."""
    words = F.transform("turns", lambda t: F.lpad(F.hex(t["words"].cast("long")), 2 * COUNT, "0"))
    return lists.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("ids"),
        F.unhex(F.array_join(words, "")).alias("words"))


# Radix tree ---------------------------------------------------------------------------------------------------------

class Sorted:
    """Up to 4 or 16 children beside their sorted key bytes."""

    __slots__ = ("size", "keys", "nodes")

    def __init__(self, size: int = 4) -> None:
        self.size, self.keys, self.nodes = size, bytearray(), []

    def find(self, byte: int) -> Node | None:
        place = self.keys.find(byte)
        return None if place < 0 else self.nodes[place]

    def put(self, byte: int, node: Node) -> Children:
        """Add or replace a child; the layout that holds it then."""
        place = bisect_left(self.keys, byte)
        if place < len(self.keys) and self.keys[place] == byte:
            self.nodes[place] = node
            return self
        if len(self.keys) == self.size:
            return self.larger().put(byte, node)
        self.keys.insert(place, byte)
        self.nodes.insert(place, node)
        return self

    def larger(self) -> Children:
        new: Children = Sorted(16) if self.size == 4 else Indexed()
        for byte, node in zip(self.keys, self.nodes):
            new = new.put(byte, node)
        return new

    def __iter__(self) -> Iterator[Node]:
        return iter(self.nodes)


class Indexed:
    """Up to 48 children behind an index of 256 bytes."""

    __slots__ = ("index", "nodes")

    def __init__(self) -> None:
        self.index, self.nodes = bytearray(256), []

    def find(self, byte: int) -> Node | None:
        place = self.index[byte]
        return self.nodes[place - 1] if place else None

    def put(self, byte: int, node: Node) -> Children:
        if place := self.index[byte]:
            self.nodes[place - 1] = node
        elif len(self.nodes) < 48:
            self.nodes.append(node)
            self.index[byte] = len(self.nodes)
        else:
            full = Full()
            for b, old in enumerate(self.index):
                if old:
                    full.nodes[b] = self.nodes[old - 1]
            return full.put(byte, node)
        return self

    def __iter__(self) -> Iterator[Node]:
        return (self.nodes[place - 1] for place in self.index if place)


class Full:
    """A child for each byte."""

    __slots__ = ("nodes",)

    def __init__(self) -> None:
        self.nodes: list[Node | None] = [None] * 256

    def find(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Children:
        self.nodes[byte] = node
        return self

    def __iter__(self) -> Iterator[Node]:
        return (node for node in self.nodes if node is not None)


Children = Sorted | Indexed | Full


class Node:
    """A compressed path below its key byte, the sequence that ends there, and one that passes through."""

    __slots__ = ("path", "end", "some", "children")

    def __init__(self, path: bytes, some: int, end: int | None = None) -> None:
        self.path, self.some, self.end, self.children = path, some, end, Sorted()


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Tree:
    """Radix tree of distinct sequences, each with its members' count, smallest id and digest."""

    def __init__(self) -> None:
        self.root: Node | None = None
        self.kept: list[tuple[bytes, bytes, int, int, str]] = []
        self.turns = 0

    def add(self, ids: bytes, words: bytes, n: int, first: int, digest: str) -> None:
        number = len(self.kept)
        self.kept.append((ids, words, n, first, digest))
        self.turns += len(ids) // WIDTH + 1
        if self.root is None:
            self.root = Node(ids, number, number)
            return
        node, at, above = self.root, 0, None
        while True:
            shared = _common(node.path, ids[at:at + len(node.path)])
            if shared < len(node.path):
                upper = Node(node.path[:shared], node.some)
                upper.children = upper.children.put(node.path[shared], node)
                node.path = node.path[shared + 1:]
                if above is None:
                    self.root = upper
                else:
                    above.children = above.children.put(ids[at - 1], upper)
                node = upper
            at += shared
            if at == len(ids):
                node.end = number
                return
            child = node.children.find(ids[at])
            if child is None:
                node.children = node.children.put(ids[at], Node(ids[at + 1:], number, number))
                return
            above, node, at = node, child, at + 1

    def rows(self) -> Iterator[dict]:
        """The nodes at whole turns, with the sums over their subtrees within this tree."""
        if self.root is None:
            return
        edge = {name for i in (0, -1) for name in _names(self.kept[i][0])}
        out: list[dict] = []
        # Names of the nodes on a path, from the root's: each is the digest of its parent's name and its turn.
        todo: list[tuple[Node, int, list[bytes], bool]] = [(self.root, -1, [], False)]
        sums: dict[int, tuple] = {}
        while todo:
            node, start, names, children_done = todo.pop()
            stop = max(start, 0) + len(node.path)
            depths = range(stop // WIDTH, start // WIDTH, -1)
            ids, words = self.kept[node.some][:2]
            if not children_done:
                names = names[:]
                for d in reversed(depths):
                    names.append(_name(names[-1], ids[(d - 1) * WIDTH:d * WIDTH]) if d else bytes(WIDTH))
                names = names[-len(depths) - 1:]
                todo.append((node, start, names, True))
                todo.extend((child, stop + 1, names, False) for child in node.children)
                continue
            below = [sums.pop(id(child)) for child in node.children]
            if node.end is not None:
                below.append((self.kept[node.end][2], self.kept[node.end][3], 0, 0, 0))
            n, first = sum(b[0] for b in below), min(b[1] for b in below)
            leaves, saved, kids = (sum(b[i] for b in below) for i in (2, 3, 4))
            for d in depths:
                count = int.from_bytes(words[(d - 1) * COUNT:d * COUNT], "big") if d else 0
                leaf = kids == 0
                leaves, saved = leaves + leaf, saved + (n - 1) * count
                name = names[d - depths.stop - 1 + (len(names) - len(depths))]
                ends = node.end is not None and d * WIDTH == stop
                out.append({
                    "node": name, "parent": names[d - depths.stop - 2 + (len(names) - len(depths))] if d else None,
                    "depth": d, "first": first, "n": n, "words": count, "leaves": leaves, "saved": saved,
                    "children": kids, "leaf": leaf, "edge": name in edge,
                    "ends": self.kept[node.end][4] if ends else None,
                    "above": _names(ids[:d * WIDTH])[:-1] if name in edge else None})
                kids = 1
            sums[id(node)] = (n, first, leaves, saved, kids)
        smallest = {row["node"]: row["first"] for row in out if not row["edge"]}
        for row in out:
            yield row | {"parent_first": smallest.get(row["parent"])}


def _name(parent: bytes, turn: bytes) -> bytes:
    return hashlib.sha256(parent + turn).digest()[:WIDTH]


def _names(ids: bytes) -> list[bytes]:
    """Names of the nodes along a sequence, the root's first."""
    names = [bytes(WIDTH)]
    for at in range(0, len(ids), WIDTH):
        names.append(_name(names[-1], ids[at:at + WIDTH]))
    return names


# Tasks --------------------------------------------------------------------------------------------------------------

_RUN = pa.schema([("ids", pa.binary()), ("words", pa.binary()), ("first", pa.int64()), ("n", pa.int64()),
                  ("members", pa.string())])
_NODE = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("first", pa.int64()),
                   ("n", pa.int64()), ("words", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()),
                   ("children", pa.int64()), ("leaf", pa.bool_()), ("edge", pa.bool_()), ("ends", pa.string()),
                   ("above", pa.list_(pa.binary())), ("parent_first", pa.int64())])
_RUN_DDL = "ids binary, words binary, first long, n long, members string"
_NODE_DDL = ("node binary, parent binary, depth long, first long, n long, words long, leaves long, saved long, "
             "children long, leaf boolean, edge boolean, ends string, above array<binary>, parent_first long")


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    some: list[dict] = []
    for row in rows:
        some.append(row)
        if len(some) == BATCH:
            yield pa.RecordBatch.from_pylist(some, schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for small in range(0, batch.num_rows, BATCH):
            yield from zip(*[column.to_pylist() for column in batch.slice(small, BATCH).columns])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (ids, conv_id, words) to rows of equal sequences with their joined members."""
    def runs() -> Iterator[dict]:
        now, members = None, []
        for ids, conv_id, words in _rows(batches):
            if members and (now[0] != ids or len(members) == MEMBERS):
                yield run(now, members)
                members = []
            now = (ids, words)
            members.append(conv_id)
        if members:
            yield run(now, members)

    def run(now: tuple, members: list[int]) -> dict:
        return {"ids": now[0], "words": now[1], "first": members[0], "n": len(members),
                "members": ",".join(map(str, members))}

    return _batched(runs(), _RUN)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs to nodes, by one tree after the other."""
    def nodes() -> Iterator[dict]:
        tree, now, digest = Tree(), None, None
        for ids, words, first, n, members in _rows(batches):
            if now is not None and now[0] == ids:
                now[2] += n
                digest.update(b"," + members.encode())
                continue
            if now is not None:
                tree.add(*now, digest.hexdigest())
                if tree.turns >= TREE_TURNS:
                    yield from tree.rows()
                    tree = Tree()
            now, digest = [ids, words, n, first], hashlib.sha256(members.encode())
        if now is not None:
            tree.add(*now, digest.hexdigest())
        yield from tree.rows()

    return _batched(nodes(), _NODE)


# Nodes --------------------------------------------------------------------------------------------------------------

def prefix_nodes(seqs: DataFrame) -> DataFrame:
    """One row per node of (conv_id, ids, words): conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    dealt = seqs.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    runs = stored(dealt.select("ids", "conv_id", "words").mapInArrow(_runs, _RUN_DDL), "trie-runs")
    grown = runs.repartitionByRange("ids").sortWithinPartitions("ids", "first").mapInArrow(_grow, _NODE_DDL)
    nodes = stored(grown, "trie-nodes")
    merged = stored(_merged(nodes.where("edge")), "trie-merged")
    known = ["node", "parent", "depth", "first", "n", "children", "leaves", "saved", "ends"]
    inner = nodes.where("NOT edge")
    of_merged = inner.where("parent_first IS NULL").select(*known).unionByName(merged.select(*known))
    parents = merged.select(F.col("node").alias("parent"), F.col("first").alias("parent_first"))
    out = inner.where("parent_first IS NOT NULL").select(*known, "parent_first").unionByName(
        of_merged.join(parents, "parent", "left").select(*known, "parent_first"))
    return out.select(
        F.col("first").alias("conv_id"), "depth", F.col("parent_first").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_MEMBERS)).alias("ends_sha256"))


def _merged(edge: DataFrame) -> DataFrame:
    """Nodes on the first or last path of trees, each once: sums over trees, less what trees counted too often. Each tree
    saves the words of one member less, all together only those of one: `less_saved` is negative."""
    summed = stored(edge.groupBy("node", "parent", "depth", "words").agg(
        F.min("first").alias("first"), *[F.sum(c).alias(c) for c in ("n", "leaves", "saved", "children")],
        F.max("ends").alias("ends"), F.count("*").alias("trees"), F.max("above").alias("above"),
        (F.count_if("leaf") - F.every("leaf").cast("long")).alias("false_leaves")), "trie-edges")
    twice = summed.where("trees > 1 OR false_leaves > 0")
    own = twice.select(
        F.explode(F.array_append("above", F.col("node"))).alias("node"), F.col("false_leaves").alias("less_leaves"),
        ((1 - F.col("trees")) * F.col("words")).alias("less_saved"), F.lit(0).cast("long").alias("less_children"))
    up = twice.where("depth > 0").select(
        F.col("parent").alias("node"), F.lit(0).cast("long").alias("less_leaves"),
        F.lit(0).cast("long").alias("less_saved"), (F.col("trees") - 1).alias("less_children"))
    less = own.unionByName(up).groupBy("node").agg(*[
        F.sum(f"less_{c}").alias(f"less_{c}") for c in ("leaves", "saved", "children")])
    exact = [(F.col(c) - F.coalesce(f"less_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved", "children")]
    return summed.join(less, "node", "left").select("node", "parent", "depth", "first", "n", *exact, "ends")


#: The same in SQL for DuckDB, with the columns of op12.
ORACLE = r"""
WITH RECURSIVE own AS (
  SELECT conv_id, list({role: coalesce(role, ''), text: coalesce(text, '')} ORDER BY turn NULLS FIRST,
                       coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
shared AS (
  SELECT *, (xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ord(d)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))),
    4294967295) % 4)::INTEGER AS h FROM own),
rebuilt AS (
  SELECT s.conv_id, coalesce(b.turns, [])[1:s.h] || s.turns[s.h + 1:] AS turns
  FROM shared s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 20),
prefixes AS (
  SELECT conv_id, turns[1:d] AS path, d AS depth, len(turns) = d AS ends
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1)
              * len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM prefixes GROUP BY path, depth),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
known AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)),
subtrees AS (
  SELECT path[1:d] AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM known) GROUP BY ALL)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM known k JOIN subtrees s USING (path)
LEFT JOIN nodes p ON k.depth > 0 AND p.path = k.path[1:k.depth - 1]
"""
