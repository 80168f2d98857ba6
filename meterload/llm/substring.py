"""Removal of long word spans that repeat across documents, on a compacted De Bruijn graph.

Windows of WINDOW words are the edges of a De Bruijn graph over runs of WINDOW - 1 words. Most of its paths do not
branch, so the graph is never stored edge by edge:

1. Compaction. Within a document, consecutive windows that share their minimiser (the KMER-word run with the
   smallest hash; the leftmost if it repeats) form one path. Choice and ends of a path follow from its words and
   one word on either side, so inside a repeated span all documents cut the same paths. A path is one row:
   minimiser, hash of its words, document, place. That is about one row for 20 words.
2. Paths whose minimiser stands in one document only are unique and end here. Of the rest, a path that also stands
   in a smaller document repeats in full, which settles all its windows by one join.
3. Branches. Where different paths share a minimiser, repeated spans may begin or end within a path. Only the first
   document of each such path goes back to its text: source coordinates give its windows, which are compared by
   themselves. Windows of all other documents follow from step 2.
4. Each text meets the coordinates of its repeated windows and drops the words that they cover.

Hashes have 64 bits: words by XXH64, runs by a polynomial of the words' hashes.

Every step groups or joins by hash with partial aggregation or joins that Spark can split, so a passage that a
third of all documents share does not meet in one task, and no pairs of documents are built.

Defined cases: a null text has no words, and keeps the empty text; fewer words than a window keep all. Documents
are judged on the input. Rows that repeat a doc_id do not count as smaller than each other and are judged each on
its own text. A row with a null doc_id is neither judged nor a source. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterload.llm.common import SLICE, as_bytes, map_arrow, words_of
from meterload.sources.tables import stored

WINDOW = 50
#: Words of a minimiser. A window has WINDOW - KMER + 1 of them.
KMER = 12

_BASE = 0x9E3779B97F4A7C15 | 5  # odd, 5 modulo 8
_PLACE = np.uint64((1 << 31) - 1)
# A place packs the first window (31 bits), a tag of the text (26 bits) and the number of windows after it (6 bits).
_TAG_BITS, _MORE_BITS = 26, 6


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, at least n of them; kept per worker."""
    have = getattr(_powers, "kept", None)
    if have is None or len(have[0]) < n:
        size = max(4096, 2 * n)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        have = _powers.kept = (out[0], out[1])
    return have


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


def run_hashes(hashes: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of all runs of each size: differences of one running sum, brought to a common power."""
    n = len(hashes)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * down[:n], out=sums[1:])
    return [_mixed((sums[k:] - sums[:-k]) * up[: n - k + 1]) if n >= k else np.empty(0, np.uint64) for k in sizes]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def paths(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """minimiser, hash, first window and number of further windows of each compacted path."""
    kmers, windows = run_hashes(word_hashes(words), (KMER, WINDOW))
    # Sliding minimum over width positions by doubling; the low bits carry the place, so ties go to the left.
    low = (kmers & ~_PLACE) | np.arange(len(kmers), dtype=np.uint64)
    width, have = WINDOW - KMER + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: have - width], low[width - have:])
    place = (low & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(place)) - 1
    more = (last - first).astype(np.uint64)
    # First and last window overlap, so they and their distance say all words of the path.
    content = _mixed(windows[first] + _mixed(windows[last] ^ (more + np.uint64(1))))
    return kmers[place[first]], content, first, last - first


def text_tag(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) >> (64 - _TAG_BITS)


def _pack(first: np.ndarray, more: np.ndarray | int, tag: int) -> np.ndarray:
    return (first.astype(np.int64) << (_TAG_BITS + _MORE_BITS)) | (tag << _MORE_BITS) | more


def _unpack(places: np.ndarray, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of further windows of the places in the text of this tag."""
    mine = places[(places >> _MORE_BITS & ((1 << _TAG_BITS) - 1)) == tag]
    return mine >> (_TAG_BITS + _MORE_BITS), mine & ((1 << _MORE_BITS) - 1)


def _longs(*columns: list[np.ndarray]) -> list[np.ndarray]:
    empty = np.empty(0, np.int64)
    return [np.concatenate([empty, *(c.view(np.int64) for c in column)]) for column in columns]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes | None]]:
    """doc_id and text of each row, a few at a time as Python objects."""
    for at in range(0, batch.num_rows, SLICE):
        piece = batch.slice(at, SLICE)
        yield from zip(piece.column("doc_id").to_pylist(), as_bytes(piece, "text"))


def graph_paths(docs: DataFrame) -> DataFrame:
    """(kmer, path, doc, place) of every compacted path of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kmers, contents, ids, places = [], [], [], []
            for doc, text in _rows(batch):
                words = words_of(text)
                if len(words) >= WINDOW:
                    kmer, content, first, more = paths(words)
                    kmers.append(kmer)
                    contents.append(content)
                    ids.append(np.full(len(kmer), doc))
                    places.append(_pack(first, more, text_tag(text)))
            columns = _longs(kmers, contents, ids, places)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kmer", "path", "doc", "place"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "kmer long, path long, doc long, place long")


def _with_places(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """(doc_id, text, places): texts with the places found in them."""
    listed = places.groupBy("doc").agg(F.collect_list("place").alias("places"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(listed, F.col("doc_id") == F.col("doc"), how).select("doc_id", "text", "places")


def branch_windows(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(window, doc, place) of each single window of the paths at `places`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ids, found = [], [], []
            for (doc, text), at in zip(_rows(batch), batch.column("places")):
                tag = text_tag(text) if text else 0
                first, more = _unpack(np.asarray(at.values, np.int64), tag)
                if len(first):
                    starts = np.repeat(first - np.cumsum(more + 1) + more + 1, more + 1) + np.arange((more + 1).sum())
                    windows, = run_hashes(word_hashes(words_of(text)), (WINDOW,))
                    hashes.append(windows[starts])
                    ids.append(np.full(len(starts), doc))
                    found.append(_pack(starts, 0, tag))
            columns = _longs(hashes, ids, found)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["window", "doc", "place"])

    return _with_places(docs, places, "inner").mapInArrow(run, "window long, doc long, place long")


def repeated_places(docs: DataFrame) -> DataFrame:
    """(doc, place) of windows, in runs, whose words also start in a smaller document."""
    rows = stored(graph_paths(docs), "paths")
    # Each aggregate is written before it is joined: a side that comes straight from its aggregation keeps that
    # partitioning, and Spark could not split the partition of a minimiser that very many documents share.
    many = stored(rows.groupBy("kmer").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi")
                  .select("kmer"), "shared-kmers")
    rows = stored(rows.join(many, "kmer"), "shared-paths")
    firsts = stored(rows.groupBy("kmer", "path").agg(F.min("doc").alias("first")), "first-paths")
    branches = stored(firsts.groupBy("kmer").agg(F.min("first").alias("lo"), F.max("first").alias("hi"))
                      .where("lo < hi").select("kmer"), "branching-kmers")
    marked = rows.join(firsts, ["kmer", "path"])
    whole = stored(marked.where("first < doc").select("doc", "place"), "repeated-paths")
    open_ = marked.where("first = doc").join(branches, "kmer").select("doc", "place")
    windows = stored(branch_windows(docs, open_), "branch-windows")
    shared = stored(windows.groupBy("window").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
                    .where("first < last").select("window", "first"), "shared-windows")
    single = windows.join(shared, "window").where("first < doc").select("doc", "place")
    return whole.unionByName(single)


def _kept(text: bytes | None, places: pa.ListScalar) -> tuple[int, list[bytes]]:
    """Number of words of a text, and those that no repeated window covers."""
    words = words_of(text)
    if not words or not places.is_valid:
        return len(words), words
    first, more = _unpack(np.asarray(places.values, np.int64), text_tag(text))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + more + WINDOW, -1)
    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return len(words), words if len(stay) == len(words) else [words[i] for i in stay.tolist()]


def _cut_texts(docs: DataFrame, name: str, made: Callable[[bytes], str]) -> DataFrame:
    """(doc_id, n_words, n_removed, `name`): what `made` gives for the kept words of each text, joined by one space."""
    def one(batch: pa.RecordBatch) -> dict[str, list]:
        n_words, n_removed, out = [], [], []
        for at in range(0, batch.num_rows, SLICE):
            piece = batch.slice(at, SLICE)
            for text, places in zip(as_bytes(piece, "text"), piece.column("places")):
                n, words = _kept(text, places)
                n_words.append(n)
                n_removed.append(n - len(words))
                out.append(made(b" ".join(words)))
        return {"doc_id": batch.column("doc_id"), "n_words": n_words, "n_removed": n_removed, name: out}

    rows = _with_places(docs, stored(repeated_places(docs), "repeated-places"), "left")
    return map_arrow(rows, one, f"doc_id long, n_words long, n_removed long, {name} string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    return _cut_texts(docs, "kept", bytes.decode)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """The same with the SHA-256 of `kept` as kept_sha256, made where the text is: no text comes back from the task."""
    return _cut_texts(docs, "kept_sha256", lambda kept: hashlib.sha256(kept).hexdigest())
