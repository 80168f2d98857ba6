"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Words are runs of letters and digits, lower case; shingles are five words (a shorter text is one shingle). An item
contaminates a document that contains at least `threshold` of the item's distinct shingles, however long the
document is. An item of fewer than five words is found only as the whole of a document: longer ones have no such shingle.

Search: items are partitioned by the number of their shingles, up to a power of two. The sketch of an item is its
k smallest shingle hashes (bottom-k MinHash), with k from the largest size u of its partition:
k = floor((1 - threshold) * u) + 1. A document with the containment asked for lacks at most k - 1 of the item's
shingles, so it has at least one of any k: nothing is lost, and the sketches are the only thing that documents
are looked up in. They are a written table, so Spark knows their size: below its own limit they are sent to the executors
and documents are hashed in one pass without a shuffle, beyond it both sides are shuffled by hash.

Verification: each candidate document meets all its candidate items at once and intersects the shingles
themselves, not their hashes.

Defined cases: null texts and texts without words have no shingles and match nothing. Of rows that repeat a doc_id
the largest containment counts; a null doc_id is reported as null. Items that repeat an item_id count as one text
each, the largest containment counts. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterload.llm.common import let
from meterload.sources.tables import stored

SHINGLE = 5
THRESHOLD = 0.8


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(text: Column, make) -> Column:
    """`make` of each run of SHINGLE words, or of all words if there are fewer; null without words."""
    def body(found: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(found) - SHINGLE + 1), lambda i: make(F.slice(found, i, SHINGLE)))
        return F.when(F.size(found) >= SHINGLE, runs).when(F.size(found) > 0, F.array(make(found)))

    return let(words(text), body)


def shingle_hashes(text: Column) -> Column:
    return _shingles(text, F.xxhash64)


def shingle_texts(text: Column) -> Column:
    return F.array_distinct(_shingles(text, lambda run: F.array_join(run, " ")))


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, hash): the bottom-k sketch of each item."""
    hashes = F.array_sort(F.array_distinct(F.col("hashes")))
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("hashes"))))
    k = F.floor(F.lit(1 - threshold + 1e-9) * largest).cast("int") + 1
    return (items.select("item_id", shingle_hashes(F.col("text")).alias("hashes")).where("hashes is not null")
            .select("item_id", hashes.alias("hashes"))
            .select("item_id", F.explode(F.slice("hashes", F.lit(1), k)).alias("hash")).distinct())


def candidates(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id) of documents with at least one sketch shingle of the item, stored."""
    keys = stored(sketches(items, threshold), "sketches")
    hashed = docs.select("doc_id", F.explode(shingle_hashes(F.col("text"))).alias("hash"))
    found = hashed.join(keys, "hash")
    return stored(found.select("doc_id", "item_id").distinct(), "leak-candidates")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of pairs with a containment of `threshold` or more."""
    pairs = candidates(docs.select("doc_id", "text"), items.select("item_id", "text"), threshold)
    texts = items.select("item_id", shingle_texts(F.col("text")).alias("item")).where("item is not null")
    wanted = pairs.join(texts, "item_id").groupBy("doc_id").agg(
        F.collect_list(F.struct("item_id", "item")).alias("items")).withColumnRenamed("doc_id", "_leak_id")
    held = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_leak_id"))).select(
        "doc_id", shingle_texts(F.col("text")).alias("shingles"), "items")
    counted = held.select("doc_id", F.explode(F.transform("items", lambda one: F.struct(
        one["item_id"].alias("item_id"), F.size(F.array_intersect("shingles", one["item"])).alias("n_shared"),
        F.size(one["item"]).alias("n_item")))).alias("pair"))
    ratio = F.col("n_shared") / F.col("n_item")
    kept = counted.select("doc_id", "pair.*").withColumn("containment", ratio).where(
        F.col("containment") >= F.lit(threshold))
    best = F.max_by(F.struct("n_shared", "n_item", "containment"), F.struct("containment", "n_shared")).alias("best")
    return kept.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("best.n_shared").cast("long").alias("n_shared"),
        F.col("best.n_item").cast("long").alias("n_item"), F.col("best.containment").alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that no item contaminates; rows with the same doc_id go together."""
    bad = stored(contaminated(docs, items, threshold).select(F.col("doc_id").alias("_leak_id")).distinct(), "leaks")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_leak_id")), "left_anti")


ORACLE = r"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
doc_shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    ELSE [array_to_string(w, ' ')] END) AS s FROM doc_words WHERE len(w) > 0),
item_shingles AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    ELSE [array_to_string(w, ' ')] END) AS s FROM item_words WHERE len(w) > 0),
sizes AS (SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (s)
           GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared / n_item >= 0.8
"""
