"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next.

* language: documents go whose text is null, has no letter or is in none of the languages learned;
* near_duplicates: of each class of documents whose SimHash fingerprints (four-word shingles) link within 4 bits, the
  one with the smallest doc_id stays;
* decontaminate: documents that contain a benchmark item go;
* pseudonyms: personal data in the texts is replaced; no document goes;
* mix: each document is emitted as often as the target weight of its source asks for.

Nulls in any column, empty and very long texts, ties, repeated rows and columns beyond those of documents pass through
each stage as its operator states. A null or empty text goes in `language`. Rows with a null doc_id: near_duplicates keeps
one row of a class whose members all lack an id; of rows that share the smallest doc_id one stays. An empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterload.llm import decontaminate, langid, mixing, pseudonyms, simhash
from meterload.llm.common import table
from meterload.sources.tables import stored

#: Least part of a text's n-grams that its language must explain.
MIN_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.recognised(docs, langid.learn(docs), MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(docs, pseudonyms.session_key(spark))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("pseudonyms", pseudonymised),
    ("mix", mixed),
]

#: No SQL: fingerprints need XXH64, which DuckDB does not have. Tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
