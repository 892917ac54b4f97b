"""From raw documents to packed training sequences.

Each stage takes what the one before kept, written as Parquet and read again. All but the last return the columns of
``documents``; the last returns the pieces of packed sequences with their token ids.

Nulls, ties and odd rows: a null, empty or very short text fails the quality rules, and a text of any length is judged, cleaned,
compared and packed whole. Of near copies the least id stays; rows that share an id with other texts are one group, of which one row
stays, and rows without an id are in no group. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from graphloom.llm import decontam, lines, nearcopies, packing, quality
from graphloom.llm.common import read_table, stored
from graphloom.llm.queries import vocabulary_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; n_chars follows the text."""
    return lines.clean(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document of smallest id stays; those without an id stay all.

    Near duplicates have an exact Jaccard similarity of five-word shingles of 0.8 or more. SimHash signatures with deletion
    variants find the close ones; they cannot find all, so the others come from a prefix filter, which misses none.
    """
    return nearcopies.keep_first(docs, n_words=5, similarity=(4, 5))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"), window=10)


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path(), capacity=2048, end_id=1, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("harmonic_packing", harmonic_packing),
]

#: Fingerprints, tokens and suffix arrays are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
