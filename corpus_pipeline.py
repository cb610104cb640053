"""A corpus from raw documents to packed sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsieve.llm.common import stored, table, word_count
from rowsieve.llm.minhash import one_of_each
from rowsieve.llm.mixing import mixed_rows
from rowsieve.llm.packing import LENGTH, pack
from rowsieve.llm.pii import redacted
from rowsieve.llm.quality import kept_documents
from rowsieve.llm.queries import word_tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]



def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts stays."""
    return one_of_each(docs, "doc_id")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the names of its kinds."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once, twice or not at all, as the sources' targets ask; shards are sorted."""
    mixed = mixed_rows(docs, "source", word_count())
    dealt = mixed.repartition("mix_shard", F.pmod("mix_turn", F.lit(SPREAD)))
    return dealt.sortWithinPartitions("mix_shard", "mix_turn").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: pieces of documents with their ids, sequence and place in it."""
    return pack(docs, "doc_id", "text", word_tokenizer(), LENGTH)


# Parts into which a shard is dealt and sorted.
SPREAD = 16
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("minhash near-dedup", near_dedup),
    ("pii", pii),
    ("mixing", mixing),
    ("packing", packing),
]
# Consistent sampling, boosted trees and a tokeniser are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if place == 0 else stored(docs), sf_dir)
    return docs
