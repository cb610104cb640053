"""The named queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsieve.llm.audit import audit, masks
from rowsieve.llm.brown import scores
from rowsieve.llm.common import full_text, table, word_count
from rowsieve.llm.minhash import near_duplicates
from rowsieve.llm.mixing import mix
from rowsieve.llm.packing import LENGTH, pack
from rowsieve.llm.passages import repeated_passages
from rowsieve.llm.phrases import collocations, frequent_phrases
from rowsieve.llm.pii import personal_data
from rowsieve.llm.quality import judged, references
from rowsieve.llm.sharding import ring_shards
from rowsieve.llm.suffixes import without_repeats
from rowsieve.llm.topk import top_k
from rowsieve.llm.urls import Rule, judged_urls

def word_tokenizer() -> str:
    """The vocabulary file of the packing queries; other tokenisers are a parameter away."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


Query = Callable[[SparkSession, str], DataFrame]


def ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(full_text()) + F.lit(8)).cast("long").alias("size"),
        F.crc32(full_text()).alias("text_crc32"),
    )
    sharded = ring_shards(rows, "doc_id", 24, carry=["size", "text_crc32"])
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    mixed = mix(documents, F.col("doc_id"), F.col("source"), word_count())
    return mixed.rows.select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "source", "draws"
    )


def pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"), "doc_id")
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = F.col("vec_id") % 100 == 0
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", asks, 10)


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), "doc_id")
    return found.select(
        "doc_id",
        F.col("class").alias("class_id"),
        F.col("size").alias("class_size"),
        F.col("links").alias("n_links"),
        (F.col("doc_id") == F.col("class")).alias("kept"),
    )


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = judged(documents.select("doc_id", "text", "lang"), references(documents))
    return found.drop("text", "lang", "class_distance", "word_distance")


# The rules of the URL query.
URL_RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(table(spark, sf_dir, "pages"), "page_id", "url", URL_RULES)


def sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    checksum = F.crc32("ids").alias("ids_crc32")
    documents = table(spark, sf_dir, "documents")
    return pack(documents, "doc_id", "text", word_tokenizer(), LENGTH, checksum)


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), "doc_id", texts=False)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"), "doc_id")
    return found.withColumnsRenamed(
        {"class_key": "class_doc_id", "size": "class_size", "links": "n_links"}
    )


def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return audit(masks(documents, table(spark, sf_dir, "labels")))


def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(frequent_phrases(table(spark, sf_dir, "documents")))


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_ring_sharding": ring_sharding,
    "op2_source_mixing": source_mixing,
    "op3_pii_redaction": pii_redaction,
    "op4_exact_top_k": exact_top_k,
    "op5_minhash_near_dedup": minhash_near_dedup,
    "op6_quality_rules": quality_rules,
    "op7_url_filter": url_filter,
    "op8_sequence_packing": sequence_packing,
    "op9_suffix_dedup": suffix_dedup,
    "op10_substring_dedup": substring_dedup,
    "op11_filter_audit": filter_audit,
    "op12_phrase_mining": phrase_mining,
    "op13_lm_scoring": lm_scoring,
}
