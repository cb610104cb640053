"""Near-duplicate documents: consistent weighted sampling, banded, and verified.

A document is the weighted set of its five-word shingles. A shingle weighs by how often it
stands in the document (TF) and by how rare its words are (IDF): ``1 + DAMPING * r``, where r
is the mean over its words of ``log(N / df)``, cut off at ``log(COMMON)`` and scaled to 0..1.
Copies raise the document frequency of their own words; damping keeps a few edited words from
outweighing the text that two copies share.

``SAMPLES`` samples by improved consistent weighted sampling agree between two documents each
with a probability equal to their weighted Jaccard similarity. Three form a band; two
documents at the limit of 0.8 share at least one of ten bands in 999 of 1,000 cases, at 0.9
in all but one of a million. Pairs that collide are verified by their exact weighted Jaccard
similarity.

Document frequencies cover all documents and are exact: each task reports every word, merged
over up to ``HELD_WORDS`` different ones. What is broadcast are words in at least one of
``COMMON`` documents, so at most ``COMMON`` times the mean number of different words a
document has; all others weigh the most, whatever their number.

Defined cases: NULL and blank texts have no shingle and stay alone; texts of one to four
words are alike only if their words are equal; equal texts are always one class; repeated
rows each get a row; the class of a document is the smallest key in it, NULL keys last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.common import LEAST_SIMILARITY, WORDS_PER_SHINGLE, neutral, small_batches, stored
from rowsieve.llm.neighbours import classes, small
from rowsieve.llm.shingles import chunks, mixed, shingles_of, similarity, weighed, words_of

BANDS = 10
ROWS = 3
SAMPLES = BANDS * ROWS
DAMPING = 0.25
COMMON = 1024
HELD_WORDS = 1_000_000
_UNIT = np.float32(2.0**-24)


def word_frequencies(df: DataFrame, text: str) -> DataFrame:
    """(word, df): number of documents with the word, for every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in chunks(batches, 0):
            words = words_of(part.column(0))
            rows = np.repeat(np.arange(part.num_rows), np.diff(words.starts))
            order = np.lexsort((rows, words.numbers))
            own, rows = words.numbers[order], rows[order]
            new = np.ones(len(own), dtype=bool)
            new[1:] = (own[1:] != own[:-1]) | (rows[1:] != rows[:-1])
            own, n = np.unique(own[new], return_counts=True)
            together, where = np.unique(np.concatenate([numbers, own]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(together)).astype(np.int64)
            numbers = together
            if len(numbers) >= HELD_WORDS:
                yield reported(numbers, counts)
                numbers, counts = numbers[:0], counts[:0]
        yield reported(numbers, counts)

    def reported(numbers: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers.view(np.int64)), pa.array(counts)], names=["word", "df"]
        )

    counted = df.select(F.col(f"`{text}`").cast("string")).mapInArrow(count, "word long, df long")
    return counted.groupBy("word").agg(F.sum("df").alias("df"))


class Weights:
    """The weights of words: rarer ones weigh more, up to 1."""

    def __init__(self, words: np.ndarray, rarity: np.ndarray):
        self.words, self.rarity = words, rarity

    @classmethod
    def of(cls, df: DataFrame, text: str) -> Weights:
        total = df.count()
        common = word_frequencies(df, text).filter(F.col("df") * COMMON >= total).toPandas()
        words = common["word"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(words)
        shares = total / common["df"].to_numpy(np.float64)[order] if len(words) else np.zeros(0)
        rarity = np.clip(np.log(np.maximum(shares, 1)) / np.log(COMMON), 0, 1)
        return cls(words[order], rarity.astype(np.float32))

    def rare(self, numbers: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.ones(len(numbers), dtype=np.float32)
        at = np.minimum(np.searchsorted(self.words, numbers), len(self.words) - 1)
        return np.where(self.words[at] == numbers, self.rarity[at], np.float32(1))

    def sets(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's different shingles, in order, with their weights."""
        words = words_of(texts)
        numbers, first, begins = shingles_of(words)
        rarity = np.concatenate([[0], np.cumsum(self.rare(words.numbers), dtype=np.float64)])
        ends = np.repeat(words.starts[1:], np.diff(begins))
        last = np.minimum(first + WORDS_PER_SHINGLE, ends)
        mean = (rarity[last] - rarity[first]) / np.maximum(last - first, 1)
        # Rounded, as sums over different texts differ in their last bits.
        weights = np.round(1 + DAMPING * mean, 4).astype(np.float32)
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.float32))
        return [
            weighed(numbers[start:end], weights[start:end]) if end > start else empty
            for start, end in zip(begins, begins[1:], strict=False)
        ]


def samples(numbers: np.ndarray, weights: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """``SAMPLES`` consistent weighted samples of every text, as bits of the least value.

    No text may be empty. Each shingle draws r and c, gamma distributed, and b, uniform. Its
    weight is rounded down to a power y of exp(r), and the shingle of least c / (y exp(r))
    is the sample. That value is as good as the shingle and y themselves to compare.
    """
    out = np.empty((SAMPLES, len(begins) - 1), dtype=np.uint32)
    log_weight = np.log(weights)
    low = np.uint64(0xFFFFFF)
    for k in range(SAMPLES):
        bits = mixed(numbers + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        more = mixed(bits + np.uint64(0x632BE59BD9B4E019))
        uniform = [
            (((word >> np.uint64(shift)) & low).astype(np.float32) + np.float32(0.5)) * _UNIT
            for word, shift in ((bits, 0), (bits, 24), (more, 0), (more, 24))
        ]
        b = (more >> np.uint64(48)).astype(np.float32) * np.float32(2.0**-16)
        r = -np.log(uniform[0] * uniform[1])
        log_c = np.log(-np.log(uniform[2] * uniform[3]))
        value = log_c - r * (np.floor(log_weight / r + b) - b + np.float32(1))
        out[k] = np.minimum.reduceat(value.astype(np.float32), begins[:-1]).view(np.uint32)
    return out


def band_keys(sampled: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One number per text and band."""
    keys = np.empty((sampled.shape[1], bands), dtype=np.int64)
    for band in range(bands):
        key = np.full(sampled.shape[1], band + 1, dtype=np.uint64)
        for row in range(rows):
            key = mixed(key + sampled[band * rows + row].astype(np.uint64))
        keys[:, band] = key.view(np.int64)
    return keys


def text_digest(texts: list) -> list[bytes]:
    return [hashlib.md5((text or "").encode(), usedforsecurity=False).digest() for text in texts]


def signatures(df: DataFrame, key: str, text: str, weights: Weights) -> DataFrame:
    """key, digest of the text, and its buckets (none for texts without words)."""
    shared = df.sparkSession.sparkContext.broadcast((weights.words, weights.rarity))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights(*shared.value)
        for part in chunks(batches, 1):
            sets = own.sets(part.column(1))
            full = [at for at, (numbers, _) in enumerate(sets) if len(numbers)]
            buckets: list = [[] for _ in sets]
            if full:
                begins = np.concatenate([[0], np.cumsum([len(sets[at][0]) for at in full])])
                keys = band_keys(
                    samples(
                        np.concatenate([sets[at][0] for at in full]),
                        np.concatenate([sets[at][1] for at in full]),
                        begins,
                    )
                )
                for at, row in zip(full, keys.tolist(), strict=True):
                    buckets[at] = row
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(text_digest(part.column(1).to_pylist()), pa.binary()),
                    pa.array(buckets, pa.list_(pa.int64())),
                ],
                names=["key", "digest", "buckets"],
            )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    return rows.mapInArrow(sign, f"key {kind}, digest binary, buckets array<long>")


def near_duplicates(
    df: DataFrame, key: str, text: str = "text", least: float = LEAST_SIMILARITY
) -> DataFrame:
    """One row per document: key, ``class`` (smallest key of its class), ``size`` of the class,
    ``links`` (similar pairs found that its text is part of), ``digest`` of its text, and
    ``component``, which tells classes apart that have the same smallest key."""
    spark = df.sparkSession
    small_batches(spark)
    weights = Weights.of(df, text)
    signed = stored(signatures(df, key, text, weights))

    def texts_of(wanted: DataFrame) -> DataFrame:
        rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("text"))
        # Keys may be NULL for many texts, and digests stand for many copies; both are few rows.
        rows = rows.withColumn("_digest", F.unhex(F.md5("text")))
        same = F.col("_key").eqNullSafe(F.col("first")) & (F.col("_digest") == F.col("digest"))
        return rows.join(wanted, same).drop("_key", "_digest")

    table = spark.sparkContext.broadcast((weights.words, weights.rarity))

    def shingled(parts: pa.Array) -> list:
        return Weights(*table.value).sets(parts)

    found = classes(signed, texts_of, shingled, similarity, least)
    return signed.select("key", "digest").join(found, "digest").select(
        F.col("key").alias(key),
        F.when(F.col("blank"), F.col("key")).otherwise(F.col("class")).alias("class"),
        F.when(F.col("blank"), F.lit(1)).otherwise(F.col("size")).cast("long").alias("size"),
        "links",
        "digest",
        "component",
    )


def one_of_each(
    df: DataFrame, key: str, text: str = "text", least: float = LEAST_SIMILARITY
) -> DataFrame:
    """One document of each class, with its own columns: that of the smallest key, NULL last.
    Blank texts stay. Input columns may have any names."""
    df, (key, text), back = neutral(df, key, text)
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    digest = F.unhex(F.md5(whole))
    found = near_duplicates(df, key, text, least)
    # Few rows of a class are left, most often one: equal texts under the smallest key.
    chosen = found.filter(F.col(key).eqNullSafe(F.col("class"))).select(
        F.col(key).alias("_key"), F.col("digest").alias("_digest"), "component", "size"
    )
    alone = chosen.filter("size = 1").select("_key", "_digest").distinct()
    several = chosen.filter("size > 1").groupBy("component").agg(
        F.min(F.struct("_key", "_digest")).alias("_row")
    )
    chosen = stored(alone.unionByName(several.select("_row.*")).withColumn("_alone", F.lit(True)))
    same = df[key].eqNullSafe(F.col("_key")) & (digest == F.col("_digest"))
    kept = df.join(small(chosen), same, "inner").drop("_key", "_alone")
    # Rows may repeat altogether; then one of them stays, unless they are blank.
    blank = F.trim(F.translate(whole, "\t\n\x0b\f\r", "     ")) == ""
    once = kept.filter(~blank).dropDuplicates(["_digest"])
    return once.unionByName(kept.filter(blank)).select(*[f"`{name}`" for name in df.columns]).select(*back)
