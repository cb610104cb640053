"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts are lower-cased (A-Z only), cut into pieces at ``.,;:!?`` and line breaks (line feed
to return), and pieces into words at blanks and tabs. Every run of 1 to ``LONGEST`` words
inside a piece is an n-gram. Counting them goes in three steps, all on Spark; each drops
only n-grams that surely stay below ``LEAST_COUNT``:

1. **Words** are counted by their text: each chunk of about ``CHUNK`` words emits one row
   per distinct word (``mapInArrow``), and Spark sums them. An n-gram is found as often as its
   rarest part at most, so n-grams with a rarer word go no further.
2. **Fingerprints**, first of two words, then of three. On the executors (``mapInArrow``),
   each word gets a 64-bit hash, and numpy prefix polynomials give every n-gram its
   fingerprint at once: with prefix sums ``S[k] = sum over j < k of h[j] B^-j`` (mod 2^64),
   the n-gram at ``i`` is ``B^(i+n-1) (S[i+n] - S[i])``. Each chunk emits one row
   per distinct fingerprint, of two longs: fingerprint and count. Spark sums them. Different n-grams with one fingerprint are summed too, which only keeps more.
   Three words need both pairs in them to be frequent.
3. **Texts.** The n-grams whose fingerprints reached the count are counted again, by their
   text, and this count alone is the result: a collision of fingerprints changes nothing.

What is frequent reaches the tasks as a bitmap of ``BITMAP_BITS`` bits, whatever their
number: each fingerprint sets the bit that its leading bits name. Where many are set, more
n-grams go on to be counted, and none is lost.

Scores (named query): candidates are phrases of 2 to 3 words with ``a = f >= 10``; cutting
after k words gives ``l``, ``r`` and ``floor(1000000 a^2 / (l r))``, in decimal arithmetic of
38 digits (exact while ``a`` is below 10^16); the lowest cut counts, ties to the smallest
k. A candidate inside a longer candidate with ``100 f(longer) >= 50 a`` is dropped. Each
language keeps its first ``TOP`` by score, a (both descending) and phrase (bytes).

Defined cases: a NULL text is empty and NULL lang is ``und``; repeated rows count each
time; n-grams never cross pieces or documents; an empty table gives no rows; other columns
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsieve.llm.common import BITMAP_BITS, bitmap, in_bitmap, small_batches, stored
from rowsieve.llm.shingles import mixed

# Separators of pieces, and of words within pieces.
PIECE_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
WORD_BREAKS = b"\x20\x09"
UNKNOWN_LANG = "und"

LONGEST = 3
LEAST_COUNT = 10
TOP = 2000
CHUNK = 400_000
# Bytes of text for each word of a chunk.
BYTES_PER_WORD = 6
# Largest bitmap sent to the tasks; below it every n-gram is fingerprinted.
PRUNE_BYTES = 64 * 1024 * 1024
# Odd base of the polynomials.
BASE = 0x9E3779B97F4A7C15

# What a byte is: of a word, a word break, a piece break. All breaks are ASCII.
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[list(WORD_BREAKS)] = 1
KINDS[list(PIECE_BREAKS)] = 2


@dataclass(frozen=True)
class Tokens:
    """The words of several texts of one language, as codes into ``spelled``, and the
    number of the piece each stands in; pieces of different texts differ."""

    codes: np.ndarray
    pieces: np.ndarray
    spelled: pa.Array


def words_of(texts: bytes) -> Tokens:
    """Words of lower-cased texts with a piece break between each two."""
    data = np.frombuffer(texts, dtype=np.uint8)
    kinds = KINDS[data]
    inside = kinds == 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = pa.py_buffer(np.ascontiguousarray(data[inside]))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), letters])
    coded = words.dictionary_encode()
    # Piece breaks up to each word.
    breaks = np.searchsorted(np.flatnonzero(kinds == 2), starts)
    return Tokens(coded.indices.to_numpy(zero_copy_only=False), breaks, coded.dictionary)


def _salt(lang: str) -> np.uint64:
    return pd.util.hash_array(np.array([lang], dtype=object), categorize=False).astype(np.uint64)[0]


def word_hashes(tokens: Tokens, lang: str) -> np.ndarray:
    """A hash of each word and its language."""
    spelled = np.array(tokens.spelled.cast(pa.large_string()).to_pylist(), dtype=object)
    if not len(spelled):
        return np.empty(0, dtype=np.uint64)
    hashed = pd.util.hash_array(spelled, categorize=False).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mixed(hashed + _salt(lang))[tokens.codes]


def _powers(base: int, count: int) -> np.ndarray:
    out = np.empty(count, dtype=np.uint64)
    if count:
        out[0] = 1
        out[1:] = np.uint64(base)
        out = np.cumprod(out, dtype=np.uint64)
    return out


def fingerprints(hashes: np.ndarray, pieces: np.ndarray, n: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of all n-grams inside pieces, and their fingerprints."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    starts = np.flatnonzero(pieces[n - 1 :] == pieces[:size])
    with np.errstate(over="ignore"):
        up, down = _powers(BASE, len(hashes)), _powers(pow(BASE, -1, 1 << 64), len(hashes))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * down, dtype=np.uint64)])
        prints = mixed((prefix[starts + n] - prefix[starts]) * up[starts + n - 1])
    # The leading bits, which name a bit of the bitmap.
    return starts, prints if bits >= 64 else prints & ~np.uint64((1 << (64 - bits)) - 1)


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[str, bytes]]:
    """(lang, lower-cased texts) with about ``chunk`` words, cut only between pieces."""
    size = max(chunk * BYTES_PER_WORD, 1)
    for batch in batches:
        for lang in pc.unique(batch.column(0)).to_pylist():
            own = batch.column(1).filter(pc.equal(batch.column(0), lang)).drop_null()
            texts = "\n".join(own.to_pylist()).encode().lower()
            start = 0
            while start < len(texts):
                stop = len(texts)
                if stop - start > size:
                    ahead = KINDS[np.frombuffer(texts, np.uint8, offset=start + size)] == 2
                    at = int(ahead.argmax())
                    stop = start + size + at + 1 if ahead[at] else stop
                yield lang, texts[start:stop]
                start = stop


@dataclass(frozen=True)
class Frequent:
    """Bitmaps of what was found often enough: words, pairs, triples; None where unknown."""

    bits: int
    maps: dict[int, np.ndarray]

    def among(self, n: int, prints: np.ndarray) -> np.ndarray:
        known = self.maps.get(n)
        return np.ones(len(prints), dtype=bool) if known is None else in_bitmap(known, prints)

    def grams(self, hashes: np.ndarray, pieces: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Those n-grams of which all parts that were counted are frequent."""
        starts, prints = fingerprints(hashes, pieces, n, self.bits)
        if n > 1 and self.maps.get(n - 1) is not None:
            shorter = np.zeros(len(hashes) + 1, dtype=bool)
            if n == 2:
                shorter[:-1] = self.among(1, hashes)
            else:
                at, parts = self.grams(hashes, pieces, n - 1)
                shorter[at] = self.among(n - 1, parts)
            keep = shorter[starts] & shorter[starts + 1]
            starts, prints = starts[keep], prints[keep]
        return starts, prints


def _count(batches: Iterator[pa.RecordBatch], n: int, frequent: Frequent, chunk: int) -> Iterator[pa.RecordBatch]:
    """(fp, count) of the n-grams in each chunk."""
    for lang, texts in _chunks(batches, chunk):
        tokens = words_of(texts)
        _, prints = frequent.grams(word_hashes(tokens, lang), tokens.pieces, n)
        found, counts = np.unique(prints, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["fp", "count"])


def _recount(batches: Iterator[pa.RecordBatch], frequent: Frequent, chunk: int) -> Iterator[pa.RecordBatch]:
    """(lang, n, phrase, count) of the frequent n-grams in each chunk, by their words."""
    for lang, texts in _chunks(batches, chunk):
        tokens = words_of(texts)
        hashes = word_hashes(tokens, lang)
        for n in range(2, LONGEST + 1):
            starts, prints = frequent.grams(hashes, tokens.pieces, n)
            starts = starts[frequent.among(n, prints)]
            if not len(starts):
                continue
            # Equal n-grams have equal words: their codes are merged one word at a time.
            keys = tokens.codes[starts].astype(np.int64)
            for k in range(1, n):
                _, keys = np.unique(keys * len(tokens.spelled) + tokens.codes[starts + k], return_inverse=True)
            _, first, counts = np.unique(keys, return_index=True, return_counts=True)
            words = [tokens.spelled.take(pa.array(tokens.codes[starts[first] + k])) for k in range(n)]
            phrases = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(first), pa.string()),
                    pa.array(np.full(len(first), n, dtype=np.int32)),
                    phrases.cast(pa.large_string()).cast(pa.string()),
                    pa.array(counts.astype(np.int64)),
                ],
                names=["lang", "n", "phrase", "count"],
            )


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang in pc.unique(batch.column(0)).to_pylist():
            own = batch.column(1).filter(pc.equal(batch.column(0), lang)).cast(pa.large_binary())
            hashes = word_hashes(Tokens(np.arange(len(own)), np.zeros(len(own)), own), lang)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["fp"])


def frequent_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    bits: int = 64,
    chunk: int = CHUNK,
) -> DataFrame:
    """lang, n, phrase, f: every n-gram of 1 to ``LONGEST`` words found ``LEAST_COUNT``
    times or more in its language, and one row of n = 0 per language with its word count
    as f (phrase NULL). ``bits`` shortens the fingerprints, for tests of collisions."""
    small_batches(docs.sparkSession)
    source = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"),
        F.col(text).cast("string").alias("text"),
    )
    words = stored(_word_counts(source, chunk))
    totals = words.groupBy("lang").agg(F.sum("f").alias("f")).select(
        "lang", F.lit(0).alias("n"), F.lit(None).cast("string").alias("phrase"), "f"
    )
    often = F.col("f") >= LEAST_COUNT
    singles = words.filter(often).select("lang", F.lit(1).alias("n"), F.col("word").alias("phrase"), "f")
    prune = BITMAP_BITS // 8 <= PRUNE_BYTES
    maps = {}
    if prune:
        maps[1] = bitmap(singles.select("lang", "phrase").mapInArrow(_hash_words, "fp long"), "fp")
    for n in range(2, LONGEST + 1):
        if prune:
            known = Frequent(bits, dict(maps))
            grams = source.mapInArrow(lambda it, n=n, known=known: _count(it, n, known, chunk), "fp long, count long")
            counted = grams.groupBy("fp").agg(F.sum("count").alias("f"))
            maps[n] = bitmap(stored(counted.filter(often).select("fp")), "fp")
    known = Frequent(bits, maps)
    named = source.mapInArrow(
        lambda it: _recount(it, known, chunk), "lang string, n int, phrase string, count long"
    )
    found = named.groupBy("lang", "n", "phrase").agg(F.sum("count").alias("f")).filter(often)
    return stored(found).unionByName(singles).unionByName(totals)


def _word_counts(source: DataFrame, chunk: int) -> DataFrame:
    """lang, word, f: every word of every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _chunks(batches, chunk):
            tokens = words_of(texts)
            spelled = tokens.spelled.cast(pa.large_string()).cast(pa.string())
            found = np.bincount(tokens.codes, minlength=len(spelled))
            langs = pa.array([lang] * len(spelled), pa.string())
            yield pa.RecordBatch.from_arrays([langs, spelled, pa.array(found)], names=["lang", "word", "count"])

    found = source.mapInArrow(count, "lang string, word string, count long")
    return found.groupBy("lang", "word").agg(F.sum("count").alias("f"))


def collocations(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best candidates of each language."""
    lookup = phrases.filter("n > 0").select("lang", F.col("phrase").alias("_part"), F.col("f").alias("_f"))
    totals = phrases.filter("n = 0").select("lang", F.col("f").alias("total"))
    cands = phrases.filter((F.col("n") >= 2) & (F.col("n") <= LONGEST)).select(
        "lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("_w"), F.col("n").alias("_len")
    )
    cuts = cands.select(
        "*", F.explode(F.sequence(F.lit(1), F.col("_len") - 1)).alias("k")
    ).select(
        "*",
        F.array_join(F.slice("_w", 1, F.col("k")), " ").alias("_left"),
        F.array_join(F.slice("_w", F.col("k") + 1, F.col("_len")), " ").alias("_right"),
    )
    left = lookup.withColumnsRenamed({"_part": "_left", "_f": "l"})
    right = lookup.withColumnsRenamed({"_part": "_right", "_f": "r"})
    # Exact: 38 decimal digits hold 10^6 a^2 for every a below 10^16.
    score = F.expr(
        "(CAST(a AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) * 1000000BD)"
        " div (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))"
    )
    scored = (
        cuts.join(left, ["lang", "_left"])
        .join(right, ["lang", "_right"])
        .select("lang", "phrase", "a", "_len", "k", "l", "r", score.alias("score"))
    )
    best = scored.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("_b")
    )
    longer = (
        cands.filter(F.col("_len") == 3)
        .select("lang", "a", F.explode(F.array(
            F.array_join(F.slice("_w", 1, 2), " "), F.array_join(F.slice("_w", 2, 2), " ")
        )).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("_outer"))
    )
    kept = best.join(longer, ["lang", "phrase"], "left").filter(
        F.col("_outer").isNull() | (F.col("_outer") * 100 < F.col("a") * 50)
    )
    order = Window.partitionBy("lang").orderBy(F.col("_b.score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = kept.select("*", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang",
        F.col("rank").cast("long"),
        "phrase",
        F.col("a").cast("long"),
        F.col("_b.l").cast("long").alias("l"),
        F.col("_b.r").cast("long").alias("r"),
        F.col("total").cast("long").alias("n"),
        F.col("_b.score").cast("long").alias("score"),
    )
