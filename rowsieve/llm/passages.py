"""Repeated passages: paragraphs by MinHash banding, exact verification, components; and what
they share inside, by units of words.

Paragraphs are the lines of a text that have a five-word shingle. Each is the set of its
five-word shingles. Bands and rows are tuned so that two paragraphs at the limit of similarity
collide with the wanted recall; colliding ones are compared by exact Jaccard similarity, and
linked ones form classes. Of every class the first paragraph, by key and place, stays, and all
others are removed.

Passages that are wrapped otherwise, or stand inside longer lines, share units: ``UNIT_WORDS``
words in a row, whatever lines they stand in, that begin at the least shingle of any
``WINDOW`` in a row. So any ``UNIT_WORDS + WINDOW - 1`` words in a row that stand in two
places share a unit there. Equal units are a class; the first one stays, those outside
removed lines before all others. Units wholly inside removed lines are left out.

Defined cases: NULL texts have no paragraphs; equal paragraphs are always one class, also
within a document; repeated rows repeat their paragraphs and so lose them all but once; NULL
keys come last. A word that a unit would remove stays where one that stays has it too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.common import (
    BITMAP_BITS,
    LEAST_SIMILARITY,
    WORD,
    WORDS_PER_SHINGLE,
    bitmap,
    in_bitmap,
    passing,
    small_batches,
    stored,
)
from rowsieve.llm.minhash import band_keys, text_digest
from rowsieve.llm.neighbours import classes, small
from rowsieve.llm.shingles import Words, chunks, mixed, shingles_of, similarity, words_of

LEAST_WORDS = WORDS_PER_SHINGLE
UNIT_WORDS = 20
WINDOW = 5
RECALL = 0.999
ROWS = 3


def tuned_bands(least: float, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands by which a pair of similarity ``least`` collides with that recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - least**rows))


def text_hash(text: str) -> Column:
    return F.xxhash64(F.col(f"`{text}`").cast("string"))


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, hash of the whole text, place and text of all lines."""
    lines = F.split(F.col(f"`{text}`").cast("string"), "\n")
    rows = df.select(
        F.col(f"`{key}`").alias("doc"),
        text_hash(text).alias("whole"),
        F.posexplode(lines).alias("place", "text"),
    )
    # Cheap first: so many words need so many characters.
    return rows.filter(F.length("text") >= 2 * LEAST_WORDS - 1)


def signatures(rows: DataFrame, bands: int, rows_per_band: int = ROWS) -> DataFrame:
    """doc, whole, place, digest and buckets of all paragraphs that are long enough."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 3):
            words = words_of(batch.column(3))
            enough = np.flatnonzero(np.diff(words.starts) >= LEAST_WORDS)
            if not len(enough):
                continue
            numbers, _, begins = shingles_of(words)
            hashed = np.empty((bands * rows_per_band, batch.num_rows), dtype=np.uint32)
            # Texts without a shingle are not among those taken; the last may lack a place.
            at = np.minimum(begins[:-1], max(len(numbers) - 1, 0))
            for k in range(len(hashed)):
                bits = mixed(numbers + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
                hashed[k] = np.minimum.reduceat((bits >> np.uint64(32)).astype(np.uint32), at)
            keys = band_keys(hashed[:, enough], bands, rows_per_band)
            part = batch.take(pa.array(enough))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    part.column(2),
                    pa.array(text_digest(part.column(3).to_pylist()), pa.binary()),
                    pa.array(keys.tolist(), pa.list_(pa.int64())),
                ],
                names=["doc", "whole", "place", "digest", "buckets"],
            )

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.select("doc", "whole", "place", "text").mapInArrow(
        sign, f"doc {kind}, whole long, place int, digest binary, buckets array<long>"
    )


def shingle_sets(parts: pa.Array) -> list:
    numbers, _, begins = shingles_of(words_of(parts))
    sets = [np.unique(numbers[a:b]) for a, b in zip(begins, begins[1:], strict=False)]
    return [(own, np.ones(len(own), dtype=np.float32)) for own in sets]


def _over(best: np.ufunc, numbers: np.ndarray) -> np.ndarray:
    """The least or highest of any ``WINDOW`` numbers in a row."""
    size = len(numbers) - WINDOW + 1
    out = numbers[:size]
    for step in range(1, WINDOW):
        out = best(out, numbers[step : size + step])
    return out


def unit_places(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the first words of all units, and two hashes of each one's words."""
    numbers, first, begins = shingles_of(words)
    if len(numbers) <= UNIT_WORDS - WORDS_PER_SHINGLE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    own = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    least = np.where(own[: 1 - WINDOW] == own[WINDOW - 1 :], _over(np.minimum, numbers), np.uint64(0))
    edge = np.zeros(WINDOW - 1, np.uint64)
    highest = _over(np.maximum, np.concatenate([edge, least, edge]))
    whole = first + UNIT_WORDS <= words.starts[1:][own]
    at = np.flatnonzero((numbers == highest) & whole)
    hashes = []
    for seed in (0x9E3779B97F4A7C15, 0x632BE59BD9B4E019):
        own_hash = np.full(len(at), seed, np.uint64)
        for step in range(0, UNIT_WORDS, WORDS_PER_SHINGLE):
            own_hash = mixed(own_hash * np.uint64(seed) + numbers[at + step])
        hashes.append(own_hash)
    return first[at], *hashes


def units(df: DataFrame, key: str, text: str, wanted: np.ndarray | None = None) -> DataFrame:
    """doc, whole, first and last line, first word, and two hashes of all units, or of those
    whose first hash has its bit in the bitmap ``wanted``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 2):
            lines = pc.split_pattern(pc.fill_null(batch.column(2), ""), "\n")
            offsets = lines.offsets.to_numpy() - lines.offsets[0].as_py()
            words = words_of(lines.flatten())
            starts = words.starts[offsets]
            at, a, b = unit_places(Words(words.numbers, starts))
            if wanted is not None:
                kept = in_bitmap(wanted, a)
                at, a, b = at[kept], a[kept], b[kept]
            row = np.searchsorted(starts, at, side="right") - 1
            ends = (at, at + UNIT_WORDS - 1)
            line = [np.searchsorted(words.starts, end, side="right") - 1 - offsets[row] for end in ends]
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    *[pa.array(place.astype(np.int32)) for place in line],
                    pa.array((at - starts[row]).astype(np.int64)),
                    pa.array(a.view(np.int64)),
                    pa.array(b.view(np.int64)),
                ],
                names=["doc", "whole", "place", "last", "first_word", "a", "b"],
            )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`"), text_hash(text), F.col(f"`{text}`").cast("string"))
    return rows.mapInArrow(
        cut, f"doc {kind}, whole long, place int, last int, first_word long, a long, b long"
    )


def unit_counts(df: DataFrame, text: str) -> DataFrame:
    """(a, n): how often units with this first hash stand in the texts, a row for each batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 0):
            _, a, _ = unit_places(words_of(batch.column(0)))
            hashed, n = np.unique(a.view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashed), pa.array(n)], names=["a", "n"])

    return df.select(F.col(f"`{text}`").cast("string")).mapInArrow(count, "a long, n long")


def removed_lines(gone: DataFrame) -> DataFrame:
    """doc, whole and ``bits``: 64 lines a long, where the bit of each removed one is set."""
    bit = F.expr("shiftleft(1L, int(place % 64))")
    longs = gone.groupBy("doc", "whole", (F.col("place") / 64).cast("int").alias("at")).agg(
        F.bit_or(bit).alias("bits")
    )
    found = longs.groupBy("doc", "whole").agg(
        F.max("at").alias("last"), F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("by")
    )
    dense = F.transform(
        F.sequence(F.lit(0), "last"), lambda at: F.coalesce(F.element_at("by", at), F.lit(0).cast("long"))
    )
    return found.select("doc", "whole", dense.alias("bits"))


def repeated_units(df: DataFrame, key: str, text: str, gone: DataFrame) -> DataFrame:
    """The units that stand in several places, and their classes; ``gone`` has the doc, whole
    and place of lines that are removed."""
    # Most units stand in one place: only hashes are counted, and the texts are cut again for
    # the others, of which a bitmap keeps most from being shuffled. What has one hash in common
    # but not both, or only its bit, is told apart below.
    several = unit_counts(df, text).groupBy("a").agg(F.sum("n").alias("n")).filter("n > 1")
    several = stored(several.select("a"))
    found = units(df, key, text, bitmap(several, "a"))
    if several.count() > BITMAP_BITS // 8:
        # Too many bits are set to tell much.
        # A join by name puts that column first.
        found = found.join(several, "a", "left_semi").select(*found.columns)
    bits = removed_lines(gone).select(F.struct("doc", "whole").alias("id"), "bits")
    met = found.select(F.struct("doc", "whole").alias("id"), *found.columns[2:]).join(bits, "id", "left")
    # One exchange: the units of a text are with the text's removed lines.
    removed = F.filter(
        F.sequence("place", "last"),
        lambda line: F.getbit(F.get("bits", (line / 64).cast("int")), F.pmod(line, F.lit(64))) == 1,
    )
    removed = F.coalesce(F.when(F.col("bits").isNotNull(), F.size(removed)), F.lit(0))
    own = F.struct(F.col("id.doc").isNull().alias("none"), F.col("id.doc").alias("doc"), "place", "first_word")
    marked = (
        met.select("id", *found.columns[2:], removed.alias("removed"))
        .filter(F.col("removed") <= F.col("last") - F.col("place"))
        .groupBy("id", "place", "first_word", "a", "b", "removed")
        # Repeated rows have their units in common.
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("a", "b", (F.col("removed") > 0).alias("torn"), own.alias("key"), "copies", "id.whole")
    )
    marked = stored(marked)
    tops = marked.groupBy("a", "b").agg(
        F.min(F.struct("torn", "key")).alias("top"), F.sum("copies").alias("size")
    )
    tops = stored(tops.filter("size > 1").select("a", "b", F.col("top.key").alias("class"), "size"))
    return marked.join(small(tops), ["a", "b"]).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    )


def _similar_lines(lines: DataFrame, least: float) -> DataFrame:
    """The lines that are like another, and their classes."""
    signed = signatures(lines, tuned_bands(least))
    # NULL keys last, as structs sort NULLs first.
    own = F.struct(F.col("doc").isNull().alias("none"), "doc", "place")
    signed = stored(signed.select(own.alias("key"), "whole", "digest", "buckets"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        own = F.struct(F.col("doc").isNull().alias("none"), "doc", "place")
        return lines.select(own.alias("first"), "text").join(wanted, "first")

    found = classes(signed, texts_of, shingle_sets, similarity, least).filter("size > 1")
    return signed.select("key", "whole", "digest").join(found, "digest").select(
        F.col("key.doc").alias("doc"),
        F.col("key.place").alias("place"),
        F.col("class.doc").alias("class_key"),
        F.col("class.place").alias("class_place"),
        "size",
        "links",
        (F.col("key") != F.col("class")).alias("removed"),
        F.lit(None).cast("long").alias("first_word"),
        F.lit(None).cast("int").alias("words"),
        "whole",
    )


def _passages(df: DataFrame, key: str, text: str, least: float) -> DataFrame:
    small_batches(df.sparkSession)
    lines = paragraphs(df, key, text)
    with passing(df.sparkSession) as keep:
        whole_lines = keep(_similar_lines(lines, least))
    inside = repeated_units(df, key, text, whole_lines.filter("removed"))
    return whole_lines.unionByName(
        inside.select(
            F.col("key.doc").alias("doc"),
            F.col("key.place").alias("place"),
            F.col("class.doc").alias("class_key"),
            F.col("class.place").alias("class_place"),
            "size",
            F.lit(0).cast("long").alias("links"),
            (F.col("key") != F.col("class")).alias("removed"),
            F.col("key.first_word").alias("first_word"),
            F.lit(UNIT_WORDS).alias("words"),
            "whole",
        )
    )


def repeated_passages(
    df: DataFrame, key: str, text: str = "text", least: float = LEAST_SIMILARITY
) -> DataFrame:
    """One row for every paragraph or unit that is like another: key, ``place`` (line, from 0),
    ``class_key`` and ``class_place`` of the one that stays, ``size`` of the class, ``links``,
    ``removed``, and of units ``first_word`` (in the text, from 0) and ``words``."""
    return _passages(df, key, text, least).drop("whole").withColumnRenamed("doc", key)


def without_repeats(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents without removed lines and units; what is left keeps its order."""
    found = _passages(df, key, text, LEAST_SIMILARITY)
    line = F.col("first_word").isNull()
    gone = found.groupBy(F.col("doc").alias("_key"), F.col("whole").alias("_whole")).agg(
        F.collect_set(F.when(line & F.col("removed"), F.col("place"))).alias("_lines"),
        F.collect_set(F.when(F.col("removed"), F.col("first_word"))).alias("_units"),
        F.collect_set(F.when(~F.col("removed"), F.col("first_word"))).alias("_stay"),
    )

    names, at = list(df.columns), df.columns.index(text)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = []
            for own, *parts in zip(*[c.to_pylist() for c in (batch.column(at), *batch.columns[-3:])], strict=True):
                cut.append(own if own is None else cut_text(own, *[part or [] for part in parts]))
            arrays = batch.columns[:-3]
            arrays[at] = pa.array(cut, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    same = df[key].eqNullSafe(F.col("_key")) & (text_hash(text) == F.col("_whole"))
    joined = df.join(gone, same, "left").withColumn(text, F.col(f"`{text}`").cast("string"))
    columns = [*[f"`{name}`" for name in names], "_lines", "_units", "_stay"]
    schema = df.withColumn(text, F.col(f"`{text}`").cast("string")).schema
    return joined.select(*columns).mapInArrow(left, schema)


def cut_text(text: str, lines: list[int], firsts: list[int], stay: list[int]) -> str:
    """The text without these lines, and without the words of units that no unit to stay has."""
    out = {at for first in firsts for at in range(first, first + UNIT_WORDS)}
    out -= {at for first in stay for at in range(first, first + UNIT_WORDS)}
    gone, kept, before = set(lines), [], 0
    for place, line in enumerate(text.split("\n")):
        spans = [found.span() for found in re.finditer(WORD, line)]
        cut = [span for at, span in enumerate(spans, before) if at in out]
        before += len(spans)
        if place in gone or (spans and len(cut) == len(spans)):
            continue
        for start, end in reversed(cut):
            line = line[:start] + line[end:].lstrip(" ")
        kept.append(line)
    return "\n".join(kept)
