"""Repeated byte strings: a depth-limited radix sort of all suffixes, most significant first.

Every suffix is sorted through its first ``length`` bytes only; where groups of equal
prefixes are left, these are exactly the repeated windows. Digits are long, so that few
passes are needed, and equal digits are told by 64-bit hashes of their bytes:

1. The first digit is a suffix's first anchor, the least hash of ``ANCHOR`` bytes among the
   next ``SPAN`` places, together with all bytes that are sure to follow it in the window.
   Equal windows have equal anchors at equal distances. Neighbouring suffixes with the same
   anchor are a run, and a run has one digit and one row. Runs whose digit occurs nowhere
   else are done: none of their windows is repeated.
2. The second digit is a whole run: its distance to the anchor and all bytes of its windows.
   Runs that are equal in it are repeated in all their windows. Runs whose first digit has
   no other second digit are done as well.
3. What is left are runs that share an anchor but differ further out, mostly at the ends of
   repeated stretches. Only these are sorted suffix by suffix, by their whole window; of
   runs that are equal one takes part.

In each pass a batch of documents first merges what is equal in it and says so, so that no
digit, however common, has more rows than there are batches. Passes carry hashes and places;
texts are read again for the third pass and for the result, and only of documents that need
it. Equal texts have equal results and one number, a hash of the text.

Defined cases: NULL texts are empty; texts shorter than ``length`` keep all bytes; equal
texts of at least that length lose all; matches may overlap each other and themselves, but
never cross documents; repeated rows count as documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.common import small_batches, stored
from rowsieve.llm.neighbours import small
from rowsieve.llm.shingles import mixed

LENGTH = 400
ANCHOR = 16
SPAN = 100
CHUNK_BYTES = 1 << 20
_PLACE = np.int64(512)  # places are packed as first * 512 + number of suffixes
_POSITION = np.uint64((1 << 32) - 1)  # texts are shorter than that
_BASE = np.uint64(0x9E3779B97F4A7C15)
SETTLED, OPEN, WITNESS = 1, 2, 4


@lru_cache(maxsize=1)
def _bytes() -> np.ndarray:
    """A random number for every byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    ups, downs = np.full(n, _BASE), np.full(n, inverse)
    ups[0] = downs[0] = 1
    return np.cumprod(ups, dtype=np.uint64), np.cumprod(downs, dtype=np.uint64)


class Hashes:
    """Hashes of all substrings of some bytes, by prefix sums."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(int(len(data)).bit_length(), 20)
        ups, self.downs = _powers(size)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_bytes()[data] * ups[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.downs[start])


def first_least(values: np.ndarray, span: int) -> np.ndarray:
    """For each place, the least of the next ``span`` values (fewer places than values)."""
    rows = -(-len(values) // span)
    padded = np.full(rows * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(table, axis=1).ravel()
    n = len(values) - span + 1
    return np.minimum(ahead[:n], behind[span - 1 : span - 1 + n])


def runs_of(
    data: np.ndarray, begins: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, first place in it, number of suffixes, first and second digit of every run.

    ``data`` holds texts one after the other, from begins[i] to begins[i + 1].
    """
    hashes, n = Hashes(data), len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    places = np.arange(n - ANCHOR + 1)
    grams = hashes.of(places, places + ANCHOR)
    # Among equal hashes the first place is the least.
    grams = (grams & ~_POSITION) | places.astype(np.uint64)
    starts = np.arange(n - length + 1)
    anchors = (first_least(grams, SPAN)[: len(starts)] & _POSITION).astype(np.int64)
    text = np.searchsorted(begins, starts, side="right") - 1
    inside = starts + length <= begins[text + 1]
    starts, anchors, text = starts[inside], anchors[inside], text[inside]
    if not len(starts):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    first, anchor, text = starts[at], anchors[at], text[at]
    digit = hashes.of(anchor, anchor + length - SPAN + 1)
    shape = ((anchor - first) * 1024 + count).astype(np.uint64)
    whole = mixed(hashes.of(first, first + count - 1 + length) + mixed(shape))
    return text, first - begins[text], count, digit, whole


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in pieces of about ``CHUNK_BYTES``: number of the first, bytes, and begins."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    cuts = np.flatnonzero(np.diff((offsets[:-1] - offsets[0]) // CHUNK_BYTES)) + 1
    cuts = [0, *cuts.tolist(), len(column)]
    for start, end in zip(cuts, cuts[1:], strict=False):
        if end > start:
            yield start, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]


def _same(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal rows together, and where each group begins in it."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for column in columns:
        own = column[order]
        new[1:] |= own[1:] != own[:-1]
    return order, np.flatnonzero(new)


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"kind": np.int32}
    return pa.RecordBatch.from_pydict(
        {name: pa.array(np.asarray(x).astype(kinds.get(name, np.int64), copy=False)) for name, x in columns.items()}
    )


# kinds of rows between the passes
CLASS, MANY, MIXED, INFORM, DONE = 1, 2, 4, 8, 16
_ROWS = "deal long, digit long, text long, place long, kind int"


def _settled(text: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    order, at = _same(text, place)
    text, place = text[order[at]], place[order[at]]
    deal = mixed(text.view(np.uint64) + place.view(np.uint64)).view(np.int64)
    return _table(
        deal=deal, digit=np.zeros_like(text), text=text, place=place, kind=np.full(len(text), DONE)
    )


def first_pass(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch of (text number, text), merged where they are equal."""
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        parts = []
        for start, data, begins in _texts(batch.column(1)):
            text, first, count, digit, whole = runs_of(data, begins, length)
            parts.append((numbers[start + text], first * _PLACE + count, digit, whole))
        text, place, digit, whole = (np.concatenate(column) for column in zip(*parts, strict=True))
        if not len(text):
            continue
        digit, whole = digit.view(np.int64), whole.view(np.int64)
        order, at = _same(digit, whole)
        text, place, digit, whole = text[order], place[order], digit[order], whole[order]
        count = np.diff(np.append(at, len(text)))
        # One row for each different run; all runs that occur twice are settled here.
        several = np.repeat(count, count) > 1
        yield _settled(text[several], place[several])
        starts = np.flatnonzero(np.append(True, digit[at][1:] != digit[at][:-1]))
        kinds = np.diff(np.append(starts, len(at)))
        mixed_ = np.repeat(kinds, kinds) > 1
        kind = CLASS + MANY * (count > 1) + MIXED * mixed_
        deal = np.where(mixed_, whole[at], digit[at])
        yield _table(deal=deal, digit=whole[at], text=text[at], place=place[at], kind=kind)
        known = at[starts[kinds > 1]]
        yield _table(
            deal=digit[known],
            digit=whole[known],
            text=text[known],
            place=place[known],
            kind=np.full(len(known), INFORM),
        )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of whole groups: rows of one deal are never torn between two results."""
    left = None
    for batch in batches:
        own = [column.to_numpy() for column in batch.columns]
        if left is not None:
            own = [np.concatenate(pair) for pair in zip(left, own, strict=True)]
        if not len(own[0]):
            continue
        cut = np.searchsorted(own[0], own[0][-1], side="left")
        left = [column[cut:] for column in own]
        if cut:
            yield tuple(column[:cut] for column in own)
    if left is not None and len(left[0]):
        yield tuple(left)


def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by deal: which runs are settled, open, or witnesses for others."""
    for deal, digit, text, place, kind in _groups(batches):
        done = (kind & DONE) > 0
        yield _table(text=text[done], place=place[done], kind=np.full(int(done.sum()), SETTLED))
        deal, digit, text, place, kind = (x[~done] for x in (deal, digit, text, place, kind))
        if not len(deal):
            continue
        order, at = _same(deal, digit)
        deal, digit, text, place, kind = (x[order] for x in (deal, digit, text, place, kind))
        real = (kind & CLASS) > 0
        rows = np.add.reduceat(real.astype(np.int64), at)
        flags = np.bitwise_or.reduceat(kind, at)
        starts = np.flatnonzero(np.append(True, deal[at][1:] != deal[at][:-1]))
        digits = np.diff(np.append(starts, len(at)))
        told = np.bitwise_or.reduceat(flags, starts) & (MIXED | INFORM)
        several = np.repeat((told > 0) | (digits > 1), digits)
        repeated = (rows > 1) | ((flags & MANY) > 0)
        size = np.diff(np.append(at, len(deal)))
        settled = np.repeat(repeated, size) & real
        yield _table(text=text[settled], place=place[settled], kind=np.full(int(settled.sum()), SETTLED))
        # One real row of each class takes part in the third pass.
        begin = np.repeat(at, size)
        rank = np.cumsum(real) - np.cumsum(real)[begin] + real[begin]
        chosen = real & (rank == 1) & np.repeat(several, size)
        kinds = np.where(np.repeat(repeated, size), WITNESS, OPEN)
        yield _table(text=text[chosen], place=place[chosen], kind=kinds[chosen])


def third_pass(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every suffix of the chosen runs of (text number, text, places), by its whole window."""
    for batch in batches:
        numbers, lists = batch.column(0).to_numpy(), batch.column(2).combine_chunks() if isinstance(
            batch.column(2), pa.ChunkedArray
        ) else batch.column(2)
        flat = lists.flatten().to_numpy()
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        parts = []
        for start, data, begins in _texts(batch.column(1)):
            hashes = Hashes(data)
            n = len(begins) - 1
            chosen = flat[bounds[start] : bounds[start + n]]
            owner = np.repeat(np.arange(n), np.diff(bounds[start : start + n + 1]))
            first, count = chosen // _PLACE, chosen % _PLACE
            before = np.concatenate([[0], np.cumsum(count)])
            place = np.arange(before[-1]) - np.repeat(before[:-1] - first, count)
            owner = np.repeat(owner, count)
            at = place + begins[owner]
            parts.append((numbers[start + owner], place * _PLACE + 1, hashes.of(at, at + length)))
        text, place, window = (np.concatenate(column) for column in zip(*parts, strict=True))
        if not len(text):
            continue
        window = window.view(np.int64)
        order, at = _same(window)
        text, place, window = text[order], place[order], window[order]
        count = np.diff(np.append(at, len(text)))
        several = np.repeat(count, count) > 1
        yield _settled(text[several], place[several])
        kind = CLASS + MANY * (count > 1)
        yield _table(deal=window[at], digit=window[at], text=text[at], place=place[at], kind=kind)


def _dealt(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "deal").sortWithinPartitions("deal", "digit")


def cut_out(data: bytes, places: np.ndarray, length: int) -> tuple[int, int, bytes]:
    """Removed bytes, removed stretches and what is left, given packed places of windows."""
    order = np.sort(places)
    start = order // _PLACE
    end = np.maximum.accumulate(start + order % _PLACE - 1 + length)
    new = np.append(True, start[1:] > end[:-1])
    at = np.flatnonzero(new)
    start, end = start[at], end[np.append(at[1:], len(end)) - 1]
    kept = [data[a:b] for a, b in zip(np.append(0, end), np.append(start, len(data)), strict=True)]
    return int((end - start).sum()), len(at), b"".join(kept)


def without_repeats(
    df: DataFrame, key: str, text: str = "text", length: int = LENGTH, texts: bool = True
) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256, and, with
    ``texts``, the remaining bytes as ``kept``."""
    small_batches(df.sparkSession)
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(
        F.col(f"`{key}`").alias("key"), F.xxhash64(whole).alias("number"), whole.alias("text")
    )
    long_rows = rows.filter(F.octet_length("text") >= length).select("number", "text")
    runs = long_rows.mapInArrow(lambda parts: first_pass(parts, length), _ROWS)
    found = _dealt(runs).mapInArrow(second_pass, "text long, place long, kind int")
    found = stored(found.groupBy("text", "place").agg(F.bit_or("kind").alias("kind")))

    # Texts with open runs and their witnesses are read again.
    wide = F.array_sort(F.collect_list("place"))
    chosen = found.filter(F.col("kind") >= OPEN).groupBy("text").agg(wide.alias("places"))
    chosen = stored(chosen.withColumnRenamed("text", "number"))
    wanted = small(chosen.select("number"))
    again = long_rows.join(wanted, "number", "left_semi").join(chosen, "number")
    windows = again.select("number", "text", "places").mapInArrow(
        lambda parts: third_pass(parts, length), _ROWS
    )
    later = _dealt(windows).mapInArrow(second_pass, "text long, place long, kind int")
    settled = found.filter(F.col("kind").bitwiseAND(SETTLED) > 0).select("text", "place")
    settled = settled.union(later.filter(F.col("kind") == SETTLED).select("text", "place"))
    gone = settled.groupBy("text").agg(F.collect_set("place").alias("places"))
    gone = stored(gone.withColumnRenamed("text", "number"))

    # A text that two documents have is repeated throughout.
    touched = small(gone.select("number"))
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).cast(pa.binary()).to_pylist()
            places = batch.column(2)
            done = [cut_out(one, places[at].values.to_numpy(), length) for at, one in enumerate(data)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(one) for one in data], pa.int64()),
                    pa.array([one[0] for one in done], pa.int64()),
                    pa.array([one[1] for one in done], pa.int64()),
                    pa.array([hashlib.sha256(one[2]).hexdigest() for one in done]),
                    pa.array([one[2] if texts else None for one in done], pa.binary()),
                ],
                names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    changed = rows.join(touched, "number", "left_semi").join(gone, "number")
    changed = changed.select("key", "text", "places").mapInArrow(cut, schema)
    none = F.lit(0).cast("long")
    same = rows.join(touched, "number", "left_anti").select(
        "key",
        F.octet_length("text").cast("long").alias("n_bytes"),
        none.alias("n_removed"),
        none.alias("n_spans"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"),
        F.encode("text", "UTF-8").alias("kept"),
    )
    done = changed.unionByName(same).withColumnRenamed("key", key)
    return done if texts else done.drop("kept")
