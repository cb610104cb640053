"""Sum-of-squares packing of tokenised documents into sequences of fixed length.

``tokenised`` cuts documents into pieces of at most ``LENGTH`` tokens. A whole piece of that
length is a sequence by itself; all others are placed one by one, longest first, into the
open sequence with room by which the sum over residual gaps of the squared number of open
sequences with that gap becomes smallest, and into a new one where none has room. That keeps
gaps of many kinds at hand, and so nearly every sequence is filled to its end.

Pieces are dealt evenly into groups of about ``GROUP`` by a number of their own, so that no
source, size or repeated document makes a group larger; each group is packed by one task
with a table of ``LENGTH`` counts. A group leaves a few sequences unfilled, one in thousands.

Tokenisers are told apart by their file alone. Words (between white space) are tokenised once
per Python worker, which Spark reuses for many tasks, and remembered, up to ``REMEMBERED`` of them; this needs a tokeniser that never joins
characters across white space and drops it, which is checked by ``splits_at_blanks``.

Defined cases: a NULL text is empty and gives one piece of its end token; repeated rows are
packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.common import small_batches, stored
from rowsieve.llm.shingles import chunks

LENGTH = 2048
END_TOKEN = 0
GROUP = 65_536
CHUNK_WORDS = 1_000_000
REMEMBERED = 1_000_000
LONGEST_REMEMBERED = 64

_LETTERS = re.compile(r"[A-Za-zà-öø-ÿÀ-ÖØ-Þ]{1,64}")
_STOPS = frozenset(".,;:!?")
_MARK = "0"
_JOINED = 200


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def splits_at_blanks(path: str) -> bool:
    """Whether white space only separates: no tokens for it, and none across it."""
    found = _tokenizer(path)
    probe = ["Some, words.", "don't", "x 1", "ÀÉ"]
    joined = found.encode(" \n ".join(probe), add_special_tokens=False).ids
    apart = [found.encode(text, add_special_tokens=False).ids for text in probe]
    return joined == [number for ids in apart for number in ids]


class WordTokens:
    """Token ids of words (unsigned 32-bit little-endian, as bytes), remembered.

    Words of letters are looked up in small letters and without the stop behind them, if the
    tokeniser treats them so (``folds``), and tokenised many at a time with a mark between.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.ids: dict[str, bytes] = {}
        word, small_, stopped, stop, mark = self._alone(["Word", "word", "word,", ",", _MARK])
        together = self._ids(f"word {_MARK} word")
        self.folds = word == small_ and stopped == small_ + stop
        self.folds &= len(mark) == 4 and together == small_ + mark + small_
        self.mark = int.from_bytes(mark[:4], "little")

    def _ids(self, text: str) -> bytes:
        found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(found, dtype="<u4").tobytes()

    def _alone(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.asarray(one.ids, dtype="<u4").tobytes() for one in found]

    def _together(self, words: list[str]) -> list[bytes]:
        """Words of letters alone, none of whose ids is the mark's."""
        between = f" {_MARK} "
        texts = [between.join(words[at : at + _JOINED]) for at in range(0, len(words), _JOINED)]
        out: list[bytes] = []
        for one in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.asarray(one.ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark)
            data = ids.tobytes()
            starts = [0, *((cuts + 1) * 4).tolist()]
            ends = [*(cuts * 4).tolist(), len(data)]
            out += [data[start:end] for start, end in zip(starts, ends, strict=True)]
        return out

    def of(self, words: list[str]) -> list[bytes]:
        known = self.ids
        if len(known) > REMEMBERED:
            known.clear()
        parts: dict[str, tuple[str, str]] = {}
        plain, other = set(), set()
        for word in [word for word in words if word not in known]:
            stop = word[-1:] if word[-1:] in _STOPS else ""
            stem = word[:-1] if stop else word
            # Most words are plain letters, which need no pattern.
            ascii_word = stem.isascii() and stem.isalpha() and len(stem) <= LONGEST_REMEMBERED
            if self.folds and (ascii_word or _LETTERS.fullmatch(stem)):
                stem = stem.lower()
                parts[word] = stem, stop
                plain.add(stem)
                if stop:
                    other.add(stop)
            else:
                other.add(word)
        plain, rest = [w for w in plain if w not in known], [w for w in other if w not in known]
        known.update(zip(plain, self._together(plain), strict=True))
        known.update(zip(rest, self._alone(rest), strict=True))
        for word, (stem, stop) in parts.items():
            known[word] = known[stem] + known[stop] if stop else known[stem]
        found = [known[word] for word in words]
        for word in rest:
            if len(word) > LONGEST_REMEMBERED:
                del known[word]
        return found


@lru_cache(maxsize=1)
def _word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def token_ids(texts: pa.Array, tokens: WordTokens) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and where each text begins (and the end)."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    # Far cheaper than a Python list of scalars, one after the other.
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    ids = tokens.of(words)
    lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    pool = np.frombuffer(b"".join(ids), dtype="<u4")
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(ids) else np.zeros(0, np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    each = lengths[codes]
    ends = np.cumsum(each)
    begins = np.concatenate([[0], ends])
    where = np.arange(begins[-1]) + np.repeat(starts[codes] - begins[:-1], each)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return pool[where], begins[offsets]


def tokenised(df: DataFrame, key: str, text: str, path: str, length: int = LENGTH) -> DataFrame:
    """Pieces: key, piece, start, length, ids (unsigned 32-bit little-endian, as binary), and
    ``unit``, a number of each document of its own."""
    if not splits_at_blanks(path):
        raise ValueError(f"{path} makes tokens of white space or across it")
    schema = f"key {df.schema[key].dataType.simpleString()}, piece int, start long, length long, "
    schema += "ids binary, unit long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _word_tokens(path)
        unit = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in chunks(iter([whole]), 1, CHUNK_WORDS):
                ids, begins = token_ids(batch.column(1).cast(pa.string()), tokens)
                rows: dict[str, list] = {name: [] for name in ("row", "piece", "start", "ids")}
                for row in range(batch.num_rows):
                    own = np.append(ids[begins[row] : begins[row + 1]], np.uint32(END_TOKEN))
                    for piece, start in enumerate(range(0, len(own), length)):
                        rows["row"].append(row)
                        rows["piece"].append(piece)
                        rows["start"].append(start)
                        rows["ids"].append(own[start : start + length].astype("<u4").tobytes())
                taken = pa.array(rows["row"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(taken),
                        pa.array(rows["piece"], pa.int32()),
                        pa.array(rows["start"], pa.int64()),
                        pa.array([len(one) // 4 for one in rows["ids"]], pa.int64()),
                        pa.array(rows["ids"], pa.binary()),
                        pa.array(np.asarray(rows["row"], dtype=np.int64) + unit),
                    ],
                    names=["key", "piece", "start", "length", "ids", "unit"],
                )
                unit += batch.num_rows

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(cut, schema)


def place_all(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences."""
    order = np.argsort(-lengths, kind="stable")
    counts = np.zeros(length + 1, dtype=np.int64)  # open sequences by gap
    open_by_gap: list[list[int]] = [[] for _ in range(length + 1)]
    sequence = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    made = 0
    for at in order:
        size = int(lengths[at])
        # Moving one sequence from gap g to g - size changes the sum of squares by
        # 2 * (counts[g - size] - counts[g]) + 2, and closing it by 1 - 2 * counts[g].
        change = 2 * (counts[: length + 1 - size] - counts[size:]) + 2
        change[0] = 1 - 2 * counts[size]
        change[counts[size:] == 0] = np.iinfo(np.int64).max
        gap = int(np.argmin(change)) + size
        # With the longest first, a new sequence is worth opening only where none has room.
        if counts[gap]:
            where = open_by_gap[gap].pop()
            counts[gap] -= 1
        else:
            where, gap, made = made, length, made + 1
        sequence[at], offset[at] = where, length - gap
        if gap > size:
            counts[gap - size] += 1
            open_by_gap[gap - size].append(where)
    return sequence, offset, made


def placements(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``unit``, ``piece``, ``sequence_id`` and ``offset`` of every stored piece."""
    whole = F.col("length") == length
    groups = max(1, -(-pieces.filter(~whole).count() // GROUP))
    group = F.pmod(F.xxhash64("unit"), F.lit(groups))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("unit", kind="stable")
        sequence, offset, _ = place_all(rows["length"].to_numpy(), length)
        return pd.DataFrame(
            {
                "unit": rows["unit"].to_numpy(),
                "piece": rows["piece"].to_numpy(),
                # Even numbers for shared sequences, odd ones for whole pieces.
                "sequence_id": 2 * (rows["group"].to_numpy() * GROUP * 16 + sequence),
                "offset": offset,
            }
        )

    shared = (
        pieces.filter(~whole)
        .select("unit", "piece", "length", group.alias("group"))
        .groupBy("group")
        .applyInPandas(pack, "unit long, piece int, sequence_id long, offset long")
    )
    alone = pieces.filter(whole).select(
        "unit",
        "piece",
        (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return shared.unionByName(alone)


def pack(
    df: DataFrame, key: str, text: str, path: str, length: int = LENGTH, *wanted: Column
) -> DataFrame:
    """All pieces with their places: key, piece, start, length, sequence_id, offset, and the
    ids, or only what is ``wanted`` of these, which then travels in their stead."""
    small_batches(df.sparkSession)
    pieces = stored(tokenised(df, key, text, path, length))
    places = stored(placements(pieces, length))
    carried = pieces.select("key", "unit", "piece", "start", "length", *(wanted or [F.col("ids")]))
    return carried.join(places, ["unit", "piece"]).drop("unit").withColumnRenamed("key", key)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids in order, as binary."""
    own = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    joined = "aggregate(parts, cast('' as binary), (ids, part) -> concat(ids, part.ids))"
    return own.select("sequence_id", F.expr(joined).alias("ids"))
