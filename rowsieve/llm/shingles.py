"""Word shingles of texts as arrays of 64-bit numbers, and their similarity.

Words are what stands between ASCII white space. A shingle is five words in a row; a text of
one to four words is one shingle of all of them, and a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from rowsieve.llm.common import WORDS_PER_SHINGLE

# Words handled at a time, which bounds memory whatever the texts' lengths.
CHUNK_WORDS = 150_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x (uint64)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Words:
    """Word numbers of texts one after the other; text i has those from starts[i] to starts[i+1]."""

    numbers: np.ndarray
    starts: np.ndarray


def words_of(texts: pa.Array) -> Words:
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    # Far cheaper than a Python list of scalars, one after the other.
    spelled = coded.dictionary.to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    hashed = (
        pd.util.hash_array(spelled, categorize=False) if len(spelled) else np.zeros(0, np.uint64)
    )
    numbers = hashed[codes] if len(codes) else np.zeros(0, np.uint64)
    empty = np.flatnonzero(spelled == "")
    if len(empty):
        real = codes != empty[0]
        before = np.concatenate([[0], np.cumsum(real)])
        numbers, starts = numbers[real], before[starts]
    return Words(numbers, starts)


def shingles_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle numbers, the place of each one's first word, and where each text's begin."""
    n, counts = WORDS_PER_SHINGLE, np.diff(words.starts)
    each = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(each)])
    first = np.arange(begins[-1]) + np.repeat(words.starts[:-1] - begins[:-1], each)
    short = np.repeat(np.where(counts < n, counts, n), each)
    combined = np.zeros(len(first), dtype=np.uint64)
    last = max(len(words.numbers) - 1, 0)
    for step in range(n):
        word = words.numbers[np.minimum(first + step, last)] if len(first) else combined
        combined = combined * np.uint64(0x9E3779B97F4A7C15) + np.where(
            step < short, word, np.uint64(step)
        )
    return mixed(combined), first, begins


def chunks(
    batches: Iterator[pa.RecordBatch], text: int, words: int = CHUNK_WORDS
) -> Iterator[pa.RecordBatch]:
    """The rows again in batches of about so many words, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes) // (words * 6)
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if end > start:
                yield batch.slice(start, end - start)


def weighed(numbers: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One text's different shingles in order, with their weights summed up."""
    order = np.argsort(numbers, kind="stable")
    numbers, weights = numbers[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    return numbers[first], np.add.reduceat(weights, first)


Weighed = tuple[np.ndarray, np.ndarray]


def similarity(a: Weighed, b: Weighed) -> float:
    """Weighted Jaccard similarity: sum of the smaller weights by sum of the larger."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    common = b[0][at] == a[0]
    shared = float(np.minimum(a[1][common], b[1][at[common]]).sum(dtype=np.float64))
    return shared / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - shared)
