"""Language-model scoring with Brown class-based bigrams.

Words are put into ``CLASSES`` classes by exchange clustering over the bigram counts of
the training documents, then every document is scored by the class bigram model

    P(w_i | w_{i-1}) = P(C(w_i) | C(w_{i-1})) * P(w_i | C(w_i))

with additive smoothing of both parts (``SMOOTHING``). A document's tokens are its words
and one end token; the first word follows a start token, which has a class of its own.

Exchange clustering starts from hashed classes and, round after round (``ROUNDS``), moves
each word to the class that raises the training likelihood most. The likelihood used for
the moves is that of the predictive class model (Uszkoreit and Brants, 2008), whose change
for one word depends only on that word's predecessors and the class totals, so all words of
a round are weighed at once, as one join and aggregate, against the classes of the round
before. Half of the words (by a bit of their id) may move in a round, the other half in the
next, which keeps two words from swapping back and forth. A move needs a gain above
``EPSILON``; equal gains go to the smaller class number.

Words travel as 64-bit ids (``xxhash64`` of the word); two words with one id would count
as one (chance about n^2 / 2^65 for n distinct words). Words are dealt over parts by their
ids, as many parts as ``PART_BYTES`` go into the training text. A part is one row of arrays:
its words, their classes and counts, and for every word the words before it with their
numbers. A round is three steps, each a pass over such rows with numpy: every part asks for
the words before its own, and says how often they are followed by each class there; the
parts of those words sum that up and answer with the whole sums, in the order asked; then
each part weighs its words. Only what leads to a word that may move is answered. Scoring
is alike: pieces of ``CHUNK_TOKENS`` tokens ask the parts of their words for class and
count. So the work grows with the corpus, nothing of it passes through the driver but
class totals and transitions (bounds of the parameter), and no row is made for a token, a
bigram or a bigram and class. The parts are stored in the shared folder each round, the
round before deleted. ``_follows`` and ``_round`` are the same round in plain DataFrame
operations, against which the arrays are tested.

Defined cases: a NULL text is empty and has the end token only; a NULL doc_id has no
remainder, so its row is not held out and trains; repeated rows train and are scored each
time; words never seen in training take their hashed class and the smoothed share of an
unseen word; with no training tokens at all every class and transition is uniform; other
columns of the input, whatever their names, are read by nothing.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rowsieve.llm.common import small_batches, stored, stored_at
from rowsieve.llm.shingles import chunks
from rowsieve.plans.cluster import drop_folder

CLASSES = 32
ROUNDS = 4
SMOOTHING = 0.5
EPSILON = 1e-6
# Training text of a part, about 300,000 different bigrams.
PART_BYTES = 4 * 1024 * 1024
# Bigrams of a part beyond which it is more than one piece, as one word may follow very many.
PIECE_PAIRS = 600_000
# What a worker gets at once, beside a part.
BATCH_BYTES = 4 * 1024 * 1024
# Tokens whose words are merged before they are sent.
CHUNK_TOKENS = 300_000
# Bigrams and classes that are weighed at a time.
WEIGHED = 200_000
# Pieces answered at a time; words whose gains are compared at a time.
ANSWERED, COMPARED = 16, 4096
# What a worker sends before it gives back memory that it has freed.
SENT_BYTES = 8 * 1024 * 1024
# Largest table broadcast.
BROADCAST_BYTES = 8 * 1024 * 1024
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Neither can be a word: words are non-empty and hold no blank.
END = ""
START = " "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


P1, P2, P3, P4, P5 = (
    np.uint64(p)
    for p in (
        0x9E3779B185EBCA87,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    )
)
SEED = 42


def xxhash64(words: pa.Array) -> np.ndarray:
    """Spark's ``xxhash64`` of each string, as uint64."""
    words = words.cast(pa.binary())
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    at, size = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)

    def read(places: np.ndarray, width: int = 8) -> np.ndarray:
        found = data[places[:, None] + np.arange(width)]
        return found.view(f"<u{width}")[:, 0].astype(np.uint64)

    def lane(x: np.ndarray) -> np.ndarray:
        return _rotated(x * P2, 31) * P1

    hashed = np.full(len(size), SEED, np.uint64) + P5
    long = np.flatnonzero(size >= 32)
    if len(long):
        start = np.uint64(SEED) + np.zeros(len(long), np.uint64)
        sums = [start + P1 + P2, start + P2, start, start - P1]
        for stripe in range(int(size[long].max()) // 32):
            here = np.flatnonzero(size[long] // 32 > stripe)
            for k in range(4):
                taken = read(at[long[here]] + 32 * stripe + 8 * k)
                sums[k][here] = _rotated(sums[k][here] + taken * P2, 31) * P1
        whole = sum(_rotated(x, by) for x, by in zip(sums, (1, 7, 12, 18), strict=True))
        for x in sums:
            whole = (whole ^ lane(x)) * P1 + P4
        hashed[long] = whole
    hashed += size.astype(np.uint64)
    rest, at = size % 32, at + size // 32 * 32
    for k in range(3):
        here = np.flatnonzero(rest >= 8 * k + 8)
        hashed[here] = _rotated(hashed[here] ^ lane(read(at[here] + 8 * k)), 27) * P1 + P4
    rest, at = rest % 8, at + rest // 8 * 8
    here = np.flatnonzero(rest >= 4)
    hashed[here] = _rotated(hashed[here] ^ (read(at[here], 4) * P1), 23) * P2 + P3
    rest, at = rest % 4, at + rest // 4 * 4
    for k in range(3):
        here = np.flatnonzero(rest > k)
        hashed[here] = _rotated(hashed[here] ^ (read(at[here] + k, 1) * P5), 11) * P1
    hashed = (hashed ^ (hashed >> np.uint64(33))) * P2
    hashed = (hashed ^ (hashed >> np.uint64(29))) * P3
    return hashed ^ (hashed >> np.uint64(32))


END_ID, START_ID = xxhash64(pa.array([END, START]))


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((ids >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def tokens(texts: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids of the texts' words (A-Z lower-cased) and end tokens, by part and id;
    the place in them of each token; and each text's number of tokens."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    ids, codes = xxhash64(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
    # Blanks at the ends leave empty pieces, which are no words.
    empty = ids == END_ID
    if empty.any():
        real = ~empty[codes]
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    # An end token after each text's words.
    codes = np.insert(codes.astype(np.int64), offsets[1:], len(ids))
    ids = np.concatenate([ids, [END_ID]])
    # Ids that no word is left of are not asked for.
    ids, place = np.unique(ids, return_inverse=True)
    codes = place[codes]
    used = np.zeros(len(ids), bool)
    used[codes] = True
    order = np.flatnonzero(used)
    order = order[np.argsort(part_of(ids[order], parts), kind="stable")]
    rank = np.zeros(len(ids), np.int64)
    rank[order] = np.arange(len(order))
    return ids[order], rank[codes], np.diff(offsets) + 1


def _cuts(ids: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """Each part that ids, sorted by part, have, with its first place and the one past it."""
    own = part_of(ids, parts)
    cuts = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
    for first, last in zip(cuts, cuts[1:], strict=False):
        yield int(own[first]), int(first), int(last)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sums of n."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places from each start, so many of each."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


Row = dict[str, object]


class Packed:
    """Whole numbers as bytes of the narrowest kind that holds them all; the last byte tells
    the kind, so that any slice can be sent alone."""

    def __init__(self, numbers: np.ndarray):
        most = int(numbers.max()) if len(numbers) else 0
        self.numbers = numbers.astype(np.min_scalar_type(most), copy=False)
        self.kind = bytes([self.numbers.dtype.itemsize])

    def __getitem__(self, places: slice) -> bytes:
        return self.numbers[places].tobytes() + self.kind

    def whole(self) -> bytes:
        return self[:]


def packed(numbers: np.ndarray) -> bytes:
    return Packed(numbers).whole()


def _taken(row: Row, name: str) -> np.ndarray:
    view = row[name]
    width = view[-1]
    return np.frombuffer(view, f"<u{width}", (len(view) - 1) // width)


def _joined(rows: list[Row], name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint8), *[_taken(row, name) for row in rows]])


def _longs(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    """Rows as dicts; binaries are views into their batch."""
    for batch in batches:
        columns = []
        for column in batch.columns:
            if column.null_count == len(column):
                columns.append([None] * len(column))
            elif pa.types.is_binary(column.type):
                _, ends, data = column.buffers()
                ends = np.frombuffer(ends, np.int32)[column.offset :].tolist()
                view, there = memoryview(data), column.is_valid().to_pylist()
                columns.append([view[ends[i] : ends[i + 1]] if is_ else None for i, is_ in enumerate(there)])
            else:
                columns.append(column.to_pylist())
        for values in zip(*columns, strict=True):
            yield dict(zip(batch.schema.names, values, strict=True))


def _give_back() -> None:
    """Freed memory goes back to the system, where the C library has a call for it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _passed(
    df: DataFrame, fn: Callable[[Iterator[Row]], Iterator[list[Row]]], schema: str
) -> DataFrame:
    """What ``fn`` gives for the rows, list by list; names that a row lacks are NULL."""
    shape = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = 0
        for rows in fn(_rows(batches)):
            # Where views were passed on, workers kept the memory of the batches behind them.
            for row in rows:
                row.update((name, bytes(v)) for name, v in row.items() if isinstance(v, memoryview))
            arrays = [pa.array([row.get(field.name) for row in rows], field.type) for field in arrow]
            made = pa.RecordBatch.from_arrays(arrays, schema=arrow)
            sent += made.nbytes
            yield made
            # Not held while the next are made.
            del rows, arrays, made
            if sent > SENT_BYTES:
                _give_back()
                sent = 0
        _give_back()

    return df.mapInArrow(run, shape)


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "part").sortWithinPartitions("part", "piece", "kind", "src")


STATE = ["words", "runs", "prev", "at", "n", "cls", "count"]
STATE_SCHEMA = "part long, piece long, " + ", ".join(f"{name} binary" for name in STATE)
SENT_SCHEMA = f"{STATE_SCHEMA}, kind int, src long, k binary, m binary, asked binary"
# Kinds of rows; a piece's own comes first.
OWN, ASK, ANSWER = 0, 1, 2
# What asks is a piece: its part, shifted by so many bits, and its number.
PIECE_BITS = 24


def bigrams(rows: DataFrame, parts: int, classes: int) -> DataFrame:
    """The parts: (part, piece, ``STATE``) with all bigrams of ``rows`` (_text), in hashed classes.

    ``words`` in order; ``runs`` has how many different words come before each; ``at`` is
    their place in ``prev``, which is ordered by part and id; ``n`` counts the bigram. A part
    with many bigrams is several pieces, which have the same words and by their ids different
    words before them; only the first has ``count``, the words' numbers in the whole part."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 0, CHUNK_TOKENS):
            ids, codes, sizes = tokens(batch.column(0), parts)
            before = np.concatenate([[0], codes[:-1]])
            # The place past all ids stands for the start.
            before[np.cumsum(sizes) - sizes] = len(ids)
            pairs, n = np.unique((codes << 32) | before, return_counts=True)
            cur, prev = pairs >> 32, np.append(ids, START_ID)[pairs & 0xFFFFFFFF]
            columns: list[list] = [[], [], [], [], []]
            for part, first, last in _cuts(ids, parts):
                a, b = np.searchsorted(cur, [first, last])
                row = (ids[first:last], np.bincount(cur[a:b] - first), prev[a:b], n[a:b])
                for column, value in zip(columns, (part, *map(packed, row)), strict=True):
                    column.append(value)
            kinds = [pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
                names=["part", "words", "runs", "prev", "n"],
            )

    def merge(rows: Iterator[Row]) -> Iterator[list[Row]]:
        for part, some in groupby(rows, lambda row: row["part"]):
            some = list(some)
            words = np.unique(_joined(some, "words").astype(np.uint64))
            cls, count = packed(np.mod(words.view(np.int64), classes)), np.zeros(len(words), np.int64)
            for row in some:
                n, runs = _longs(_taken(row, "n")), _longs(_taken(row, "runs"))
                count[np.searchsorted(words, _words(row))] += np.add.reduceat(n, np.cumsum(runs) - runs)
            pieces = -(-sum(len(_taken(row, "n")) for row in some) // PIECE_PAIRS)
            for piece in range(pieces):
                own = merged(some, words, piece, pieces)
                yield [{"part": part, "piece": piece, "cls": cls, "count": packed(count) if piece == 0 else None} | own]

    def merged(some: list[Row], words: np.ndarray, piece: int, pieces: int) -> Row:
        taken = []
        for row in some:
            prev = _words(row, "prev")
            here = slice(None) if pieces == 1 else (prev >> np.uint64(8)) % np.uint64(pieces) == piece
            word = np.repeat(np.searchsorted(words, _words(row)), _taken(row, "runs"))
            taken.append((word[here], prev[here], _taken(row, "n")[here]))
        word, prev, n = (np.concatenate(part) for part in zip(*taken, strict=True))
        prev, at = np.unique(prev, return_inverse=True)
        order = np.argsort(part_of(prev, parts), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs, n = _summed((word << 32) | rank[at], _longs(n))
        runs = np.bincount(pairs >> 32, minlength=len(words))
        found = {"words": words, "runs": runs, "prev": prev[order], "at": pairs & 0xFFFFFFFF, "n": n}
        return {name: packed(numbers) for name, numbers in found.items()}

    cut_rows = rows.select("_text").mapInArrow(
        cut, "part long, words binary, runs binary, prev binary, n binary"
    )
    dealt = cut_rows.repartition(parts, "part").sortWithinPartitions("part")
    return _passed(dealt, merge, STATE_SCHEMA)


def hashed_class(word: Column, classes: int) -> Column:
    return F.pmod(word, F.lit(classes)).cast("int")


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def small(df: DataFrame) -> DataFrame:
    """A stored ``df`` of ids and numbers, marked for broadcast where its row count proves
    it below ``BROADCAST_BYTES``; else left to a shuffled join."""
    width = 8 * (len(df.columns) + 2)
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def _moving(words: np.ndarray, turn: int) -> np.ndarray:
    return ((words >> np.uint64(32)) & np.uint64(1)) == np.uint64(turn % 2)


def _words(row: Row, name: str = "words") -> np.ndarray:
    return _taken(row, name).astype(np.uint64, copy=False)


def _asking(row: Row, turn: int | None) -> np.ndarray:
    """Which words before others come before one that may move; none without a turn."""
    asked = np.zeros(len(_taken(row, "prev")), bool)
    if turn is not None:
        moving = np.repeat(_moving(_words(row), turn), _taken(row, "runs"))
        asked[_taken(row, "at")[moving]] = True
    return asked


def _asks(state: DataFrame, parts: int, classes: int, turn: int | None) -> DataFrame:
    """The parts themselves, and what each part asks and tells the parts of the words before
    its own: how often each of them (``prev``) is followed there by ``k`` classes ``cls``,
    ``m`` times each, and whether an answer is ``asked``."""

    def ask(rows: Iterator[Row]) -> Iterator[list[Row]]:
        for row in rows:
            yield [row | {"kind": OWN}]
            prev, own = _words(row, "prev"), np.repeat(_taken(row, "cls"), _taken(row, "runs"))
            keys, m = _summed(_longs(_taken(row, "at")) * classes + own, _longs(_taken(row, "n")))
            k = np.bincount(keys // classes, minlength=len(prev))
            ends = np.concatenate([[0], np.cumsum(k)]).tolist()
            each = {"prev": Packed(prev), "k": Packed(k), "asked": Packed(_asking(row, turn).view(np.uint8))}
            every = {"cls": Packed(keys % classes), "m": Packed(m)}
            yield [
                {"part": part, "kind": ASK, "src": row["part"] << PIECE_BITS | row["piece"]}
                | {name: numbers[first:last] for name, numbers in each.items()}
                | {name: numbers[ends[first] : ends[last]] for name, numbers in every.items()}
                for part, first, last in _cuts(prev, parts)
            ]

    return _dealt(_passed(state, ask, SENT_SCHEMA), parts)


def _sums(asks: list[Row], classes: int) -> tuple[np.ndarray, ...]:
    """The different words asked about, the place in them of each one asked, how many classes
    follow each, and these classes and how often they do."""
    prev, where = np.unique(_joined(asks, "prev").astype(np.uint64), return_inverse=True)
    keys = np.repeat(where, _joined(asks, "k")) * classes + _joined(asks, "cls")
    keys, m = _summed(keys, _longs(_joined(asks, "m")))
    return prev, where, np.bincount(keys // classes, minlength=len(prev)), keys % classes, m


def _answered(asks: DataFrame, parts: int, classes: int) -> DataFrame:
    """The parts themselves, and the whole sums (``k``, ``cls``, ``m``) for each part that asks,
    in the order asked."""

    def answer(rows: Iterator[Row]) -> Iterator[list[Row]]:
        for part, some in groupby(rows, lambda row: row["part"]):
            some = list(some)
            own, asked = [r for r in some if r["kind"] == OWN], [r for r in some if r["kind"] == ASK]
            yield own
            if not asked:
                continue
            _, where, k, cls, m = _sums(asked, classes)
            cls, m = Packed(cls).numbers, Packed(m).numbers
            starts, first = np.cumsum(k) - k, 0
            # A few that ask at a time, as all their answers may be many times the sums.
            for at in range(0, len(asked), ANSWERED):
                few = asked[at : at + ANSWERED]
                wanted = [_taken(row, "asked").view(bool) for row in few]
                own = where[first : first + sum(map(len, wanted))][np.concatenate(wanted)]
                first += sum(map(len, wanted))
                places = _ranges(starts[own], k[own])
                ends = np.concatenate([[0], np.cumsum([one.sum() for one in wanted])])
                past = np.concatenate([[0], np.cumsum(k[own])])[ends].tolist()
                sent = Packed(k[own]), Packed(cls[places]), Packed(m[places])
                yield [
                    {"part": row["src"] >> PIECE_BITS, "piece": row["src"] & (1 << PIECE_BITS) - 1}
                    | {"kind": ANSWER, "src": part}
                    | {"k": sent[0][a:b], "cls": sent[1][c:d], "m": sent[2][c:d]}
                    for row, a, b, c, d in zip(few, ends, ends[1:], past, past[1:], strict=False)
                    if b > a
                ]

    return _dealt(_passed(asks, answer, SENT_SCHEMA), parts)


def _xl(x: np.ndarray) -> np.ndarray:
    # Of numbers of times, so 0 or at least 1.
    return x * np.log(np.maximum(x, 1))


KNOWN = _xl(np.arange(1 << 16, dtype=np.float64))


def _xl_of(x: np.ndarray) -> np.ndarray:
    """``_xl`` of whole numbers, most of them looked up."""
    return KNOWN[x] if not len(x) or x.max() < len(KNOWN) else _xl(x.astype(np.float64))


def _moved(answers: DataFrame, classes: int, turn: int, totals: np.ndarray) -> DataFrame:
    """The parts, their words in the classes after the round."""

    def move(rows: Iterator[Row]) -> Iterator[list[Row]]:
        for _, some in groupby(rows, lambda row: row["part"]):
            pieces: list[Row] = []
            own = told = None
            for _, piece in groupby(some, lambda row: row["piece"]):
                own, *told = piece
                if not pieces:
                    may = np.flatnonzero(_moving(_words(own), turn))
                    a = _longs(_taken(own, "cls"))[may]
                    s, f = np.zeros((len(may), classes)), np.zeros(len(may))
                # Held as bytes; the batches it came in may go.
                pieces.append({name: bytes(v) if isinstance(v, memoryview) else v for name, v in own.items()})
                if len(may):
                    add(own, told, may, a, s, f)
                own = told = None
            cls = packed(decided(pieces[0], may, a, s, f))
            for own in pieces:
                yield [own | {"cls": cls}]

    def add(own: Row, answers: list[Row], may: np.ndarray, a: np.ndarray, s: np.ndarray, f: np.ndarray) -> None:
        """The terms of a piece's bigrams, added to s (word, class) and f (word)."""
        runs, asked = _longs(_taken(own, "runs")), _asking(own, turn)
        k = _longs(_joined(answers, "k"))
        assert len(k) == asked.sum(), "an answer is missing"
        # Kept narrow: there may be as many for each bigram as there are classes.
        to, m, starts = _joined(answers, "cls"), _joined(answers, "m"), np.cumsum(k) - k
        # The bigrams of the words that may move, word by word.
        bigrams = _ranges((np.cumsum(runs) - runs)[may], runs[may])
        if not len(bigrams):
            return
        word = np.repeat(np.arange(len(may)), runs[may])
        lead = (np.cumsum(asked) - 1)[_taken(own, "at")[bigrams]]
        n = _longs(_taken(own, "n")[bigrams])
        log_n = _xl_of(n)
        f += np.bincount(word, log_n, len(may))
        cuts = np.flatnonzero(np.diff(np.cumsum(k[lead]) // WEIGHED)) + 1
        for first, last in zip([0, *cuts], [*cuts, len(lead)], strict=True):
            here = lead[first:last]
            places, each = _ranges(starts[here], k[here]), k[here]
            x, y, w = _longs(m[places]), np.repeat(n[first:last], each), np.repeat(word[first:last], each)
            c, log_x = _longs(to[places]), _xl_of(x)
            terms = _xl_of(x + y) - log_x - np.repeat(log_n[first:last], each)
            same = np.flatnonzero(c == a[w])
            terms[same] = _xl_of(x[same] - y[same]) - log_x[same]
            low, high = w[0], w[-1] + 1
            summed = np.bincount((w - low) * classes + c, terms, (high - low) * classes)
            s[low:high] += summed.reshape(-1, classes)

    def decided(own: Row, may: np.ndarray, a: np.ndarray, s: np.ndarray, f: np.ndarray) -> np.ndarray:
        cls, count = _longs(_taken(own, "cls")), _taken(own, "count").astype(np.float64)
        for first in range(0, len(may), COMPARED):
            here = slice(first, first + COMPARED)
            words, now, gain = may[here], a[here], s[here]
            n, rows = count[words], np.arange(len(words))
            leave = gain[rows, now] - (_xl(totals[now] - n) - _xl(totals[now]))
            gain = f[here, None] + gain - (_xl(totals[None, :] + n[:, None]) - _xl(totals)[None, :])
            gain[rows, now] = -np.inf
            # The first of equal gains.
            best = np.argmax(gain, axis=1)
            better = leave + gain[rows, best] > EPSILON
            cls[words[better]] = best[better]
        return cls

    return _passed(answers, move, STATE_SCHEMA)


def _per_class(state: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """How often words of each class come, and how many words each class has."""

    def tell(rows: Iterator[Row]) -> Iterator[list[Row]]:
        total, members = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for row in rows:
            cls, count = _taken(row, "cls"), _taken(row, "count")
            np.add.at(total, cls, _longs(count))
            members += np.bincount(cls, minlength=classes)
        yield [{"class": c, "total": int(total[c]), "members": int(members[c])} for c in range(classes)]

    told = _passed(state.filter("piece = 0").select("cls", "count"), tell, "class int, total long, members long")
    rows = told.groupBy("class").agg(F.sum("total").alias("t"), F.sum("members").alias("n")).collect()
    # At most ``classes`` rows.
    total, members = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for row in rows:
        total[row["class"]], members[row["class"]] = row["t"], row["n"]
    return total, members


def exchange(state: DataFrame, parts: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[DataFrame, str]:
    """The parts with their words in the classes after ``rounds`` rounds, stored, and where."""
    state, path = stored_at(state)
    for turn in range(rounds):
        totals = _per_class(state, classes)[0].astype(np.float64)
        answers = _answered(_asks(state, parts, classes, turn), parts, classes)
        moved, after = stored_at(_moved(answers, classes, turn, totals))
        drop_folder(state.sparkSession, path)
        state, path = moved, after
    return state, path


def transitions(state: DataFrame, parts: int, classes: int) -> DataFrame:
    """(c1, c2, n): how often a word of class c1 is followed by one of class c2; c1 is
    ``classes`` for the start."""

    def add(rows: Iterator[Row]) -> Iterator[list[Row]]:
        table = np.zeros((classes + 1) * classes, np.int64)
        for _, some in groupby(rows, lambda row: row["part"]):
            some = list(some)
            own, asked = [r for r in some if r["kind"] == OWN], [r for r in some if r["kind"] == ASK]
            if not asked:
                continue
            # All pieces have the same words.
            own = own[:1]
            prev, _, k, cls, m = _sums(asked, classes)
            # A word before another is itself one of its part, but for the start.
            words, lead = _joined(own, "words").astype(np.uint64), _joined(own, "cls")
            c1 = np.full(len(prev), classes)
            inside = prev != START_ID
            c1[inside] = lead[np.searchsorted(words, prev[inside])]
            np.add.at(table, np.repeat(c1, k) * classes + cls, m)
        at = np.flatnonzero(table)
        yield [{"c1": int(x // classes), "c2": int(x % classes), "n": int(table[x])} for x in at]

    found = _passed(_asks(state, parts, classes, None), add, "c1 int, c2 int, n long")
    return found.groupBy("c1", "c2").agg(F.sum("n").alias("n"))


def _follows(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    """How often each predecessor is followed by each class."""
    cls = small(assigned).select(F.col("word").alias("cur"), F.col("class").alias("_c"))
    return pairs.join(cls, "cur").groupBy("prev", "_c").agg(F.sum("n").alias("m"))


def _may_move(word: str, turn: int) -> Column:
    """Whether the word is of the half that may move in this round."""
    return F.shiftrightunsigned(F.col(word), 32).bitwiseAND(F.lit(1)) == F.lit(turn % 2)


def _round(pairs: DataFrame, assigned: DataFrame, follows: DataFrame, classes: int, turn: int) -> DataFrame:
    # One total a class: at most ``classes`` numbers, inlined into the expressions.
    counted = assigned.groupBy("class").agg(F.sum("count").alias("t")).collect()
    totals = {row["class"]: float(row["t"]) for row in counted}
    t_of = F.array(*[F.lit(totals.get(c, 0.0)) for c in range(classes)])
    mine = small(assigned).select(F.col("word").alias("cur"), F.col("class").alias("a"))
    # Every predecessor of a word that may move meets every class it already leads to.
    meets = pairs.filter(_may_move("cur", turn)).join(mine, "cur").join(small(follows), "prev")
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    terms = meets.groupBy("cur", "_c").agg(
        F.sum(
            F.when(F.col("_c") == F.col("a"), _xlogx(m - n) - _xlogx(m)).otherwise(
                _xlogx(m + n) - _xlogx(m) - _xlogx(n)
            )
        ).alias("s")
    )
    # At most ``classes`` entries a word.
    per_word = terms.groupBy(F.col("cur").alias("word")).agg(
        F.map_from_entries(F.collect_list(F.struct("_c", "s"))).alias("_s")
    )
    decided = assigned.join(per_word, "word", "left")
    own, a = F.col("count").cast("double"), F.col("class")
    s_of = lambda c: F.coalesce(F.element_at(F.col("_s"), c), F.lit(0.0))
    leave = s_of(a) - (_xlogx(t_of[a] - own) - _xlogx(t_of[a]))

    def better(best: Column, c: Column) -> Column:
        gain = F.col("f") + s_of(c) - (_xlogx(t_of[c] + own) - _xlogx(t_of[c]))
        # Classes come in increasing order, so only a strictly larger gain replaces.
        take = (c != a) & (gain > best["g"])
        return F.when(take, F.struct(gain.alias("g"), c.alias("c"))).otherwise(best)

    start = F.struct(F.lit(float("-inf")).alias("g"), F.lit(-1).alias("c"))
    best = F.aggregate(F.sequence(F.lit(0), F.lit(classes - 1)), start, better)
    moves = _may_move("word", turn) & (leave + best["g"] > F.lit(EPSILON))
    return decided.select(
        "word", F.when(moves, best["c"]).otherwise(a).cast("int").alias("class"), "count", "f"
    )


@dataclass(frozen=True)
class Model:
    state: DataFrame  # the parts
    parts: int
    moves: np.ndarray  # log10 P(c2 | c1); the last row is the start's
    totals: np.ndarray  # how often words of each class come
    members: np.ndarray  # how many words each class has
    classes: int

    @property
    def tokens(self) -> int:
        return int(self.totals.sum())

    @property
    def distinct(self) -> int:
        return int(self.members.sum())


def fit(state: DataFrame, parts: int, classes: int = CLASSES, rounds: int = ROUNDS) -> Model:
    state, _ = exchange(state, parts, classes, rounds)
    totals, members = _per_class(state, classes)
    counts = np.zeros((classes + 1, classes))
    # At most (classes + 1) * classes rows.
    for row in transitions(state, parts, classes).collect():
        counts[row["c1"], row["c2"]] = row["n"]
    out = counts.sum(axis=1, keepdims=True)
    moves = np.log10((counts + SMOOTHING) / (out + SMOOTHING * classes))
    return Model(state, parts, moves, totals, members, classes)


def scores(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    held_out: Column | None = None,
    classes: int = CLASSES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per
    input row. ``held_out`` marks rows not to learn from (by default: crc32 of the doc_id
    as text, modulo 5, is 1)."""
    if held_out is None:
        held_out = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))
    rows = docs.select(
        F.col(doc_id).alias("_doc"), held_out.alias("_held"), F.col(text).cast("string").alias("_text")
    )
    spark = docs.sparkSession
    small_batches(spark, BATCH_BYTES)
    training = rows.filter(~F.col("_held"))
    size = training.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = -(-size // PART_BYTES) or 1
    # Each step of the fitting is written before the next reads it, so its shuffle files
    # may go as soon as it ends; the caller's setting comes back afterwards.
    had = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        model = fit(bigrams(training, parts, classes), parts, classes, rounds)
    finally:
        spark.conf.set(CLEANUP, had)
    return score_rows(rows, model)


def score_rows(rows: DataFrame, model: Model) -> DataFrame:
    """Every row scored: pieces of many texts ask the parts of their words for class and count."""
    parts, classes = model.parts, model.classes
    kind = rows.schema["_doc"].dataType
    schema = (
        f"part long, kind int, src long, words binary, cls binary, count binary, docs array<{kind.simpleString()}>, "
        "held array<boolean>, sizes binary, codes binary"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        names = ["part", "kind", "src", "words", "docs", "held", "sizes", "codes"]
        for batch in chunks(batches, 2, CHUNK_TOKENS):
            piece += 1
            ids, codes, sizes = tokens(batch.column(2), parts)
            cuts = list(_cuts(ids, parts))
            none = [None] * len(cuts)

            def listed(column: pa.Array) -> pa.Array:
                ends = [0] + [len(column)] * (len(cuts) + 1)
                return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), column)

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([piece % parts, *[part for part, _, _ in cuts]], pa.int64()),
                    pa.array([ASK, *[ANSWER] * len(cuts)], pa.int32()),
                    pa.array([piece] * (len(cuts) + 1), pa.int64()),
                    pa.array([None, *[packed(ids[a:b]) for _, a, b in cuts]], pa.binary()),
                    listed(batch.column(0)),
                    listed(batch.column(1)),
                    pa.array([packed(sizes), *none], pa.binary()),
                    pa.array([packed(codes), *none], pa.binary()),
                ],
                names=names,
            )

    def tell(batches: Iterator[Row]) -> Iterator[list[Row]]:
        part, words, cls, count = -1, *[np.zeros(0, np.uint64)] * 3
        for row in batches:
            if row["kind"] == OWN:
                part, words, cls, count = row["part"], *[_words(row, name) for name in ("words", "cls", "count")]
            elif row["kind"] == ASK:
                yield [row]
            else:
                own = _words(row)
                found, n = np.mod(own.view(np.int64), classes).astype(np.uint64), np.zeros(len(own), np.uint64)
                if part == row["part"] and len(words):
                    at = np.minimum(np.searchsorted(words, own), len(words) - 1)
                    known = words[at] == own
                    found[known], n[known] = cls[at[known]], count[at[known]]
                told = {"cls": packed(found), "count": packed(n)}
                yield [{"part": row["part"], "kind": ANSWER, "src": row["src"]} | told]

    base_total = model.tokens + SMOOTHING * (model.distinct + 1)
    below = model.totals + SMOOTHING * (model.members + 1)

    def score(batches: Iterator[Row]) -> Iterator[list[Row]]:
        for _, some in groupby(batches, lambda row: row["src"]):
            home, *some = some
            sizes, codes = _longs(_taken(home, "sizes")), _taken(home, "codes")
            cls, count = _longs(_joined(some, "cls")), _joined(some, "count")
            base = np.log10((count + SMOOTHING) / base_total)
            emit = np.log10((count + SMOOTHING) / below[cls])
            firsts = np.cumsum(sizes) - sizes
            c2 = cls[codes]
            c1 = np.concatenate([[0], c2[:-1]])
            c1[firsts] = classes
            values = (count > 0).astype(np.int64)[codes], base[codes], emit[codes] + model_moves[c1, c2]
            known, base, full = (np.add.reduceat(value, firsts).tolist() for value in values)
            columns = home["docs"], home["held"], sizes.tolist(), known, base, full
            names = "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"
            yield [
                dict(zip(names, each, strict=True)) | {"train_tokens": trained}
                for each in zip(*columns, strict=True)
            ]

    model_moves, trained = model.moves, model.tokens
    cut_schema = ", ".join(part for part in schema.split(", ") if not part.startswith(("cls ", "count ")))
    pieces = rows.mapInArrow(cut, cut_schema)
    vocabulary = model.state.filter("piece = 0").select(
        "part", F.lit(OWN).alias("kind"), F.lit(None).cast("long").alias("src"), "words", "cls", "count"
    )
    asked = vocabulary.unionByName(pieces, allowMissingColumns=True)
    dealt = asked.repartition(parts, "part").sortWithinPartitions("part", "kind")
    told = _passed(dealt, tell, schema)
    # A piece's texts come before the answers, which are in the order of the parts.
    back = told.repartition(parts, "src").sortWithinPartitions("src", "kind", "part")
    return _passed(
        back,
        score,
        f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, "
        "train_tokens long, base_score double, score double",
    )
