"""Class scoring on arrays: many parts, pieces of parts, against the round in plain operations."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rowsieve.llm import brown

WORDS = ["", " ", "a", "eight888", "seven77", "ß", "x" * 31, "y" * 32, "z" * 33, "long" * 50, "日本語" * 7]


def test_ids_are_those_of_spark(spark):
    words = pa.array(["cut off", *WORDS])[1:]
    want = [xxhash.xxh64_intdigest(word.encode(), seed=42) for word in WORDS]
    assert brown.xxhash64(words).tolist() == want
    rows = spark.createDataFrame([(word,) for word in WORDS], "w string")
    assert [row[0] % 2**64 for row in rows.select(F.xxhash64("w")).collect()] == want


def test_packed_slices():
    numbers = brown.Packed(np.array([0, 255, 256, 70000]))
    assert brown._taken({"x": numbers[1:3]}, "x").tolist() == [255, 256]
    assert brown._joined([{"x": brown.packed(np.array([2**63], np.uint64))}, {"x": brown.packed(np.zeros(0))}], "x")[0] == 2**63


def texts(rng, n=120):
    kinds = [["the", "a", "this"], [f"noun{k}" for k in range(40)], [f"verb{k}" for k in range(15)]]
    return [" ".join(rng.choice(kinds[at % 3]) for at in range(rng.randint(1, 40))) for _ in range(n)] + ["", None, " the "]


def plain(spark, rows):
    """prev, cur, n of ``texts`` by Python."""
    counts = {}
    for text in rows:
        words = [*(text or "").split(), brown.END]
        for pair in zip([brown.START, *words], words, strict=False):
            counts[pair] = counts.get(pair, 0) + 1
    rows = [(prev, cur, n) for (prev, cur), n in counts.items()]
    frame = spark.createDataFrame(rows, "p string, c string, n long")
    return frame.select(F.xxhash64("p").alias("prev"), F.xxhash64("c").alias("cur"), "n")


def classes_of(state):
    found = {}
    for row in state.filter("piece = 0").collect():
        row = row.asDict()
        for name in brown.STATE:
            row[name] = brown._longs(brown._taken(row, name))
        found |= dict(zip(row["words"].tolist(), zip(row["cls"].tolist(), row["count"].tolist(), strict=True), strict=True))
    return found


@pytest.mark.parametrize("parts, piece_pairs", [(4, 10**6), (3, 7)])
def test_rounds_as_in_plain_operations(spark, monkeypatch, parts, piece_pairs):
    monkeypatch.setattr(brown, "PIECE_PAIRS", piece_pairs)
    monkeypatch.setattr(brown, "WEIGHED", 20)
    monkeypatch.setattr(brown, "CHUNK_TOKENS", 100)
    monkeypatch.setattr(brown, "COMPARED", 3)
    monkeypatch.setattr(brown, "ANSWERED", 2)
    own = texts(random.Random(5))
    classes, rounds = 6, 3
    pairs = plain(spark, own).cache()
    counts = pairs.groupBy(F.col("cur").alias("word")).agg(
        F.sum("n").alias("count"), F.sum(brown._xlogx(F.col("n").cast("double"))).alias("f")
    )
    want = counts.select("word", brown.hashed_class(F.col("word"), classes).alias("class"), "count", "f")
    for turn in range(rounds):
        want = brown._round(pairs, want, brown._follows(pairs, want), classes, turn).localCheckpoint()
    frame = spark.createDataFrame([(text,) for text in own], "_text string").repartition(3)
    state = brown.bigrams(frame, parts, classes)
    state, _ = brown.exchange(state, parts, classes, rounds)
    assert (state.filter("piece > 0").count() > 0) == (piece_pairs == 7)
    assert classes_of(state) == {row["word"]: (row["class"], row["count"]) for row in want.collect()}
    lead = want.select(F.col("word").alias("prev"), F.col("class").alias("c1"))
    follow = want.select(F.col("word").alias("cur"), F.col("class").alias("c2"))
    moves = pairs.join(follow, "cur").join(lead, "prev", "left").na.fill(classes, ["c1"])
    moves = moves.groupBy("c1", "c2").agg(F.sum("n").alias("n"))
    assert sorted(brown.transitions(state, parts, classes).collect()) == sorted(moves.collect())


def test_scores_do_not_depend_on_parts(spark, monkeypatch):
    rng = random.Random(9)
    rows = [*enumerate(texts(rng)), (None, "the noun1 never"), (7, "the noun1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sort = lambda found: sorted((tuple(row) for row in found.collect()), key=repr)
    want = sort(brown.scores(frame, classes=5, rounds=2))
    monkeypatch.setattr(brown, "PART_BYTES", 2000)
    monkeypatch.setattr(brown, "PIECE_PAIRS", 30)
    monkeypatch.setattr(brown, "CHUNK_TOKENS", 50)
    got = sort(brown.scores(frame.repartition(4), classes=5, rounds=2))
    assert len(got) == len(rows)
    for one, other in zip(got, want, strict=True):
        assert one[:5] == other[:5]
        assert one[5:] == pytest.approx(other[5:], rel=1e-9)


def test_no_row_is_made_for_a_bigram(spark):
    """The tokens, bigrams and classes of a part travel as one row, however many they are."""
    frame = spark.createDataFrame([(text,) for text in texts(random.Random(2), 300)], "_text string")
    state = brown.bigrams(frame.coalesce(1), 2, 4)
    assert state.count() == 2
    asks = brown._asks(state, 2, 4, 0)
    assert asks.count() == 2 + 4
    assert brown._answered(asks, 2, 4).count() == 2 + 4
