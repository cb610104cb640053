"""More repeated units than the bitmap can tell apart: they are joined by their hashes."""

from __future__ import annotations

import random
import string

from rowsieve.llm import passages


def words(rng, n):
    return ["".join(rng.choices(string.ascii_lowercase, k=7)) for _ in range(n)]


def test_units_beyond_the_bitmap(spark, monkeypatch):
    rng = random.Random(11)
    shared, line = words(rng, 60), " ".join(words(rng, 30))
    texts = [" ".join([*words(rng, 40 + at), *shared, *words(rng, 40)]) + "\n" + line for at in range(4)]
    rows = spark.createDataFrame([*enumerate(texts), (7, None), (None, texts[1])], "doc_id long, text string")
    want = passages.repeated_passages(rows, "doc_id").collect()
    monkeypatch.setattr(passages, "BITMAP_BITS", 0)
    got = passages.repeated_passages(rows, "doc_id")
    left = passages.without_repeats(rows, "doc_id").collect()
    assert sorted(got.collect(), key=repr) == sorted(want, key=repr)
    assert {row.doc_id for row in want if row.first_word is not None} >= {0, 1, 2, 3}
    assert all(shared[30] in row.text for row in left if row.doc_id == 0)
    assert not any(shared[30] in row.text for row in left if row.doc_id in (1, 2, 3))
