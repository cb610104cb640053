"""Pipeline stages keep input columns whose names clash with their own."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rowsieve.llm.common import word_count
from rowsieve.llm.minhash import one_of_each
from rowsieve.llm.mixing import mixed_rows
from rowsieve.llm.pii import redacted
from rowsieve.llm.quality import kept_documents

SCHEMA = "doc_id long, text string, lang string, source string, _row long, _base string, _words int, _key string, _digest string, __size double"
WORDS = "the of and a to in is it that was for on are with as his they be at one have this from".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = []
    for doc_id in range(40):
        text = " ".join(rng.choices(WORDS, k=rng.randint(60, 90))) + f" mail me at n{doc_id}@mail.test"
        rows.append((doc_id, text, "en", rng.choice(["a", "b"]), 7, "base", 3, "key", "dig", 1.5))
    rows.append((99, rows[0][1], "en", "a", 7, "base", 3, "key", "dig", 1.5))
    return spark.createDataFrame(rows, SCHEMA)


def extras_kept(out, columns):
    assert out.columns[: len(columns)] == columns
    got = out.select("_row", "_base", "_words", "_key", "_digest", "__size").distinct().collect()
    assert [tuple(row) for row in got] == [(7, "base", 3, "key", "dig", 1.5)]


def test_quality(docs):
    out = kept_documents(docs)
    extras_kept(out, docs.columns)
    assert out.count() > 0


def test_near_dedup(docs):
    out = one_of_each(docs, "doc_id")
    extras_kept(out, docs.columns)
    assert out.filter("doc_id = 99").count() == 0


def test_pii(docs):
    out = redacted(docs)
    extras_kept(out, docs.columns)
    assert out.filter(F.col("text").contains("@mail.test")).count() == 0


def test_mixing(docs):
    out = mixed_rows(docs, "source", word_count())
    extras_kept(out, docs.columns)
