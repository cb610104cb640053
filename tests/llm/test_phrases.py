"""Phrase mining against plain counting, with colliding fingerprints and defined cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rowsieve.llm import common, phrases

SCHEMA = "doc_id long, text string, lang string, fp1 long, digest string, n int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=phrases.TOP):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        total[lang] += 0
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(ws)
            for n in (1, 2, 3):
                for i in range(len(ws) - n + 1):
                    f[lang][" ".join(ws[i : i + n])] += 1
    out = []
    for lang, fl in f.items():
        cands = {p: a for p, a in fl.items() if a >= 10 and 2 <= len(p.split(" ")) <= 3}
        rows_ = []
        for p, a in cands.items():
            w = p.split(" ")
            inside = [
                b for q, b in cands.items()
                if len(q.split(" ")) == len(w) + 1 and (q.split(" ")[:-1] == w or q.split(" ")[1:] == w)
            ]
            if any(100 * b >= 50 * a for b in inside):
                continue
            cuts = [(a * a * 1000000 // (fl[" ".join(w[:k])] * fl[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows_.append((lang, p, a, fl[" ".join(w[:k])], fl[" ".join(w[k:])], total[lang], score))
        rows_.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], i + 1, *x[1:]) for i, x in enumerate(rows_[:top])]
    return sorted(out)


def corpus(rng):
    vocab = ["New", "york", "city", "the", "of", "a", "big", "red", "car", "ünïcode", "x"]
    rows = []
    for doc_id in range(120):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append(" ".join(rng.choices(vocab, k=rng.randint(1, 6))))
            parts.append(rng.choice([". ", ", ", "\n", " ", "\t", "! ", "\r\n"]))
        rows.append((doc_id, "".join(parts), rng.choice(["en", "de", None])))
    return rows + [(None, "new york city. new york", "en"), (5, None, None), (6, "", "en"), (7, rows[7][1], rows[7][2])]


def run(spark, rows, bits=64, top=phrases.TOP, chunk=phrases.CHUNK):
    docs = spark.createDataFrame([(*r, 1, "z", 3) for r in rows], SCHEMA)
    found = phrases.frequent_phrases(docs, bits=bits, chunk=chunk)
    return sorted(tuple(r) for r in phrases.collocations(found, top).collect())


@pytest.mark.parametrize("bits", [64, 7])
def test_as_plain_counting(spark, bits):
    """With 7-bit first fingerprints nearly every n-gram collides, and all are counted
    again by their words."""
    rows = corpus(random.Random(bits))
    assert run(spark, rows, bits) == brute(rows)


def test_top_per_language(spark):
    rows = corpus(random.Random(2))
    assert run(spark, rows, top=3) == brute(rows, top=3)


def test_frequent_counts_are_whole(spark):
    rows = corpus(random.Random(4))
    docs = spark.createDataFrame([(*r, 1, "z", 3) for r in rows], SCHEMA)
    got = {(r["lang"], r["phrase"]): r["f"] for r in phrases.frequent_phrases(docs).collect() if r["n"] > 0}
    f = defaultdict(Counter)
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for n in (1, 2, 3):
                for i in range(len(ws) - n + 1):
                    f[lang or "und"][" ".join(ws[i : i + n])] += 1
    assert got == {(lang, p): c for lang, fl in f.items() for p, c in fl.items() if c >= 10}


def test_long_text_in_chunks(spark):
    rows = corpus(random.Random(9))
    assert run(spark, rows, chunk=7) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_without_pruning(spark, monkeypatch):
    """Where the frequent words are too many to send, every n-gram gets fingerprints."""
    monkeypatch.setattr(phrases, "PRUNE_BYTES", 0)
    rows = corpus(random.Random(5))
    assert run(spark, rows) == brute(rows)


def test_triples_need_frequent_pairs():
    """Only triples whose pairs are both frequent make rows to shuffle, and these rows hold
    two longs."""
    text = "a b c. a b x"
    tokens = phrases.words_of(text.encode())
    hashes = phrases.word_hashes(tokens, "en")
    _, pairs = phrases.fingerprints(hashes, tokens.pieces, 2)

    def bits(of):
        out = np.zeros(common.BITMAP_BITS // 64, dtype=np.uint64)
        place = of >> np.uint64(64 - 27)
        np.bitwise_or.at(out, (place >> np.uint64(6)).astype(int), np.uint64(1) << (place & np.uint64(63)))
        return out

    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    for known, rows in ((pairs[:2], 1), (pairs[:1], 0), (pairs, 2)):
        frequent = phrases.Frequent(64, {1: bits(hashes), 2: bits(known)})
        out = list(phrases._count(iter([batch]), 3, frequent, 100))
        assert sum(b.num_rows for b in out) == rows
        assert all(b.schema.types == [pa.int64(), pa.int64()] for b in out)


def test_full_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "BITMAP_BITS", 128)
    rows = corpus(random.Random(11))
    assert run(spark, rows) == brute(rows)
