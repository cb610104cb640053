"""Class-based scoring against the whole method done again in plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

from rowsieve.llm import brown

SCHEMA = "doc_id long, text string, _row long, _tokens string, n long"
LOWER = str.maketrans(brown.UPPER, brown.LOWER)


def word_id(word: str) -> int:
    """Spark's xxhash64 of a string, unsigned."""
    return xxhash.xxh64_intdigest(word.encode(), seed=42)


def pmod(word: str, k: int) -> int:
    signed = word_id(word) - (1 << 64) if word_id(word) >= 1 << 63 else word_id(word)
    return signed % k


def xl(x):
    return x * math.log(x) if x > 0 else 0.0


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w] + [""]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def brute(rows, k, rounds, a=brown.SMOOTHING):
    pairs = Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            ts = tokens(text)
            pairs.update(zip([" "] + ts[:-1], ts))
    count = Counter()
    for (_, c), n in pairs.items():
        count[c] += n
    cls = {w: pmod(w, k) for w in count}
    for turn in range(rounds):
        follows, tot = Counter(), Counter()
        for (p, c), n in pairs.items():
            follows[(p, cls[c])] += n
        for w, n in count.items():
            tot[cls[w]] += n
        new = dict(cls)
        for w in count:
            if (word_id(w) >> 32) & 1 != turn % 2:
                continue
            now, own = cls[w], count[w]
            preds = [(p, n) for (p, c), n in pairs.items() if c == w]
            r = sum(xl(follows[(p, now)] - n) - xl(follows[(p, now)]) for p, n in preds)
            r -= xl(tot[now] - own) - xl(tot[now])
            gains = [
                (sum(xl(follows[(p, b)] + n) - xl(follows[(p, b)]) for p, n in preds) - (xl(tot[b] + own) - xl(tot[b])), -b)
                for b in range(k)
                if b != now
            ]
            g, b = max(gains)
            if r + g > brown.EPSILON:
                new[w] = -b
        cls = new
    total, members = Counter(), Counter()
    for w, n in count.items():
        total[cls[w]] += n
        members[cls[w]] += 1
    moves = Counter()
    for (p, c), n in pairs.items():
        moves[(k if p == " " else cls[p], cls[c])] += n
    out_of = Counter()
    for (c1, _), n in moves.items():
        out_of[c1] += n
    n_all, v_all = sum(count.values()), len(count)
    result = []
    for doc_id, text in rows:
        ts = tokens(text)
        base = score = 0.0
        for p, c in zip([" "] + ts[:-1], ts):
            c1 = k if p == " " else cls.get(p, pmod(p, k))
            c2 = cls.get(c, pmod(c, k))
            base += math.log10((count[c] + 0.5) / (n_all + 0.5 * (v_all + 1)))
            score += math.log10((moves[(c1, c2)] + a) / (out_of[c1] + a * k))
            score += math.log10((count[c] + a) / (total[c2] + a * (members[c2] + 1)))
        known = sum(count[t] > 0 for t in ts)
        result.append((doc_id, held(doc_id), len(ts), known, n_all, base, score))
    return sorted(result, key=repr)


def corpus(rng):
    nouns, verbs = ["Cat", "dog", "bird", "fish", "cow"], ["runs", "eats", "sees", "likes"]
    rows = []
    for doc_id in range(40):
        words = []
        for _ in range(rng.randint(1, 8)):
            words += [rng.choice(["the", "a"]), rng.choice(nouns), rng.choice(verbs)]
        rows.append((doc_id, " ".join(words)))
    return rows + [(None, "the cow runs"), (50, None), (51, ""), (52, "ZEBRA unknown\twords"), (3, rows[3][1])]


def run(spark, rows, monkeypatch, k, rounds):
    monkeypatch.setattr(brown, "CLASSES", k)
    monkeypatch.setattr(brown, "ROUNDS", rounds)
    frame = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA)
    got = brown.scores(frame, classes=k, rounds=rounds).collect()
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("k, rounds", [(4, 3), (8, 2)])
def test_scores_as_brute_force(spark, monkeypatch, k, rounds):
    rows = corpus(random.Random(k))
    got, want = run(spark, rows, monkeypatch, k, rounds), brute(rows, k, rounds)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)


def test_nothing_to_learn(spark, monkeypatch):
    rows = [(3, "only held out"), (5, None)]
    assert held(3) and held(5)
    got = run(spark, rows, monkeypatch, 4, 1)
    assert got == sorted(brute(rows, 4, 1), key=repr)
    assert all(r[4] == 0 for r in got)


def test_empty_table(spark, monkeypatch):
    assert run(spark, [], monkeypatch, 4, 1) == []


def test_a_round_weighs_only_words_that_may_move(spark):
    rows = [(word_id(a) % 2**62, word_id(b) % 2**62, 1) for a, b in ["ab", "bc", "ca", "cb"]]
    pairs = spark.createDataFrame(rows, "prev long, cur long, n long")
    words = sorted({cur for _, cur, _ in rows})
    assigned = spark.createDataFrame([(w, w % 4, 1, 0.0) for w in words], "word long, class int, count long, f double")
    moved = brown._round(pairs, assigned, brown._follows(pairs, assigned), 4, 0)
    # Bigrams of the other half of the words meet no class.
    lines = moved._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Filter" in line and "shiftrightunsigned(cur" in line for line in lines)
    assert sorted(row["word"] for row in moved.collect()) == words
