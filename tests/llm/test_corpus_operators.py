"""Corpus operators against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowsieve.llm import mixing, neighbours, packing, passages, pii, quality, suffixes, topk, urls
from rowsieve.llm.common import bitmap, passing, stored_at, table, word_count
from rowsieve.llm.minhash import near_duplicates, one_of_each, word_frequencies
from rowsieve.llm.queries import URL_RULES, word_tokenizer
from rowsieve.llm.sharding import admit, ring_shards
from rowsieve.llm.shingles import similarity, words_of

SCHEMA = "doc_id long, text string, lang string, source string, start string, size long"
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va".split()


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Odd rows in a corpus of a third equal texts, near copies, shared passages and edges."""
    rng = random.Random(5)
    base = words(rng, 160)
    passage = " ".join(words(rng, 90))
    out = []
    for at in range(90):
        if at % 3 == 0:
            text = " ".join(base)
        elif at % 3 == 1 and at % 2:
            own = list(base)
            own[rng.randrange(len(own))] = "changed" + str(at)
            text = " ".join(own)
        else:
            text = " ".join(words(rng, 70)) + ("\n" + passage if at % 5 == 0 else "")
        out.append((at, text, "xx", f"s{at % 4}", "begin", at))
    out += [
        (90, None, None, None, None, None),
        (91, "", "xx", None, "", 0),
        (92, " \n\t ", "", "s1", "x", 1),
        (93, "one two", "xx", "s1", "x", 1),
        (94, "one two", "xx", "s1", "x", 1),
        (95, "ab" * 3000, "xx", "s9", "x", 1),
        (96, " ".join(words(rng, 4000)), "xx", "s9", "x", 1),
        (None, "no key here", None, None, None, None),
        (97, "twice the same row " * 40, "xx", "s2", "x", 1),
        (97, "twice the same row " * 40, "xx", "s2", "x", 1),
        (97, "same key, other text", "xx", "s2", "x", 1),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_sharding_is_even_and_gapless(spark, docs, empty, rows):
    got = ring_shards(docs, "doc_id", 7, carry=["start", "size"]).collect()
    assert Counter(row.doc_id for row in got) == Counter(row[0] for row in rows)
    by_shard = defaultdict(list)
    for row in got:
        by_shard[row.shard].append(row.slot)
    counts = [len(slots) for slots in by_shard.values()]
    assert len(counts) == 7 and max(counts) - min(counts) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    again = ring_shards(docs.repartition(3), "doc_id", 7, carry=["start", "size"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert ring_shards(empty, "doc_id", 7).collect() == []


def test_one_more_shard_moves_few_keys(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    before, after = (ring_shards(df, "k", n, slack=0.2).withColumnRenamed("shard", f"s{n}") for n in (10, 11))
    moved = before.join(after, "k").filter("s10 <> s11").count()
    assert moved < 20_000 * 0.35
    loads = [row["count"] for row in before.groupBy("s10").count().collect()]
    assert max(loads) <= 2_400


def test_admission_sends_overflow_clockwise():
    assert admit([0, 1, 0, 1], [6, 0, 0, 2], 2, 0.0) == [
        (0, 0, 4, 0, 0), (3, 0, 2, 1, 0), (0, 4, 6, 1, 2),
    ]
    assert admit([0, 1], [0, 0], 2, 0.0) == []


def test_mixing_meets_targets(spark, docs, empty, rows):
    got = mixing.mix(docs, F.col("doc_id"), F.col("source"), word_count(), seed=3).rows.collect()
    assert Counter(row.key for row in got) == Counter(row[0] for row in rows)
    sizes, taken, target = Counter(), Counter(), {}
    for row in got:
        sizes[row.source] += row.size
        taken[row.source] += row.taken
        target[row.source] = row.target
        assert row.taken == row.size * len(row.draws) <= 2 * row.size
        assert all(0 <= shard < 16 for shard in row.draws)
    real = Counter()
    for row in rows:
        real[row[3]] += len(split_words(row[1]))
    assert sizes == real
    names = sorted(real, key=lambda name: (name is None, name))
    weight = {name: (5, 2, 1)[at % 3] for at, name in enumerate(names)}
    goal, room, free = dict.fromkeys(names, 0.0), 1.5 * sum(real.values()), set(names)
    while room > 1e-6 and free:
        share = room / sum(weight[name] for name in free)
        room = 0.0
        for name in sorted(free, key=str):
            goal[name] += share * weight[name]
            if goal[name] >= 2 * real[name]:
                room += goal[name] - 2 * real[name]
                goal[name] = 2.0 * real[name]
                free.discard(name)
    for name in names:
        assert target[name] == pytest.approx(goal[name])
        # What is left out does not fit, and rows stay whole.
        left_out = [row.size for row in got if row.source == name and 0 < row.size and row.taken < 2 * row.size]
        assert abs(taken[name] - goal[name]) <= min(left_out, default=1)
    again = mixing.mix(docs.repartition(2), F.col("doc_id"), F.col("source"), word_count(), seed=3)
    assert sorted(map(str, again.rows.collect())) == sorted(map(str, got))
    assert mixing.mix(empty, F.col("doc_id"), F.col("source"), word_count()).rows.collect() == []
    played = mixing.mixed_rows(docs, "source", word_count(), seed=3)
    assert played.columns == [*docs.columns, "mix_shard", "mix_turn"]
    assert played.count() == sum(len(row.draws) for row in mixing.mix(
        docs, F.xxhash64(*[F.col(c) for c in docs.columns], *[F.col(c).isNull() for c in docs.columns]),
        F.col("source"), word_count(), seed=3).rows.collect())


def test_mixing_fills_up_behind_very_long_rows(spark):
    data = [(100 * at + n, f"s{at}", 20_000 if n < 8 else 500 + n) for at in range(6) for n in range(68)]
    df = spark.createDataFrame(data, "k long, source string, size long")
    got = mixing.mix(df, F.col("k"), F.col("source"), F.col("size"), seed=1).rows.collect()
    assert Counter(row.key for row in got) == Counter(row[0] for row in data)
    for name in {row[1] for row in data}:
        own = [row for row in got if row.source == name]
        left_out = [row.size for row in own if row.taken < 2 * row.size]
        missing = round(own[0].target) - sum(row.taken for row in own)
        assert 0 <= missing < min(left_out, default=1)
        assert all(row.taken == row.size * len(row.draws) for row in own)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for at, digit in enumerate(map(int, reversed(digits))):
        total += digit if at % 2 == 0 else sum(divmod(2 * digit, 10))
    return total % 10 == 0


def base_spans(text):
    spans = []
    for at, (kind, pattern) in enumerate(PATTERNS.items()):
        for found in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", found[0])
            if {
                "email": True,
                "ip": kind != "ip" or all(int(part) < 256 for part in found[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]:
                spans.append((found.start(), at, found.end(), kind))
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))


def test_personal_data_base_spans(spark):
    rng = random.Random(2)
    texts = [
        None, "", "a@b.c_d@e.f x@y", "é ü me@mail.test, 1.2.3.4.5.6.7.8 and 999.1.1.1", "0255.000.1.1",
        "card 4111 1111 1111 1111 x 4111-1111-1111-1112", "+1 (743) 555-3824, +12  ", "1" * 5000,
        "+1" + " " * 3000, "a" * 20000 + "@", "4111111111111111 1.2.3.4", "++41 79 555 12 12..",
    ]
    alphabet = "1234567890.. --+@ab_é\n()"
    texts += ["".join(rng.choices(alphabet, k=rng.randint(5, 120))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {row.doc_id: row for row in pii.personal_data(df, "doc_id").collect()}
    for at, text in enumerate(texts):
        want = base_spans(text)
        assert got[at].base == want, text
        assert [got[at][f"n_{kind}"] for kind in PATTERNS] == [want.count(f"{kind}:") for kind in PATTERNS]
        assert set(filter(None, want.split(","))) <= set(got[at].spans.split(","))
    assert pii.personal_data(df.limit(0), "doc_id").collect() == []


def test_redaction(spark):
    texts = ["mail me@mail.test now", None, "none"]
    df = spark.createDataFrame([(at, text, "k") for at, text in enumerate(texts)], "id long, text string, kind string")
    got = pii.redacted(df)
    assert got.columns == df.columns
    assert [row.text for row in got.orderBy("id").collect()] == ["mail <email> now", None, "none"]


def test_boosted_trees_learn_a_conjunction():
    counts = []
    for form in (0, 1, 2):
        for digits in (0, 1, 2):
            code = ((form * 4 + digits) * 3 + 1) * 3
            counts += [(code, held, form == 1 and digits == 2, 50) for held in (False, True)]
    chosen = pii.selected_codes(counts)
    assert [pii.features_of(code)[1:3] for code in chosen] == [(1, 2)]
    assert pii.selected_codes([]) == []


DISGUISED = [
    ("phone", "0212 555 12 34"),
    ("phone", "0049 30 1234567"),
    ("email", "jane.doe [at] example [dot] com"),
    ("email", "jane.doe @ example.com"),
    ("ip", "10, 20, 30, 40"),
    ("card", "4111/1111/1111/1111"),
    ("card", "4111.1111.1111.1111"),
]
LOOK_ALIKES = ["15.01.2024", "v1.2.3", "$1,299.99", "4111.1111.1111.1112", "room 12, 14"]


def luhn_number(rng, length=16):
    digits = [rng.randint(0, 9) for _ in range(length - 1)]
    total = 0
    for at, digit in enumerate(reversed(digits)):
        doubled = digit * 2 if at % 2 == 0 else digit
        total += doubled - 9 if doubled > 9 else doubled
    return "".join(map(str, digits)) + str((10 - total % 10) % 10)


def disguised(rng, kind_at):
    """One of the seven disguised shapes, with its own digits or names."""
    name = "".join(rng.choices("abcdefghij", k=5))
    number = luhn_number(rng)
    return [
        ("phone", f"0212 555 {rng.randint(10, 99)} {rng.randint(10, 99)}"),
        ("phone", f"0049 30 {rng.randint(1000000, 9999999)}"),
        ("email", f"{name}.doe [at] example [dot] com"),
        ("email", f"{name}.doe @ example.com"),
        ("ip", ", ".join(str(rng.randint(1, 255)) for _ in range(4))),
        ("card", "/".join(number[at : at + 4] for at in range(0, 16, 4))),
        ("card", ".".join(number[at : at + 4] for at in range(0, 16, 4))),
    ][kind_at]


def test_disguised_forms_are_selected_and_look_alikes_not(spark):
    rng = random.Random(4)
    planted = [(at % 7, *(DISGUISED[at % 7] if at < 7 else disguised(rng, at % 7))) for at in range(700)]
    texts = [f"please write to {form} today, not {rng.choice(LOOK_ALIKES)} or later" for _, _, form in planted]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {row.doc_id: row.spans for row in pii.personal_data(df, "doc_id").collect()}
    for at, (text, (_, kind, form)) in enumerate(zip(texts, planted)):
        start = text.index(form)
        assert f"{kind}:{start}:{start + len(form)}" in got[at].split(","), text
        other = text.index(" not ") + 5
        assert not any(int(span.split(":")[1]) >= other for span in got[at].split(",") if span), text
    redacted = {row.doc_id: row.text for row in pii.redacted(df).collect()}
    assert all(form not in redacted[at] for at, (_, _, form) in enumerate(planted))


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [list(map(float, v)) for v in rng.normal(size=(500, 12))]
    vectors[7] = vectors[8] = vectors[300]
    vectors[9], vectors[20] = None, [float("nan")] * 12
    vectors[21], vectors[100] = [*vectors[0][:-1], None], [float("inf")] * 12
    data = [(at, v, "x") for at, v in enumerate(vectors)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    found = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 6)
    for row in found.orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.rank, row.vec_id, row.score))
    usable = {
        at: [int(np.floor(1024 * x)) for x in v]
        for at, v in enumerate(vectors)
        if v is not None and all(x is not None and np.isfinite(x) for x in v)
    }
    for query in (at for at in usable if at % 20 == 0):
        scores = [(-sum(a * b for a, b in zip(usable[query], v, strict=True)), at) for at, v in usable.items() if at != query]
        want = [(rank, at, -score) for rank, (score, at) in enumerate(sorted(scores)[:6], 1)]
        assert got.pop(query) == want
    assert not got
    few = topk.top_k(df.limit(3), "vec_id", "embedding", F.lit(True), 6)
    assert few.groupBy("query_id").count().select("count").distinct().collect() == [(2,)]
    assert topk.top_k(df.limit(0), "vec_id", "embedding", F.lit(True), 6).collect() == []


def shingles(text, least=1):
    own = (text or "").split()
    if not own or len(own) < least:
        return frozenset()
    return frozenset(tuple(own[at : at + 5]) for at in range(max(1, len(own) - 4)))


def classes_by_brute_force(sets):
    parent = {key: key for key in sets}

    def find(key):
        while parent[key] != key:
            key = parent[key]
        return key

    keys = sorted(sets)
    for at, a in enumerate(keys):
        for b in keys[:at]:
            union = len(sets[a] | sets[b])
            if union and len(sets[a] & sets[b]) >= 0.8 * union:
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {key: find(key) for key in keys}


def test_near_duplicates(spark, docs, empty, rows):
    keyed = docs.filter("doc_id is not null and doc_id <> 97")
    got = {row.doc_id: row for row in near_duplicates(keyed, "doc_id").collect()}
    want = classes_by_brute_force({row[0]: shingles(row[1]) for row in rows if row[0] not in (None, 97)})
    assert {key: row["class"] for key, row in got.items()} == want
    sizes = Counter(want.values())
    assert all(row.size == sizes[row["class"]] for row in got.values())
    assert near_duplicates(docs, "doc_id").count() == len(rows)
    assert near_duplicates(empty, "doc_id").collect() == []
    kept = one_of_each(docs, "doc_id")
    assert kept.columns == docs.columns
    ids = Counter(row.doc_id for row in kept.collect())
    assert ids == Counter([*{want[key] for key in want}, None, 97, 97])


def test_word_frequencies_count_every_document(spark):
    # Two tasks of 4,300 documents; in the first, "rare" stands in fewer than 1 of 4,096.
    rows = spark.range(0, 8600, 1, 2)
    rows = rows.selectExpr("if(id = 7 or id >= 8595, 'rare plain rare', 'plain') AS text")
    assert sorted(word_frequencies(rows, "text").toPandas()["df"]) == [6, 8600]


def test_finer_buckets_lose_no_similar_pair():
    rng = np.random.default_rng(5)
    least, base = 0.8, rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = []
    for _ in range(150):
        kept = base[rng.random(len(base)) > rng.choice([0.0, 0.03, 0.06, 0.2])]
        own = rng.integers(0, 2**63, rng.integers(0, 25)).astype(np.uint64)
        numbers = np.unique(np.concatenate([kept, own]))
        sets.append((numbers, (1 + 0.25 * (numbers % 7) / 7).astype(np.float32)))
    crowd = np.zeros(1 << neighbours.SLOT_BITS, np.int64)
    for numbers, _ in sets:
        crowd += np.bincount(neighbours.slots(numbers), minlength=len(crowd))
    cut = [neighbours.prefix(*one, crowd, least) for one in sets]
    alike = unlike = unmade = 0
    for a, b in combinations(range(len(sets)), 2):
        small_, large = sorted((a, b), key=lambda at: sets[at][1].sum())
        index = set(cut[small_][0][cut[small_][1]].tolist())
        apart = sum(
            int(one).bit_count()
            for one in (neighbours.parities(sets[a][0]) ^ neighbours.parities(sets[b][0])).view(np.uint64)
        ) * min(sets[a][1].min(), sets[b][1].min())
        weight = float(sets[a][1].sum()) + float(sets[b][1].sum())
        made = bool(index & set(cut[large][0].tolist())) and apart <= weight * (0.2 / 1.8 + 1e-5)
        if similarity(sets[a], sets[b]) >= least:
            alike += 1
            assert made
        else:
            unlike += 1
            unmade += not made
    assert alike > 100 and unmade > 0.8 * unlike


def test_template_texts_below_the_limit_make_few_pairs(spark, monkeypatch):
    rng = random.Random(11)
    base = words(rng, 150)
    texts = []
    for at in range(300):
        own = list(base)
        for place in rng.sample(range(0, 150, 5), 9):
            own[place] = f"x{at}y{place}"
        texts.append(" ".join(own))
    made = []
    compared = neighbours.compared

    def counted(pairs, *rest):
        made.append(pairs.count())
        return compared(pairs, *rest)

    monkeypatch.setattr(neighbours, "compared", counted)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # All share buckets, and all but a few pairs are less alike than the limit.
    found = near_duplicates(rows, "doc_id").toPandas()
    assert len(found) == 300
    assert sum(made) < 20 * 300


def test_near_duplicates_without_or_with_shared_keys(spark):
    rng = random.Random(12)
    bases = [words(rng, 150) for _ in range(4)]

    def near(base, at):
        return " ".join([*base[:at], "changed", *base[at + 1 :]])

    # Two classes have only NULL keys, two share a smallest key.
    data = [(None, near(bases[kind], at)) for kind in (0, 1) for at in (20, 70, 120)]
    data += [(key, near(bases[kind], at)) for kind in (2, 3) for key, at in ((7, 20), (7 + kind, 70))]
    data += [(None, " ".join(bases[2]))]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = near_duplicates(df, "doc_id").collect()
    assert Counter((row["class"], row.size) for row in got) == {(None, 3): 6, (7, 3): 3, (7, 2): 2}
    assert len({row.component for row in got}) == 4
    kept = one_of_each(df, "doc_id").collect()
    assert Counter(row.doc_id for row in kept) == {None: 2, 7: 2}
    assert len({max(range(4), key=lambda kind: len(set(bases[kind]) & set(row.text.split()))) for row in kept}) == 4


def test_quality_counts_and_verdicts(spark, docs, empty, rows):
    noisy = [(200, "!!% $$ ## " * 40, "xx", "s", "x", 1), (201, "a b c d e f g h i j k\na b\na b\n", "xx", "s", "x", 1)]
    df = docs.unionByName(spark.createDataFrame(noisy, SCHEMA))
    got = quality.judged(df, quality.references(df))
    assert got.columns[: len(df.columns)] == df.columns
    found = {(row.doc_id, row.text): row for row in got.collect()}
    for row in [*rows, *noisy]:
        own = found[row[0], row[1]]
        text = row[1] or ""
        spelled = split_words(text)
        lines = [line for line in text.split("\n") if split_words(line)]
        places = defaultdict(list)
        for at in range(len(spelled) - 4):
            places[tuple(spelled[at : at + 5])].append(at)
        repeated = {at + step for ats in places.values() if len(ats) > 1 for at in ats for step in range(5)}
        assert (own.n_words, own.word_chars, own.n_symbols) == (
            len(spelled), sum(map(len, spelled)), len(re.findall(r"[#*$%&|<>]", text)),
        )
        assert (own.n_dup_lines, own.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        failed = len(spelled) < 10 or 100 * len(repeated) > 20 * len(spelled)
        assert own.base_failed == failed and not (failed and own.kept)
    kept = quality.kept_documents(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(row.kept for row in got.collect())
    assert quality.kept_documents(empty).collect() == []


def test_distance_is_jensen_shannon(spark):
    df = spark.sql("select array(3, 1, 0) c, array(0.25D, 0.25D, 0.5D) q, array(1D, 0D, 0D) r, array(0, 5, 5) d")
    p, q = np.array([0.75, 0.25, 0]), np.array([0.25, 0.25, 0.5])
    m = (p + q) / 2
    parts = [x * np.log2(x / y) for a in (p, q) for x, y in zip(a, m, strict=True) if x > 0]
    row = df.select(quality.distance("c", "4", "q").alias("a"), quality.distance("d", "10", "r").alias("b")).first()
    assert row.a == pytest.approx(np.sqrt(sum(parts) / 2))
    assert row.b == pytest.approx(1)


def test_urls_by_rule_and_model(spark):
    rng = random.Random(4)
    data = [None, "", "nothing", "HTTP://A.Example.NET/en/x?y#z", "x://net", "x://b.org/fr/", "x://example.com/de/1", "x://a?/fr/"]
    for at in range(400):
        name = "".join(rng.choices("aeioulmn", k=6))
        data.append(f"http://{name}.example.org/fr/{name}" if at % 2 else f"http://cheap-pills-{at}.net/buy-{at}")
    data += ["http://cheap-pills-9.example.com/buy-9", "http://aloume.example.com/fr/nolimu"]
    df = spark.createDataFrame(list(enumerate(data)), "page_id long, url string")
    got = {row.page_id: row for row in urls.judged_urls(df, "page_id", "url", URL_RULES).collect()}
    assert len(got) == len(data)
    assert [(got[at].host, got[at].path, got[at].rule, got[at].verdict) for at in range(3, 8)][:4] == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"),
        ("net", "", None, got[4].verdict),
        ("b.org", "/fr/", "org/fr/", "allow"),
        ("example.com", "/de/1", "example.com/de/", "block"),
    ]
    assert (got[7].host, got[7].path) == ("a", "")
    assert all((got[at].host, got[at].path) == ("", "") for at in range(3))
    assert [got[len(data) - 2].verdict, got[len(data) - 1].verdict] == ["block", "allow"]
    assert urls.judged_urls(df.limit(0), "page_id", "url", URL_RULES).collect() == []


def test_model_spends_all_chance():
    model = urls.Model({"": (4, {"a": 3, "b": 1}), "a": (3, {"b": 2, urls.END: 1})})
    rest = 0x110000 - 3
    total = sum(model.chance("a", c) for c in ("a", "b", urls.END)) + rest * model.chance("a", "z")
    assert total == pytest.approx(1)


def test_packing(spark, docs, empty, rows):
    tokenizers = pytest.importorskip("tokenizers")
    path = word_tokenizer()
    own = tokenizers.Tokenizer.from_file(path)
    packed = packing.pack(docs, "doc_id", "text", path)
    got = packed.collect()
    pieces = Counter((row.doc_id, row.piece, row.start, bytes(row.ids)) for row in got)
    want = Counter()
    for row in rows:
        ids = np.array([*own.encode(row[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            want[row[0], piece, start, ids[start : start + 2048].tobytes()] += 1
    assert pieces == want
    bins = defaultdict(list)
    for row in got:
        assert row.length == len(row.ids) // 4
        bins[row.sequence_id].append((row.offset, row.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(row.length for row in got) // 2048) + 1
    whole = packing.sequences(packed).collect()
    assert sum(len(row.ids) for row in whole) == sum(len(row.ids) for row in got)
    assert packing.pack(empty, "doc_id", "text", path).collect() == []


def test_words_keep_their_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(word_tokenizer())
    tokens = packing.WordTokens(word_tokenizer())
    odd = ["Word,", "don't", "A.B", "x1", "ÉÀ!", "ﬁn", "Straße.", "..", "0", "word0", "İx", "a" * 70, "<|endoftext|>", "I'm,"]
    for word, ids in zip(odd, tokens.of(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode(word, add_special_tokens=False).ids, word


def test_words_are_remembered_across_tasks():
    path = word_tokenizer()
    assert packing._word_tokens(path) is packing._word_tokens(path)


def test_sum_of_squares_prefers_rare_gaps():
    sequence, offset, made = packing.place_all(np.array([6, 6, 4, 4, 2]), 10)
    assert made == 3 and sorted(offset.tolist()) == [0, 0, 0, 6, 6]
    sizes = np.random.default_rng(0).integers(1, 2048, 4000)
    *_, made = packing.place_all(sizes, 2048)
    assert made <= max(sizes.sum() / 2048, (sizes > 1024).sum()) * 1.02


def suffix_brute_force(texts, length):
    seen = Counter()
    for data in texts:
        seen.update(data[at : at + length] for at in range(len(data) - length + 1))
    out = []
    for data in texts:
        gone = np.zeros(len(data) + 2, dtype=bool)
        for at in range(len(data) - length + 1):
            if seen[data[at : at + length]] > 1:
                gone[at + 1 : at + 1 + length] = True
        kept = bytes(byte for byte, out_ in zip(data, gone[1:], strict=False) if not out_)
        spans = int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffixes_against_brute_force(spark, docs, empty, rows):
    got = Counter(tuple(row)[:5] for row in suffixes.without_repeats(docs, "doc_id").collect())
    texts = [(row[1] or "").encode() for row in rows]
    want = suffix_brute_force(texts, 400)
    assert got == Counter((row[0], *own) for row, own in zip(rows, want, strict=True))
    assert suffixes.without_repeats(empty, "doc_id").collect() == []


def test_suffixes_of_shuffled_pieces(spark):
    rng = random.Random(11)
    pool = ["".join(rng.choices("ab cé", k=rng.randint(50, 700))) for _ in range(12)]
    texts = ["".join(rng.choices(pool, k=rng.randint(1, 4))) + str(at % 3) for at in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = [tuple(row)[1:5] for row in suffixes.without_repeats(df, "doc_id").orderBy("doc_id").collect()]
    assert got == suffix_brute_force([text.encode() for text in texts], 400)


def test_passages(spark, docs, empty, rows):
    keyed = docs.filter("doc_id is not null and doc_id <> 97")
    got = {(row.doc_id, row.place): row for row in passages.repeated_passages(keyed, "doc_id").collect()}
    sets = {
        (row[0], at): shingles(line, passages.LEAST_WORDS)
        for row in rows
        if row[0] not in (None, 97)
        for at, line in enumerate((row[1] or "").split("\n"))
    }
    want = classes_by_brute_force({key: own for key, own in sets.items() if own})
    sizes = Counter(want.values())
    want = {key: own for key, own in want.items() if sizes[own] > 1}
    assert {key: (row.class_key, row.class_place) for key, row in got.items()} == want
    assert all(row.removed == (key != (row.class_key, row.class_place)) for key, row in got.items())
    left = passages.without_repeats(docs, "doc_id")
    assert left.columns == docs.columns and left.count() == len(rows)
    assert passages.repeated_passages(empty, "doc_id").collect() == []
    assert passages.tuned_bands(0.8) == 10


def test_passages_wrapped_and_embedded(spark):
    rng = random.Random(8)
    passage, short = words(rng, 60), " ".join(words(rng, 8))

    def wrapped(own, width):
        return "\n".join(" ".join(own[at : at + width]) for at in range(0, len(own), width))

    texts = [
        wrapped([*words(rng, 3), *passage, *words(rng, 5)], 8),
        wrapped([*words(rng, 7), *passage], 13),
        " ".join([*words(rng, 100), *passage, *words(rng, 100)]),
        short + "\n" + " ".join(words(rng, 30)),
        " ".join(words(rng, 40)) + "\n" + short,
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = passages.repeated_passages(df, "doc_id").collect()
    units = [row for row in got if row.first_word is not None]
    assert {row.doc_id for row in units} == {0, 1, 2}
    assert all(row.class_key == 0 and row.removed == (row.doc_id != 0) for row in units)
    assert all(0 <= row.first_word - {0: 3, 1: 7, 2: 100}[row.doc_id] <= 40 for row in units)
    assert {(row.doc_id, row.place, row.removed) for row in got if row.first_word is None} == {
        (3, 0, False), (4, 1, True),
    }
    left = {row.doc_id: row.text for row in passages.without_repeats(df, "doc_id").collect()}
    assert [left[0], left[3], left[5]] == [texts[0], texts[3], None]
    assert left[4] == texts[4].split("\n")[0]
    for at in (1, 2):
        assert len(set(passage) & set(left[at].split())) < 20
        assert left[at].split()[0] == texts[at].split()[0]


def test_unit_counts_are_those_of_the_units(spark):
    rng = random.Random(3)
    shared = words(rng, 60)
    texts = [" ".join(words(rng, 40) + shared + words(rng, 9)).replace(" ", "\n", at) for at in range(5)]
    texts += [None, "", "few words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = Counter(row["a"] for row in passages.units(rows, "doc_id", "text").collect())
    found = passages.unit_counts(rows, "text").groupBy("a").agg(F.sum("n").alias("n")).collect()
    assert {row["a"]: row["n"] for row in found} == every
    assert max(every.values()) == 5


def test_units_that_stand_once_are_not_shuffled(spark):
    rng = random.Random(4)
    shared = words(rng, 60)
    texts = [" ".join(words(rng, 300) + shared * (at < 2) + words(rng, 300)) for at in range(5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = passages.units(rows, "doc_id", "text").collect()
    times = Counter(row["a"] for row in every)
    several = spark.createDataFrame([(a,) for a, n in times.items() if n > 1], "a long")
    found = passages.units(rows, "doc_id", "text", bitmap(several, "a")).collect()
    assert sorted(found) == sorted(row for row in every if times[row["a"]] > 1)
    assert 0 < len(found) < len(every) / 4


def test_lines_of_units_are_found_among_many(spark):
    """Units beyond the first 64 lines, some of them in lines that are removed."""
    rng = random.Random(6)
    lines = [" ".join(words(rng, 25)) for _ in range(150)]
    texts = ["\n".join(lines), "\n".join([" ".join(words(rng, 6)), *lines[70:]])]
    rows = spark.createDataFrame([*enumerate(texts), (None, texts[1])], "doc_id long, text string")
    gone = passages.removed_lines(
        spark.createDataFrame(
            [(d, hash_of, at) for d, hash_of, ats in ((0, 5, [0, 63, 64, 149]), (None, 6, [1])) for at in ats],
            "doc long, whole long, place int",
        )
    )
    want = {(0, 5): {0, 63, 64, 149}, (None, 6): {1}}
    for row in gone.collect():
        found = {64 * at + bit for at, own in enumerate(row.bits) for bit in range(64) if own >> bit & 1}
        assert found == want.pop((row.doc, row.whole))
    assert not want
    got = passages.repeated_passages(rows, "doc_id").collect()
    removed = {(row.doc_id, row.place) for row in got if row.first_word is None and row.removed}
    assert removed == {(1, at) for at in range(1, 81)} | {(None, at) for at in range(81)}
    # A unit inside a removed line is left out; those across two lines are inside removed ones too.
    units = [row for row in got if row.first_word is not None]
    assert all((row.doc_id, row.place) not in removed for row in units)


def test_passing_tables_are_deleted(spark):
    rows = spark.range(5)
    with passing(spark) as keep:
        gone = stored_at(rows)[1]
        left = keep(rows)
    assert left.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(gone)


def test_shared_words_share_a_unit():
    rng = random.Random(3)
    run = words(rng, passages.UNIT_WORDS + passages.WINDOW - 1)
    hashed = []
    for at in range(30):
        texts = pa.array([" ".join(words(rng, at)), " ".join([*words(rng, at), *run, *words(rng, 30 - at)])])
        hashed.append(set(passages.unit_places(words_of(texts))[1].tolist()))
    assert set.intersection(*hashed)


def test_documents_table_is_read(spark):
    assert table(spark, "/root/testdata/sf0.001", "documents").count() == 200
