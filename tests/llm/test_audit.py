"""The filter audit against every order played out by brute force, and its defined cases."""

from __future__ import annotations

import random
import re
from itertools import permutations

from rowsieve.llm.audit import audit, masks

SCHEMA = "doc_id long, text string, lang string, _id long, _digest string, mask int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(doc_id, text, first):
    text = text or ""
    ws = WORD.findall(text)
    return {
        "A": len(ws) < 100,
        "B": 100 * len(set(ws)) < 80 * len(ws),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": doc_id is not None and first.get(text) is not None and first[text] < doc_id,
    }


def brute(rows, good, toxic):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            key = text or ""
            first[key] = min(first.get(key, doc_id), doc_id)
    docs = [(r[2] or "", r[0], fails(r[0], r[1], first)) for r in rows]
    out = []
    for part in sorted({d[0] for d in docs}):
        mine = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        table = []
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, start=1):
                gone = [d for d in left if d[2][f]]
                left = [d for d in left if not d[2][f]]
                shapley[f] += len(gone)
                table.append([
                    part, "".join(order), step, len(left), len(gone),
                    sum(d[2][f] for d in mine) - len(gone),
                    sum(d[2][f] and sum(d[2].values()) == 1 for d in mine),
                    sum(d[1] in good for d in gone), sum(d[1] in toxic for d in gone), f,
                ])
        out += [tuple(row[:-1] + [shapley[row[-1]]]) for row in table]
    return sorted(out)


def corpus(rng):
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for doc_id in range(60):
        n = rng.choice([5, 50, 120, 200])
        ws = rng.choices(vocab[: rng.choice([20, 300])], k=n)
        text = " ".join(ws)
        if doc_id % 7 == 0:
            text = text.upper()
        if doc_id % 11 == 0:
            text += " 50%"
        rows.append((doc_id, text, rng.choice(["en", "de", None])))
    rows += [(61, rows[3][1], "en"), (62, rows[3][1], "de"), (None, rows[4][1], "en")]
    rows += [(70, None, "en"), (71, "", "en"), (None, None, None), (72, rows[5][1], "en")] * 2
    return rows


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 9, "x", 5) for r in rows], SCHEMA)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in audit(masks(docs, frame)).collect())


def test_every_order_as_brute_force(spark):
    rng = random.Random(11)
    rows = corpus(rng)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 80, 3)] + [(3, 1, 1), (None, 1, 1)]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    got = run(spark, rows, labels)
    assert len(got) == 3 * 600
    assert got == brute(rows, good, toxic)


def test_shapley_sums_to_all_removed(spark):
    rows = corpus(random.Random(3))
    got = run(spark, rows, [])
    for part in {r[0] for r in got}:
        last = [r for r in got if r[0] == part and r[2] == 5 and r[1] == "ABCDE"][0]
        firsts = {r[1][0]: r[-1] for r in got if r[0] == part and r[2] == 1}
        removed = sum(r[4] for r in got if r[0] == part and r[1] == "ABCDE")
        assert sum(firsts.values()) == 120 * removed
        assert last[3] + removed == sum(1 for r in rows if (r[2] or "") == part)


def test_empty_table(spark):
    assert run(spark, [], []) == []


def test_null_text_fails_length_only(spark):
    got = run(spark, [(1, None, None)], [])
    assert {r[0] for r in got} == {""}
    assert all(r[6] == (1 if r[1][r[2] - 1] == "A" else 0) for r in got)
