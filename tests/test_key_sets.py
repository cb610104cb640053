"""All uniqueness keys of a rule set counted in one scan."""

from __future__ import annotations

import random
from collections import Counter

from rowsieve import Rule, validate


def rules():
    return [
        Rule(id="a", name="a", type="uniqueness", column="a"),
        Rule(id="ab", name="ab", type="uniqueness", columns=("a", "b")),
        Rule(id="c", name="c", type="uniqueness", column="c"),
        Rule(id="ab2", name="ab2", type="uniqueness", columns=("a", "b"), threshold=0.1),
    ]


def data():
    """A hot value with a third of the rows, NULLs in every key, long texts."""
    rng = random.Random(3)
    return [
        (
            0 if i % 3 == 0 else rng.choice([None, *range(50)]),
            rng.choice([None, "x", "y" * 200]),
            rng.choice([None, 1.5, 2.5, float(i)]),
        )
        for i in range(400)
    ]


def repeated(rows, places):
    counts = Counter(tuple(row[p] for p in places) for row in rows)
    return sum(n - 1 for n in counts.values())


def test_counts_as_brute_force_in_one_scan(spark):
    rows = data()
    df = spark.createDataFrame(rows, "a int, b string, c double")
    result = validate(df, rules())
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
    assert "Expand" in plan
    got = {row["rule_id"]: row["failed_count"] for row in result.collect()}
    assert got == {
        "a": repeated(rows, [0]),
        "ab": repeated(rows, [0, 1]),
        "c": repeated(rows, [2]),
        "ab2": repeated(rows, [0, 1]),
    }


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string, c double")
    assert {row["score"] for row in validate(df, rules()).collect()} == {1.0}
