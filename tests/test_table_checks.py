"""Table checks: aggregates over the table or a group, then a verdict per row."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rowsieve import Rule, register_table_check, split, validate, violations
from rowsieve.operators.checks import compile_checks
from rowsieve.operators.context import with_context

SCHEMA = "id long, team string, points double, __stat_1_total string, __group_0 int"


@pytest.fixture(scope="module", autouse=True)
def types():
    register_table_check(
        "above_team_mean",
        lambda value, dtype, params: {"mean": F.avg(value)},
        lambda value, dtype, params, stats: value > stats["mean"] * F.lit(params.get("factor", 1.0)),
    )
    register_table_check(
        "far_from_max",
        lambda value, dtype, params: {"top": F.max(value)},
        lambda value, dtype, params, stats: value < stats["top"] - F.lit(params["gap"]),
    )


def rows():
    """A hot team with a third of the rows, NULL teams and NULL points, clashing names."""
    rng = random.Random(7)
    out = []
    for i in range(300):
        team = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        points = None if i % 17 == 0 else float(rng.randint(0, 20))
        out.append((i, team, points, "x", 1))
    return out


def brute_team_mean(data, factor=1.0):
    sums, counts = defaultdict(float), defaultdict(int)
    for _, team, points, *_ in data:
        if points is not None:
            sums[team] += points
            counts[team] += 1
    failing = set()
    for i, team, points, *_ in data:
        mean = sums[team] / counts[team] if counts[team] else None
        if points is None or mean is None or not points <= mean * factor:
            failing.add(i)
    return failing


def team_rule(threshold=0.5, **params):
    return Rule(
        id="r1", name="above_mean", type="above_team_mean", column="points",
        threshold=threshold, params={"group_by": ["team"], **params},
    )


def test_grouped_counts_as_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    result = validate(df, [team_rule(factor=1.2)]).first()
    assert result["failed_count"] == len(brute_team_mean(data, 1.2))
    assert result["total_count"] == len(data)


def test_whole_table_statistics_become_literals(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    rule = Rule(id="r2", name="near_top", type="far_from_max", column="points", params={"gap": 5})
    checks = compile_checks(df, [rule])
    assert checks[0].context is None
    top = max(p for _, _, p, *_ in data if p is not None)
    failing = [i for i, _, p, *_ in data if p is None or p < top - 5]
    assert validate(df, [rule]).first()["failed_count"] == len(failing)


def test_shuffled_join_equals_broadcast(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    checks = compile_checks(df, [team_rule()])
    contexts = [check.context for check in checks]
    small = with_context(df, contexts)
    shuffled = with_context(df, contexts, broadcast_bytes=0)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in shuffled._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, shuffled.collect()))
    assert small.count() == df.count()


def test_split_and_violations_see_the_group(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    failing = brute_team_mean(data)
    parts = split(df, [team_rule(threshold=1.0)])
    assert {r["id"] for r in parts.quarantine.collect()} == failing
    assert parts.clean.columns == df.columns
    found = violations(df, [team_rule(threshold=1.0)], order_by=["id"])
    assert sorted(r["id"] for r in found.collect()) == sorted(failing)
    assert {r["reason"] for r in found.collect()} == {"[points] rule violated: above_mean"}


def test_empty_table_and_absent_group(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert validate(empty, [team_rule()]).first()["score"] == 1.0
    df = spark.createDataFrame(rows(), SCHEMA)
    rule = Rule(id="r3", name="by_nothing", type="above_team_mean", column="points",
                params={"group_by": "no_such_column"})
    assert validate(df, [rule]).first()["status"] == "skipped"


def test_two_rules_share_one_grouping(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    rules = [team_rule(), Rule(id="r4", name="mean_twice", type="above_team_mean",
                               column="points", params={"group_by": ["team"], "factor": 2.0})]
    checks = compile_checks(df, rules)
    assert checks[0].context is checks[1].context
    plan = validate(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") <= 3
