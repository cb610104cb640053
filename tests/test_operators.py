"""Operators on small tables with known answers, against brute force, and their plans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rowsieve import (
    Rule,
    RuleError,
    blocking_failures,
    default_rules,
    duplicate_rows,
    profile,
    register_check,
    rules_from_entries,
    rules_from_form,
    run,
    split,
    summarise,
    validate,
    violations,
    with_pass_rate,
)
from rowsieve.operators.duplicates import (
    Duplicates,
    count_duplicates,
    fits_broadcast,
    mark_duplicates,
)
from rowsieve.operators.validate import CHECKS_PER_SCAN, RESULT_SCHEMA


def rule(kind, column=None, **parts):
    return Rule(id="r", name="r", type=kind, column=column, **parts)


def valid(column, validator, threshold=1.0, severity="error", **params):
    return rule(
        "validity", column, validator=validator, params=params, threshold=threshold, severity=severity
    )


def only(df, rule_, **options):
    rows = validate(df, [rule_], **options).collect()
    assert len(rows) == 1
    return rows[0]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def emails(spark):
    rows = [(1, "a@x.org"), (2, None), (3, "  "), (4, None), (5, "e@x.org")]
    return spark.createDataFrame(rows, "id long, email string")


EMAIL = r"[a-z]+@[a-z]+(\.[a-z]+)+"


@pytest.mark.parametrize(
    ("schema", "values", "rule_", "failed", "score", "status"),
    [
        ("v string", ["a", None, "  ", None, "e"], rule("completeness", "v"), 3, 0.4, "failed"),
        ("v string", ["a"] * 9 + [None], rule("completeness", "v", threshold=0.8), 1, 0.9, "passed"),
        ("v string", ["Alice", "   ", ""], rule("completeness", "v"), 2, 1 / 3, "failed"),
        ("v string", ["\t", " ", "　", "x"], rule("completeness", "v"), 3, 0.25, "failed"),
        ("v string", [], rule("completeness", "v"), 0, 1.0, "passed"),
        ("v long", [], rule("uniqueness", "v", threshold=1.0), 0, 1.0, "passed"),
        ("v string", [], valid("v", "regex", pattern="a"), 0, 1.0, "passed"),
        ("v long", [1, 2, 3], rule("uniqueness", "v", threshold=1.0), 0, 1.0, "passed"),
        ("v long", [1, 2, 2, 3, 1], rule("uniqueness", "v", threshold=1.0), 2, 0.6, "failed"),
        ("v long", [1, 1, 1], rule("uniqueness", "v", threshold=1.0), 2, 1 / 3, "failed"),
        ("v long", [None, None, None, 1], rule("uniqueness", "v"), 2, 0.5, "failed"),
        ("v string", ["", None, "", "x" * 99, "x" * 99], rule("uniqueness", "v"), 2, 0.6, "failed"),
        (
            "v string",
            ["active", "inactive", "UNKNOWN", "pending", "deleted"],
            valid("v", "enum", allowed_values=["active", "inactive", "pending"]),
            2,
            0.6,
            "failed",
        ),
        ("v string", ["1", "2"], valid("v", "enum", allowed_values=[1, 2]), 2, 0.0, "failed"),
        ("v string", ["v@t.com", "not-mail", None], valid("v", "regex", pattern=EMAIL), 2, 1 / 3, "failed"),
        ("v string", ["a\n"], valid("v", "regex", pattern="^a$"), 1, 0.0, "failed"),
        ("v long", [18, 35, 99], valid("v", "range", min_value=0, max_value=150), 0, 1.0, "passed"),
        ("v long", [25, -5, 200], valid("v", "range", min_value=0, max_value=150), 2, 1 / 3, "failed"),
        ("v string", ["nan", "x", "7"], valid("v", "range", min_value=9), 2, 1 / 3, "failed"),
        ("v string", ["1", "abc", None], valid("v", "dtype", expected_type="int"), 2, 1 / 3, "failed"),
        ("v string", [" 7 ", "+5", "1_000", "1.5"], valid("v", "dtype", expected_type="int"), 1, 0.75, "failed"),
    ],
)
def test_single_rules(spark, schema, values, rule_, failed, score, status):
    row = only(spark.createDataFrame([(value,) for value in values], schema), rule_)
    assert (row.failed_count, row.total_count, row.status) == (failed, len(values), status)
    assert row.score == pytest.approx(score)


def test_composite_key(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1)], "a long, b long")
    row = only(df, rule("uniqueness", columns=("a", "b"), threshold=1.0))
    assert (row.failed_count, row.total_count, row.column) == (1, 4, None)


def test_skip_names_the_first_absent_column(emails):
    row = only(emails, rule("uniqueness", columns=("id", "nope", "neither"), severity="info"))
    assert (row.status, row.column, row.score, row.total_count) == ("skipped", "nope", 0.0, 0)
    assert "nope" in row.message


def test_thresholds(emails):
    assert only(emails, rule("completeness", "email", threshold=0.4)).status == "passed"
    assert only(emails, rule("completeness", "email")).threshold == 0.95
    assert only(emails, rule("completeness", "email"), default_threshold=0.3).status == "passed"
    assert only(emails, rule("completeness", "email", threshold=0.5), default_threshold=0.1).status == "failed"


def test_results_keep_rule_order_and_schema(emails):
    rules = [
        Rule("a", "first", "uniqueness", column="id", threshold=1.0),
        Rule("b", "second", "completeness", "warning", column="absent"),
        Rule("c", "third", "completeness", "info", column="email"),
        Rule("d", "fourth", "uniqueness", column="id", threshold=0.5),
    ]
    results = validate(emails, rules)
    assert results.schema.simpleString() == f"struct<{RESULT_SCHEMA.replace(' ', ':').replace(',:', ',')}>"
    rows = results.collect()
    assert [(row.rule_position, row.rule_id, row.rule_name, row.severity) for row in rows] == [
        (1, "a", "first", "error"),
        (2, "b", "second", "warning"),
        (3, "c", "third", "info"),
        (4, "d", "fourth", "error"),
    ]


def test_no_rules_pass_vacuously(emails):
    summary = summarise(validate(emails, [])).first()
    assert (summary.overall_status, summary.overall_score, summary.total_rules) == ("passed", 1.0, 0)


def test_report_counts_skipped_scores_but_never_blocks(emails):
    rules = [
        rule("completeness", "id", threshold=1.0),
        rule("completeness", "absent"),
        rule("completeness", "email", severity="warning"),
    ]
    results = validate(emails, rules)
    summary = summarise(results).first()
    assert summary.overall_status == "passed"
    assert summary.overall_score == pytest.approx((1.0 + 0.0 + 0.4) / 3)
    assert (summary.total_rules, summary.passed_rules, summary.failed_rules, summary.skipped_rules) == (3, 1, 1, 1)
    assert blocking_failures(results).count() == 0
    rates = [row.pass_rate for row in with_pass_rate(results).collect()]
    assert rates == [1.0, 1.0, 0.4]


def test_failed_error_rule_blocks(emails):
    results = validate(emails, [rule("completeness", "email"), rule("completeness", "id")])
    assert summarise(results).first().overall_status == "failed"
    assert [row.column for row in blocking_failures(results).collect()] == ["email"]


@pytest.mark.parametrize(
    "make",
    [
        lambda: Rule("r", "r", "completeness"),
        lambda: Rule("r", "r", "completeness", column="a", threshold=1.5),
        lambda: rules_from_entries([{"id": "r", "type": "completeness"}]),
        lambda: rules_from_entries([{"id": "r", "name": "r", "type": "shape", "column": "a"}]),
    ],
)
def test_bad_rules(make):
    with pytest.raises(RuleError):
        make()


@pytest.mark.parametrize(
    "bad",
    [
        rule("validity", "email"),
        valid("email", "no_such_validator"),
        valid("email", "regex", pattern="("),
        valid("email", "regex", pattern="(a)?(?(1)b)"),
        valid("email", "range", min_value=None),
        rule("completeness", columns=("email",)),
        rule("no_such_type", "email"),
    ],
)
def test_unusable_rules_stop_before_the_job(emails, bad):
    with pytest.raises(RuleError):
        validate(emails, [bad])


def test_entries_are_normalised():
    with pytest.warns(UserWarning, match="severity"):
        made = rules_from_entries(
            [
                {
                    "id": 7,
                    "name": "n",
                    "type": "VALIDITY",
                    "severity": "fatal",
                    "columns": ["a", "b"],
                    "validator_type": "enum",
                    "params": None,
                    "threshold": "0.5",
                }
            ]
        )
    assert made == [Rule("7", "n", "validity", "error", None, ("a", "b"), 0.5, "enum", {})]


def test_form_defaults_and_unknown_types():
    with pytest.warns(UserWarning, match="dropped"):
        made = rules_from_form([{"column": "a"}, {"column": "b", "type": "shape"}])
    assert made == [Rule("ui_001", "a_tamlık", "completeness", "warning", "a", threshold=0.80)]


def test_default_rules(spark):
    df = spark.createDataFrame([(1, "x", None)], "User_ID long, city string, Barcode string")
    assert [(made.id, made.column, made.type, made.severity) for made in default_rules(df)] == [
        ("auto_001_c", "User_ID", "completeness", "warning"),
        ("auto_001_u", "User_ID", "uniqueness", "error"),
        ("auto_002_c", "city", "completeness", "warning"),
        ("auto_003_c", "Barcode", "completeness", "warning"),
        ("auto_003_u", "Barcode", "uniqueness", "error"),
    ]


def test_custom_check(spark):
    register_check("even", lambda value, dtype, params: value % 2 != 0)
    df = spark.createDataFrame([(1,), (2,), (None,), (4,)], "v long")
    row = only(df, rule("even", "v"))
    assert (row.failed_count, row.total_count, row.rule_type) == (2, 4, "even")
    made = rules_from_entries([{"id": "r", "name": "r", "type": "Even", "column": "v"}])
    held = split(df, made).quarantine
    assert sorted(row.violation_reasons for row in held.collect()) == ["[v] rule violated: r"] * 2
    with pytest.raises(RuleError):
        register_check("validity", lambda value, dtype, params: value)


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x"), (1, None)], "`a.b` long, `c d``e` string")
    rules = [rule("uniqueness", "a.b"), rule("completeness", "c d`e")]
    assert [row.failed_count for row in validate(df, rules).collect()] == [1, 1]
    parts = split(df.withColumn("o", F.monotonically_increasing_id()), rules, order_by=["o"])
    assert parts.quarantine.count() == 1


def test_complex_columns_take_completeness_only(spark):
    df = spark.createDataFrame([([1.0],), (None,)], "v array<double>")
    assert only(df, rule("completeness", "v")).failed_count == 1
    with pytest.raises(RuleError):
        validate(df, [rule("uniqueness", "v")])


def test_many_rules_take_several_aggregates(spark):
    df = spark.createDataFrame([(value,) for value in range(10)], "v long")
    rules = [valid("v", "range", min_value=low) for low in range(CHECKS_PER_SCAN * 2 + 5)]
    got = [row.failed_count for row in validate(df, rules).collect()]
    assert got == [min(low, 10) for low in range(len(rules))]


# --- split and violations -----------------------------------------------------------


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Ahmet", 25), (2, None, 30), (3, "Mehmet", -5), (4, "Can", 40)]
    return spark.createDataFrame(rows, "id long, name string, age long")


PEOPLE_RULES = [
    rule("completeness", "name", threshold=1.0),
    valid("age", "range", 1.0, "warning", min_value=0),
]


def ids(df):
    return sorted(row.id for row in df.select("id").collect())


def test_split_keeps_clean_rows_and_gives_reasons(people):
    parts = split(people, PEOPLE_RULES)
    assert ids(parts.clean) == [1, 4]
    assert parts.clean.columns == people.columns
    reasons = {row.id: row.violation_reasons for row in parts.quarantine.collect()}
    assert reasons == {2: "[name] missing value (blank)", 3: "[age] invalid value ('-5')"}
    assert tuple(parts.counts().first()) == (4, 2, 2)


def test_quarantine_can_be_split_again(people):
    held = split(people, PEOPLE_RULES).quarantine
    parts = split(held, PEOPLE_RULES[:1])
    assert parts.quarantine.columns == [*people.columns, "violation_reasons"]
    assert ids(parts.quarantine) == [2]
    assert parts.clean.first().violation_reasons == "[age] invalid value ('-5')"
    assert parts.tagged.columns == [*people.columns, "sieve_outcome", "violation_reasons"]


def test_violations_in_row_order(spark):
    df = spark.createDataFrame([(3, None), (1, ""), (2, "x"), (4, None)], "o long, v string")
    rules = [valid("v", "regex", pattern="[a-w]*"), rule("completeness", "v")]
    listed = violations(df.repartition(3), rules, ["o"], in_row_order=True).collect()
    assert [(row.o, row.rule_position) for row in listed] == [
        (1, 2), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2),
    ]


def test_violations_of_skipped_rules_are_an_empty_table(people):
    listed = violations(people, [rule("completeness", "absent")], ["id"])
    full = violations(people, PEOPLE_RULES, ["id"])
    assert listed.collect() == []
    assert listed.dtypes == full.dtypes


def test_split_in_other_words(people):
    words = {
        "completeness": "{column} fehlt ({value})",
        "uniqueness": "{column} doppelt ({value})",
        "validity": "{column} falsch ({value})",
        "other": "{rule}",
        "blank": "leer",
    }
    held = split(people, PEOPLE_RULES, labels=words).quarantine
    reasons = {row.id: row.violation_reasons for row in held.collect()}
    assert reasons == {
        2: "name fehlt (leer)",
        3: "age falsch ('-5')",
    }


@pytest.mark.parametrize(
    ("threshold", "severity", "held"),
    [(1.0, "error", [2]), (0.5, "error", [2]), (1.0, "warning", [2]), (0.5, "warning", [])],
)
def test_quarantine_takes_failed_or_error_rules(people, threshold, severity, held):
    rules = [rule("completeness", "name", threshold=threshold, severity=severity)]
    assert ids(split(people, rules).quarantine) == held


def test_several_reasons_keep_rule_order(spark):
    df = spark.createDataFrame([(1, "", -1), (2, "b", 5)], "id long, name string, age long")
    rules = [PEOPLE_RULES[1], PEOPLE_RULES[0]]
    assert split(df, rules).quarantine.first().violation_reasons == (
        "[age] invalid value ('-1') | [name] missing value (blank)"
    )


def test_composite_reason_names_the_keys(spark):
    df = spark.createDataFrame([(1, 7, "x"), (2, 7, "x"), (3, 7, None)], "id long, a long, b string")
    held = split(df, [rule("uniqueness", columns=("a", "b"))], order_by=["id"]).quarantine
    assert [(row.id, row.violation_reasons) for row in held.collect()] == [
        (2, "[a, b] duplicate record ('7', 'x')")
    ]


def test_row_order_must_be_known(people):
    df = people.unionByName(people)
    with pytest.raises(ValueError, match="order_by"):
        split(df, [rule("uniqueness", "id")])
    assert ids(split(df, PEOPLE_RULES).clean) == [1, 1, 4, 4]


def test_parquet_rows_have_an_order(spark, people, tmp_path):
    path = str(tmp_path / "people")
    people.unionByName(people).coalesce(1).write.parquet(path)
    stored = spark.read.parquet(path)
    parts = split(stored, [rule("uniqueness", "id")])
    assert ids(parts.quarantine) == [1, 2, 3, 4]
    assert parts.quarantine.columns == [*people.columns, "violation_reasons"]
    assert [row["__row_index"] for row in violations(stored, [rule("uniqueness", "id")]).collect()] == [4, 5, 6, 7]


def random_table(spark, rows=4000, seed=3):
    """A third of all rows share one key, some keys are NULL, the rest repeat now and then."""
    rng = random.Random(seed)
    data = []
    for place in range(rows):
        hot = place % 3 == 0
        text = "hot" * 40 if hot else (None if rng.random() < 0.05 else f"k{rng.randrange(rows)}")
        number = 1 if hot else rng.randrange(50)
        value = None if rng.random() < 0.05 else rng.uniform(-10, 110)
        data.append((place * 7919 % rows, text, number, value))
    schema = "o long, text string, number int, value double"
    return data, spark.createDataFrame(data, schema).repartition(8)


def brute_duplicates(data, key):
    seen, repeated = set(), set()
    for row in sorted(data):
        if key(row) in seen:
            repeated.add(row[0])
        seen.add(key(row))
    return repeated


@pytest.mark.parametrize("order", [["o"], ["o", "number"]])
@pytest.mark.parametrize("limit", [0, 1 << 30])
@pytest.mark.parametrize(
    ("keys", "key"),
    [
        (("text",), lambda row: row[1]),
        (("number",), lambda row: row[2]),
        (("text", "number"), lambda row: (row[1], row[2])),
    ],
)
def test_duplicates_against_brute_force(spark, order, limit, keys, key):
    data, df = random_table(spark)
    expected = brute_duplicates(data, key)
    got = duplicate_rows(df, keys, order, broadcast_bytes=limit)
    assert sorted(row.o for row in got.collect()) == sorted(expected)
    assert got.columns == df.columns
    assert only(df, rule("uniqueness", columns=keys)).failed_count == len(expected)


def test_descending_data_keeps_the_first_by_order(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "a")], "o long, k string")
    for limit in (0, 1 << 20):
        assert [row.o for row in duplicate_rows(df, ["k"], ["o"], limit).orderBy("o").collect()] == [2, 3]


RANDOM_RULES = [
    Rule("unique", "unique", "uniqueness", column="text", threshold=0.1),
    Rule("pair", "pair", "uniqueness", "warning", columns=("text", "number"), threshold=1.0),
    Rule("value", "value", "completeness", column="value", threshold=0.5),
    valid("value", "range", 0.99, "warning", min_value=0, max_value=100),
    valid("number", "enum", 0.0, "warning", allowed_values=[1, 2]),
    Rule("absent", "absent", "completeness", column="absent"),
]


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_split_and_violations_against_brute_force(spark, limit):
    data, df = random_table(spark)
    broken = {
        1: brute_duplicates(data, lambda row: row[1]),
        2: brute_duplicates(data, lambda row: (row[1], row[2])),
        3: {row[0] for row in data if row[3] is None},
        4: {row[0] for row in data if row[3] is None or not 0 <= row[3] <= 100},
        5: {row[0] for row in data if row[2] not in (1, 2)},
    }
    listed = violations(df, RANDOM_RULES, ["o"], broadcast_bytes=limit)
    got = {(row.o, row.rule_position) for row in listed.collect()}
    assert got == {(o, position) for position, rows in broken.items() for o in rows}
    assert listed.count() == len(got)
    results = validate(df, RANDOM_RULES).collect()
    again = violations(df, RANDOM_RULES, ["o"], results, broadcast_bytes=limit)
    assert sorted(again.collect()) == sorted(listed.collect())
    assert {row.rule_position: row.failed_count for row in results if row.status != "skipped"} == {
        position: len(rows) for position, rows in broken.items()
    }
    # Rule 5 passes as a warning, so it holds nothing back.
    held = broken[1] | broken[2] | broken[3] | broken[4]
    parts = split(df, RANDOM_RULES, results, ["o"], broadcast_bytes=limit)
    assert {row.o for row in parts.quarantine.collect()} == held
    assert {row.o for row in parts.clean.collect()} == {row[0] for row in data} - held
    assert parts.clean.count() + parts.quarantine.count() == len(data)
    assert tuple(parts.counts().first()) == (len(data), len(data) - len(held), len(held))
    for row in parts.tagged.select("o", "sieve_outcome", "violation_reasons").collect():
        assert (row.sieve_outcome == "quarantine") == (row.o in held)
        count = sum(row.o in broken[position] for position in (1, 2, 3, 4))
        assert (row.violation_reasons or "").count("[") == count


def test_results_do_not_depend_on_partitioning(spark):
    _, df = random_table(spark)
    whole = validate(df.coalesce(1), RANDOM_RULES).collect()
    assert validate(df.repartition(13), RANDOM_RULES).collect() == whole
    assert validate(df.repartition(5, "number"), RANDOM_RULES).collect() == whole


def test_result_bounds(spark):
    _, df = random_table(spark)
    for row in validate(df, RANDOM_RULES).collect():
        assert 0 <= row.score <= 1
        assert 0 <= row.failed_count <= row.total_count


def test_unordered_ties_never_multiply_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b")], "o long, k string")
    for limit in (0, 1 << 20):
        marked = mark_duplicates(df, ("k",), ["o"], "dup", Duplicates(2), limit)
        assert marked.count() == 4


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("order", [["o"], ["k"], ["n"], ["n", "o"], ["k", "n"]])
def test_ties_and_nulls_in_row_order_lose_no_duplicate(spark, tmp_path, order, limit):
    rows = [(1, "a", None), (1, "b", None), (2, "a", None), (2, "a", 5), (3, None, 5), (3, None, 5), (3, "d", 1)]
    df = spark.createDataFrame(rows, "o long, k string, n long")
    df.write.parquet(str(tmp_path / "t"))
    rules = [rule("uniqueness", "k", threshold=1.0), rule("uniqueness", "n")]
    for table in (df, spark.read.parquet(str(tmp_path / "t"))):
        results = validate(table, rules).collect()
        assert [row.failed_count for row in results] == [3, 4]
        found = violations(table, rules, order, broadcast_bytes=limit)
        assert sorted(row.rule_position for row in found.collect()) == [1] * 3 + [2] * 4
        assert found.columns[: len(order)] == order
        one = [rules[0]]
        assert split(table, one, order_by=order, broadcast_bytes=limit).quarantine.count() == 3
        assert run(table, one, order_by=order).rows.clean.count() == 4


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS i", "cast(id AS double) AS d", "cast(id AS string) AS s").write.parquet(
        str(tmp_path / "t")
    )
    df = spark.read.parquet(str(tmp_path / "t"))
    rules = [
        valid("i", "range", min_value=1.5, max_value=5, threshold=1.0),
        valid("d", "range", min_value=3, max_value=90, threshold=1.0),
        valid("s", "enum", allowed_values=[str(n) for n in range(95)], threshold=1.0),
    ]
    parts = split(df, rules)
    assert (parts.clean.count(), parts.quarantine.count()) == (51, 49)
    for frame in (parts.clean, parts.quarantine, violations(df, rules, ["id"])):
        plan = plan_of(frame)
        assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan
        assert "isnan(cast(i" not in plan


def test_run_knows_the_number_of_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b")], "o long, k string")
    done = run(df, [rule("uniqueness", "k", threshold=1.0)], order_by=["o"])
    assert sorted(row.o for row in done.rows.quarantine.collect()) == [2, 3, 5]
    assert done.results.columns == [part.split()[0] for part in RESULT_SCHEMA.split(", ")]
    assert run(df, [], order_by=["o"]).rows.clean.count() == 5


def test_run_writes_nothing_unless_asked(people):
    done = run(people, PEOPLE_RULES)
    assert done.summary.first().overall_status == "failed"
    assert done.results.count() == 2
    assert ids(done.rows.clean) == [1, 4]


# --- profile -------------------------------------------------------------------------


def test_profile(spark):
    rows = [
        (place, None if place < 3 else "2024-01-0" + str(place % 9), " ", None, place % 2 == 0)
        for place in range(20)
    ]
    schema = "tc_kimlik long, cep_no string, city string, iban string, vergi boolean"
    df = spark.createDataFrame(rows, schema).repartition(4)
    got = {row.column: row for row in profile(df, ["tc_kimlik"]).collect()}
    assert {name: row.kind for name, row in got.items()} == {
        "tc_kimlik": "number", "cep_no": "date", "city": "text", "iban": "unknown", "vergi": "boolean",
    }
    assert {name: row.suggested_validator for name, row in got.items()} == {
        "tc_kimlik": "tckn", "cep_no": "phone_tr", "city": None, "iban": "tr_iban", "vergi": "vkn",
    }
    assert {name: row.null_count for name, row in got.items()} == {
        "tc_kimlik": 0, "cep_no": 3, "city": 0, "iban": 20, "vergi": 0,
    }
    assert {name: row.is_id_like for name, row in got.items()} == {
        "tc_kimlik": False, "cep_no": True, "city": False, "iban": False, "vergi": False,
    }
    assert got["tc_kimlik"].sample == ["0", "1", "2", "3", "4"]
    assert got["cep_no"].sample == ["2024-01-03", "2024-01-04"]
    assert got["vergi"].sample == ["True", "False", "True", "False", "True"]
    assert (got["city"].row_count, got["city"].column_count) == (20, 5)


def test_profile_without_order_and_of_few_rows(spark):
    df = spark.createDataFrame([(1, "a")], "x long, y string")
    assert [row.kind for row in profile(df).collect()] == ["number", "text"]
    assert [row.kind for row in profile(df, ["x"]).collect()] == ["number", "text"]
    assert [row.kind for row in profile(df.limit(0)).collect()] == ["unknown", "unknown"]


# --- plans ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "table")
    _, df = random_table(spark)
    df.withColumn("wide", F.lit("unused")).write.parquet(path)
    return spark.read.parquet(path)


def test_row_rules_share_one_narrow_scan(stored):
    rules = [
        rule("completeness", "value"),
        valid("value", "range", min_value=0),
        valid("text", "regex", pattern="k.*"),
        valid("text", "tckn"),
    ]
    plan = plan_of(validate(stored, rules))
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<text:string,value:double>" in plan
    assert "hashpartitioning" not in plan
    assert "Python" not in plan


def test_all_keys_share_one_scan(stored):
    rules = [
        rule("uniqueness", "text"),
        rule("uniqueness", "text", threshold=1.0),
        rule("uniqueness", "number"),
    ]
    plan = plan_of(validate(stored, rules))
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<text:string,number:int>" in plan
    assert "Expand" in plan


def test_row_rules_split_without_shuffle(stored):
    parts = split(stored, [valid("value", "range", min_value=0)])
    for df in (parts.clean, parts.quarantine, parts.tagged):
        assert "Exchange" not in plan_of(df)
        assert "Python" not in plan_of(df)


def test_no_join_for_a_key_without_duplicates(stored):
    parts = split(stored, [rule("uniqueness", "o"), valid("value", "range", min_value=0)])
    assert "Join" not in plan_of(parts.tagged)


def test_no_plan_holds_a_window_or_a_cross_join(stored):
    for limit in (0, 1 << 30):
        for df in (
            duplicate_rows(stored, ["text"], ["o"], limit),
            split(stored, RANDOM_RULES, order_by=["o"], broadcast_bytes=limit).tagged,
            violations(stored, RANDOM_RULES, ["o"], broadcast_bytes=limit),
        ):
            plan = plan_of(df)
            assert "Window" not in plan
            assert "Cartesian" not in plan
            assert "NestedLoop" not in plan


def test_broadcast_needs_a_proven_size(stored):
    assert fits_broadcast(stored, ("text",), ["o"], 10, 10_000)
    assert not fits_broadcast(stored, ("text",), ["o"], 100, 10_000)
    # 60 rows of 80 bytes would fit, but the order text adds up to 120 bytes to each.
    assert not fits_broadcast(stored, ("number",), ["text"], 60, 10_000)


def test_one_hot_key_is_broadcast_however_many_rows_it_has(spark):
    df = spark.range(30_000).selectExpr("id AS o", "if(id % 3 = 0, -1, id) AS k")
    assert count_duplicates(df, ("k",)) == Duplicates(9_999, 1)
    for found in (Duplicates(9_999), Duplicates(9_999, 1)):
        marked = mark_duplicates(df, ("k",), ["o"], "dup", found, 1000)
        assert "BroadcastHashJoin" in plan_of(marked)
        assert marked.filter("dup").count() == 9_999


def test_many_duplicates_join_on_row_order(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(duplicate_rows(stored, ["text"], ["o"], 0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    joined = plan[plan.index("SortMergeJoin") :].splitlines()[0]
    assert joined.index("o#") < joined.index("__key_0")


def test_head_of_profile_is_bounded_in_the_scan(stored):
    from rowsieve.operators.profile import first_rows_of

    plan = plan_of(first_rows_of(stored, ["o"], 10))
    assert "LessThanOrEqual(o,9)" in plan


def test_profile_without_order_starts_at_the_first_file(spark, tmp_path):
    small, large = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(0, 10).selectExpr("id", "cast(id AS string) AS label").coalesce(1).write.parquet(small)
    spark.range(10, 3000).selectExpr("id", "cast(id AS string) AS label").coalesce(1).write.parquet(large)
    # Spark plans the larger file first; positions put the first file's first rows first.
    df = spark.read.parquet(small, large)
    samples = {row["column"]: list(row["sample"]) for row in profile(df).collect()}
    assert samples["label"][:3] == ["0", "1", "2"]
