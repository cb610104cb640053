"""``validate``: one scored result row per rule."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.functions.text import named, narrow_key, sql_text
from rowsieve.operators.checks import Check, compile_checks
from rowsieve.operators.context import with_context
from rowsieve.rules import DEFAULT_THRESHOLD, Rule

RESULT_SCHEMA = (
    "rule_position int, rule_id string, rule_name string, rule_type string, column string, "
    "status string, score double, threshold double, failed_count bigint, total_count bigint, "
    "severity string, message string"
)
RESULT_COLUMNS = [part.split()[0] for part in RESULT_SCHEMA.split(", ")]

# Row checks counted by one aggregate; wider ones would leave whole-stage codegen
# (spark.sql.codegen.maxFields is 100).
CHECKS_PER_SCAN = 64


def validate(
    df: DataFrame, rules: Iterable[Rule], default_threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Results in rule order.

    All completeness, validity and custom rules share one scan and one aggregate without
    grouping. Each distinct uniqueness key adds a scan of its own columns and one shuffle
    of narrow keys, already merged per task, so a hot key weighs no more than a rare one.
    """
    return results_of(df, compile_checks(df, rules, default_threshold)).select(*RESULT_COLUMNS)


def results_of(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Results with one more column, ``repeated_keys``: how many keys have duplicates. The
    count is free here and tells a later split how large the set of those keys is."""
    if not checks:
        return df.sparkSession.createDataFrame([], f"{RESULT_SCHEMA}, repeated_keys bigint")
    row_checks = [check for check in checks if check.fails is not None]
    parts = [
        _count_row_checks(df, row_checks[start : start + CHECKS_PER_SCAN])
        for start in range(0, len(row_checks), CHECKS_PER_SCAN)
    ]
    by_keys: dict[tuple[str, ...], list[Check]] = {}
    for check in checks:
        if check.keys:
            by_keys.setdefault(check.keys, []).append(check)
    if len(by_keys) > 1:
        parts.append(_count_all_duplicates(df, by_keys))
    else:
        parts += [_count_duplicates(df, keys, group) for keys, group in by_keys.items()]
    skipped = [check for check in checks if check.absent is not None]
    if skipped:
        one_row = df.sparkSession.range(1, numPartitions=1)
        parts.append(_as_rows(one_row, [(check, "0L", "0L") for check in skipped]))
    counted = reduce(DataFrame.unionByName, parts)
    # Every part is a finished aggregate of a few rows, so one partition orders them all
    # without the extra shuffle a range-partitioned sort would plan.
    return _score(counted).coalesce(1).orderBy("rule_position")


def _count_row_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    df = with_context(df, [check.context for check in checks])
    counted = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(check.fails).alias(check.flag) for check in checks],
    )
    return _as_rows(counted, [(check, check.flag, "total") for check in checks])


def key_columns(df: DataFrame, keys: tuple[str, ...]) -> list[Column]:
    types = {field.name: field.dataType for field in df.schema.fields}
    return [
        narrow_key(named(name), types[name]).alias(f"__key_{place}")
        for place, name in enumerate(keys)
    ]


def _count_duplicates(df: DataFrame, keys: tuple[str, ...], checks: list[Check]) -> DataFrame:
    per_key = (
        df.select(*key_columns(df, keys))
        .groupBy(*[f"__key_{place}" for place in range(len(keys))])
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counted = per_key.selectExpr(
        "coalesce(sum(n - 1), 0L) AS failed",
        "coalesce(sum(n), 0L) AS total",
        "count_if(n > 1) AS repeated",
    )
    return _as_rows(counted, [(check, "failed", "total") for check in checks], "repeated")


def _count_all_duplicates(df: DataFrame, by_keys: dict[tuple[str, ...], list[Check]]) -> DataFrame:
    """Every key set in one scan: grouping sets expand each row once per set, one aggregate
    counts rows per key, merged per task before the shuffle, and a second one sums each
    set's counts, told apart by their grouping id."""
    types = {field.name: field.dataType for field in df.schema.fields}
    names = list(dict.fromkeys(name for keys in by_keys for name in keys))
    slot = {name: f"__key_{place}" for place, name in enumerate(names)}
    narrow = df.select(*[narrow_key(named(name), types[name]).alias(slot[name]) for name in names])
    sets = [[slot[name] for name in keys] for keys in by_keys]
    per_key = narrow.groupingSets(sets, *slot.values()).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")
    )

    def gid(keys: tuple[str, ...]) -> int:
        # A bit for each column left out of the set, the first column highest.
        return sum(1 << (len(names) - 1 - place) for place, name in enumerate(names) if name not in keys)

    sums = []
    for place, keys in enumerate(by_keys):
        mine = F.col("gid") == F.lit(gid(keys))
        sums += [
            F.coalesce(F.sum(F.when(mine, F.col("n") - 1)), F.lit(0)).alias(f"failed_{place}"),
            F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).alias(f"total_{place}"),
            F.count_if(mine & (F.col("n") > 1)).alias(f"repeated_{place}"),
        ]
    cells = [
        (check, f"failed_{place}", f"total_{place}", f"repeated_{place}")
        for place, group in enumerate(by_keys.values())
        for check in group
    ]
    return _as_rows(per_key.agg(*sums), cells)


def _as_rows(
    counted: DataFrame, cells: list[tuple[Check, str, str] | tuple[Check, str, str, str]], repeated: str = "0L"
) -> DataFrame:
    """One row of counts becomes one row per check, with the rule's own facts as literals.

    Given as SQL text: a Column call for each of these cells would cost more driver time
    than the plan they make.
    """
    structs = [
        "named_struct("
        f"'rule_position', {check.position}, 'rule_id', {sql_text(check.rule.id)}, "
        f"'rule_name', {sql_text(check.rule.name)}, 'rule_type', {sql_text(check.rule.type)}, "
        f"'column', {sql_text(check.column)}, 'threshold', {float(check.threshold)!r}D, "
        f"'failed_count', {failed}, 'total_count', {total}, "
        f"'severity', {sql_text(check.rule.severity)}, "
        f"'skipped', {check.absent is not None}, 'subject', {sql_text(_subject(check))}, "
        f"'repeated_keys', {cell[3] if len(cell) > 3 else repeated})"
        for cell in cells
        for check, failed, total in [cell[:3]]
    ]
    return counted.selectExpr(f"inline(array({', '.join(structs)}))")


def _subject(check: Check) -> str:
    if check.rule.type == "completeness":
        return "missing"
    if check.rule.type == "uniqueness":
        return f"duplicated over ({', '.join(check.rule.targets)})"
    if check.rule.type == "validity":
        return f"invalid [{check.rule.validator}]"
    return f"failing [{check.rule.type}]"


SCORE = """
    CASE WHEN skipped THEN 0D
         WHEN total_count = 0 THEN 1D
         ELSE CAST(total_count - failed_count AS DOUBLE) / CAST(total_count AS DOUBLE)
    END AS score"""
STATUS = """
    CASE WHEN skipped THEN 'skipped'
         WHEN score >= threshold THEN 'passed'
         ELSE 'failed'
    END AS status"""
MESSAGE = """
    CASE WHEN skipped THEN format_string('column %s is not in the table', column)
         WHEN total_count = 0 THEN 'the table has no rows'
         ELSE format_string(
             '%d of %d rows %s (%.1f%%), score %.3f %s threshold %.3f',
             failed_count, total_count, subject, failed_count * 100D / total_count, score,
             CASE WHEN status = 'passed' THEN 'reaches' ELSE 'misses' END, threshold)
    END AS message"""


def _score(counted: DataFrame) -> DataFrame:
    scored = counted.selectExpr("*", SCORE).selectExpr("*", STATUS).selectExpr("*", MESSAGE)
    return scored.select(*RESULT_COLUMNS, "repeated_keys")
