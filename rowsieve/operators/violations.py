"""``violations``: one row per table row and rule it breaks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsieve.functions.text import as_text, is_missing, named
from rowsieve.operators.checks import Check, compile_checks, for_scan
from rowsieve.operators.context import with_context
from rowsieve.operators.duplicates import (
    BROADCAST_BYTES,
    Duplicates,
    count_duplicates,
    mark_duplicates,
    with_row_order,
)
from rowsieve.rules import DEFAULT_THRESHOLD, Rule

Labels = Mapping[str, str]

ENGLISH_LABELS: Labels = {
    "completeness": "[{column}] missing value ({value})",
    "uniqueness": "[{column}] duplicate record ({value})",
    "validity": "[{column}] invalid value ({value})",
    "other": "[{column}] rule violated: {rule}",
    "blank": "blank",
}

VIOLATION_COLUMNS = {
    "rule_position": "int",
    "rule_id": "string",
    "rule_name": "string",
    "rule_type": "string",
    "column": "string",
    "severity": "string",
    "value": "string",
    "reason": "string",
}


def shown_value(df: DataFrame, columns: Sequence[str], blank: str) -> Column:
    """The values as text in quotes, with a word in place of a blank one."""
    types = {field.name: field.dataType for field in df.schema.fields}
    shown = [_quoted(named(name), types[name], blank) for name in columns]
    return shown[0] if len(shown) == 1 else F.concat_ws(", ", *shown)


def _quoted(value: Column, dtype: T.DataType, blank: str) -> Column:
    quoted = F.concat(F.lit("'"), as_text(value, dtype), F.lit("'"))
    return F.when(is_missing(value, dtype), F.lit(blank)).otherwise(quoted)


def reason_text(df: DataFrame, check: Check, labels: Labels) -> Column:
    columns = check.rule.targets
    label = labels.get(check.rule.type, labels["other"])
    head, marker, tail = label.partition("{value}")
    head, tail = (
        part.replace("{column}", ", ".join(columns)).replace("{rule}", check.rule.name)
        for part in (head, tail)
    )
    if not marker:
        return F.lit(head)
    return F.concat(F.lit(head), shown_value(df, columns, labels["blank"]), F.lit(tail))


def with_flags(
    df: DataFrame,
    checks: Iterable[Check],
    order: list[str],
    duplicates: Mapping[int, Duplicates],
    broadcast_bytes: int = BROADCAST_BYTES,
) -> tuple[DataFrame, dict[int, Column]]:
    """The table ready for flagging, and per check the Column that is TRUE where it fails.

    Row checks stay expressions. Only uniqueness adds columns and, if it has anything to
    mark, a join; rules over the same keys share it.
    """
    flags: dict[int, Column] = {}
    shared: dict[tuple[str, ...], str] = {}
    df = with_context(df, [check.context for check in checks if check.fails is not None])
    for check in checks:
        if check.fails is not None:
            flags[check.position] = check.fails
        elif check.keys:
            if check.keys not in shared:
                df = mark_duplicates(
                    df,
                    check.keys,
                    order,
                    check.flag,
                    duplicates[check.position],
                    broadcast_bytes,
                )
                shared[check.keys] = check.flag
            flags[check.position] = F.col(shared[check.keys])
    return df, flags


def violations(
    df: DataFrame,
    rules: Iterable[Rule],
    order_by: Sequence[str] | None = None,
    results: DataFrame | Sequence[Row] | None = None,
    default_threshold: float = DEFAULT_THRESHOLD,
    labels: Labels = ENGLISH_LABELS,
    in_row_order: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The order columns of each failing row, once per broken rule, with value and reason.

    One pass over the table for row rules; nothing is collected but the verdicts. With
    ``results`` the duplicates of uniqueness rules need no counting. ``in_row_order`` adds
    a sort by row order and rule.
    """
    checks = compile_checks(df, rules, default_threshold)
    unique = [check for check in checks if check.keys]
    found: dict[tuple[str, ...], Duplicates] = {}
    if results is not None:
        verdicts = results.collect() if isinstance(results, DataFrame) else results
        counted = {row["rule_position"]: row for row in verdicts}
        for check in unique:
            row = counted[check.position]
            keys = row["repeated_keys"] if "repeated_keys" in row else None
            found[check.keys] = Duplicates(row["failed_count"], keys)
    for check in unique:
        if check.keys not in found:
            found[check.keys] = count_duplicates(df, check.keys)
    placed, order = with_row_order(df, order_by)
    flagged, flags = with_flags(
        placed,
        checks,
        order,
        {check.position: found[check.keys] for check in unique},
        broadcast_bytes,
    )
    broken = [
        flags[check.position] if check.fails is None else check.fails_in_filter
        for check in checks
        if check.position in flags
    ]
    entries = [
        F.when(
            flags[check.position],
            F.struct(
                F.lit(check.position).alias("rule_position"),
                F.lit(check.rule.id).alias("rule_id"),
                F.lit(check.rule.name).alias("rule_name"),
                F.lit(check.rule.type).alias("rule_type"),
                F.lit(check.column).cast("string").alias("column"),
                F.lit(check.rule.severity).alias("severity"),
                shown_value(df, check.rule.targets, labels["blank"]).alias("value"),
                reason_text(df, check, labels).alias("reason"),
            ),
        )
        for check in checks
        if check.position in flags
    ]
    shown = [order_by] if isinstance(order_by, str) else list(order_by or order)
    places = [named(name) for name in shown]
    if not entries:
        typed = [F.lit(None).cast(dtype).alias(name) for name, dtype in VIOLATION_COLUMNS.items()]
        return placed.filter(F.lit(False)).select(*places, *typed)
    scan, _ = for_scan([check for check in checks if check.position in flags])
    listed = flagged.filter(scan).filter(reduce(or_, broken)).select(
        *places, F.explode(F.array(*entries)).alias("__found")
    )
    listed = listed.filter(F.col("__found").isNotNull()).select(*places, "__found.*")
    return listed.orderBy(*places, "rule_position") if in_row_order else listed
