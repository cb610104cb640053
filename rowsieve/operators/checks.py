"""Turns rules into checks against one schema. Runs on the driver, touches no data."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property, partial, reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.functions.patterns import check_patterns, full_match_pattern
from rowsieve.functions.text import bind, inline, is_missing, named
from rowsieve.functions.validators import (
    custom_checks,
    pushable,
    reject_complex,
    validator_for,
    validator_name,
)
from rowsieve.operators.context import Context, Pending, bind_stats, group_columns, table_checks
from rowsieve.rules import DEFAULT_THRESHOLD, Rule, RuleError


@dataclass(frozen=True)
class Check:
    """A rule bound to a table.

    ``fails`` is set for rules that judge a row by itself, in one form for projections
    and aggregates and in another, ``fails_in_filter``, for filters. ``keys`` is set for
    uniqueness, and neither for a rule whose column is absent (``absent`` then names it).
    """

    position: int
    rule: Rule
    threshold: float
    column: str | None
    fails: Column | None = None
    for_filter: Callable[[], Column] | None = None
    pushable: tuple[Column, Column] | None = None
    keys: tuple[str, ...] = ()
    absent: str | None = None
    context: Context | None = None

    @cached_property
    def fails_in_filter(self) -> Column | None:
        return self.fails if self.for_filter is None else self.for_filter()

    @property
    def flag(self) -> str:
        return f"__fails_{self.position}"


def compile_checks(
    df: DataFrame, rules: Iterable[Rule], default_threshold: float = DEFAULT_THRESHOLD
) -> list[Check]:
    rules = list(rules)
    types = {field.name: field.dataType for field in df.schema.fields}
    custom = custom_checks()
    whole = table_checks()
    checks: list[Check | None] = []
    patterns = []
    pending: dict[int, tuple[Rule, float, Pending]] = {}
    for position, rule in enumerate(rules, start=1):
        threshold = rule.threshold_or(default_threshold)
        needed = [*rule.targets, *(group_columns(rule.params) if rule.type in whole else ())]
        absent = next((name for name in needed if name not in types), None)
        if absent is not None:
            checks.append(Check(position, rule, threshold, absent, absent=absent))
            continue
        if rule.type == "uniqueness":
            for name in rule.targets:
                reject_complex(types[name], rule.id)
            single = rule.targets[0] if len(rule.targets) == 1 else None
            checks.append(Check(position, rule, threshold, single, keys=rule.targets))
            continue
        if rule.column is None:
            raise RuleError(f"rule {rule.id!r} of type {rule.type!r} needs 'column'")
        value, dtype = named(rule.column), types[rule.column]
        pushed = None
        if rule.type == "completeness":
            fails, for_filter = is_missing(value, dtype), None
        elif rule.type == "validity":
            if not rule.validator:
                raise RuleError(f"rule {rule.id!r} names no validator")
            reject_complex(dtype, rule.id)
            validator = validator_for(rule.validator)
            fails = validator(value, dtype, rule.params, inline)
            for_filter = partial(validator, value, dtype, rule.params, bind)
            pushed = pushable(validator_name(rule.validator), value, dtype, rule.params)
            if validator_name(rule.validator) == "regex":
                patterns.append(full_match_pattern(str(rule.params.get("pattern", ""))))
        elif rule.type in custom:
            fails = F.coalesce(custom[rule.type](value, dtype, rule.params), F.lit(True))
            for_filter = None
        elif rule.type in whole:
            keys = group_columns(rule.params)
            pending[position] = (
                rule, threshold, Pending(position, value, dtype, rule.params, whole[rule.type], keys, tuple(types))
            )
            checks.append(None)
            continue
        else:
            raise RuleError(f"rule {rule.id!r} has unknown type {rule.type!r}")
        checks.append(Check(position, rule, threshold, rule.column, fails, for_filter, pushed))
    check_patterns(df.sparkSession, dict.fromkeys(patterns))
    if pending:
        bound = bind_stats(df, [item for _, _, item in pending.values()])
        for position, (rule, threshold, _) in pending.items():
            fails, context = bound[position]
            checks[position - 1] = Check(
                position, rule, threshold, rule.column, fails, context=context
            )
    return checks  # type: ignore[return-value]


def for_scan(checks: Iterable[Check]) -> tuple[Column, Column]:
    """What a scan may skip by: true for every row that breaks one of the checks, and true for
    every row that breaks none. Where nothing is known it is just true."""
    known = [check.pushable for check in checks]
    passing = reduce(and_, [found[1] for found in known if found], F.lit(True))
    if not known or None in known:
        return F.lit(True), passing
    return reduce(or_, [found[0] for found in known]), passing
