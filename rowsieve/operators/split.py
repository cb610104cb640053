"""``split``: clean rows and quarantined rows with reasons."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rowsieve.functions.text import named
from rowsieve.operators.checks import Check, compile_checks, for_scan
from rowsieve.operators.duplicates import BROADCAST_BYTES, Duplicates, with_row_order
from rowsieve.operators.validate import results_of
from rowsieve.operators.violations import ENGLISH_LABELS, Labels, reason_text, with_flags
from rowsieve.rules import DEFAULT_THRESHOLD, Rule

REASON_COLUMN = "violation_reasons"
OUTCOME_COLUMN = "sieve_outcome"


@dataclass(frozen=True)
class Split:
    """The table split in two. Each frame is lazy and reads the table once.

    ``tagged`` is every row with its outcome and reasons; write it when both halves are
    wanted, since that is a single pass.
    """

    flagged: DataFrame
    columns: list[str]
    broken: Column
    broken_in_filter: Column
    reasons: Column
    scan: tuple[Column, Column]

    def _besides_reasons(self) -> list[Column]:
        """The table's columns, without the reasons of an earlier split."""
        return [named(name) for name in self.columns if name != REASON_COLUMN]

    @property
    def tagged(self) -> DataFrame:
        outcome = F.when(self.broken, F.lit("quarantine")).otherwise(F.lit("clean"))
        return self.flagged.select(
            *self._besides_reasons(),
            outcome.alias(OUTCOME_COLUMN),
            F.when(self.broken, self.reasons).alias(REASON_COLUMN),
        )

    @property
    def clean(self) -> DataFrame:
        kept = self.flagged.filter(self.scan[1]).filter(~self.broken_in_filter)
        return kept.select(*[named(name) for name in self.columns])

    @property
    def quarantine(self) -> DataFrame:
        held = self.flagged.filter(self.scan[0]).filter(self.broken_in_filter)
        return held.select(*self._besides_reasons(), self.reasons.alias(REASON_COLUMN))

    def counts(self) -> DataFrame:
        """One row: total, clean and quarantined rows."""
        return self.flagged.agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if(~self.broken).alias("clean_rows"),
            F.count_if(self.broken).alias("quarantine_rows"),
        )


def active_checks(checks: Iterable[Check], results: Iterable[Row]) -> list[Check]:
    """Checks whose failing rows go to quarantine.

    They failed their threshold, or they are of severity error, in which case bad rows are
    held back even when the threshold was met. Checks without a failing row drop out.
    """
    verdicts = {row["rule_position"]: row for row in results}
    return [
        check
        for check in checks
        if (row := verdicts[check.position])["failed_count"] > 0
        and (row["status"] == "failed" or check.rule.severity == "error")
    ]


def split(
    df: DataFrame,
    rules: Iterable[Rule],
    results: DataFrame | Sequence[Row] | None = None,
    order_by: Sequence[str] | None = None,
    default_threshold: float = DEFAULT_THRESHOLD,
    labels: Labels = ENGLISH_LABELS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> Split:
    """Split by the verdicts in ``results``, which are worked out first if not given.

    Only the verdicts, one row per rule, come to the driver. ``order_by`` is used by
    uniqueness rules alone.
    """
    checks = compile_checks(df, rules, default_threshold)
    if results is None:
        results = results_of(df, checks)
    verdicts = results.collect() if isinstance(results, DataFrame) else list(results)
    active = active_checks(checks, verdicts)
    order: list[str] = []
    placed = df
    if any(check.keys for check in active):
        placed, order = with_row_order(df, order_by)
    found = {
        row["rule_position"]: Duplicates(
            row["failed_count"], row["repeated_keys"] if "repeated_keys" in row else None
        )
        for row in verdicts
    }
    flagged, flags = with_flags(placed, active, order, found, broadcast_bytes)
    in_filter = {
        check.position: check.fails_in_filter for check in active if check.fails is not None
    }
    reasons = [
        F.when(flags[check.position], reason_text(df, check, labels)) for check in active
    ]
    return Split(
        flagged,
        df.columns,
        reduce(or_, flags.values(), F.lit(False)),
        reduce(or_, {**flags, **in_filter}.values(), F.lit(False)),
        F.concat_ws(" | ", *reasons),
        for_scan(active),
    )
