"""Rule-based data quality for Spark tables."""

from rowsieve.functions.validators import register_check
from rowsieve.operators.context import register_table_check
from rowsieve.operators.duplicates import duplicate_rows
from rowsieve.operators.profile import profile
from rowsieve.operators.report import blocking_failures, summarise, with_pass_rate
from rowsieve.operators.split import Split, split
from rowsieve.operators.validate import validate
from rowsieve.operators.violations import ENGLISH_LABELS, violations
from rowsieve.plans.runs import Run, run
from rowsieve.rules import (
    Rule,
    RuleError,
    default_rules,
    load_rules,
    rules_from_entries,
    rules_from_form,
)
from rowsieve.sources.readers import land, read

__all__ = [
    "ENGLISH_LABELS",
    "Rule",
    "RuleError",
    "Run",
    "Split",
    "blocking_failures",
    "default_rules",
    "duplicate_rows",
    "land",
    "load_rules",
    "profile",
    "read",
    "register_check",
    "register_table_check",
    "rules_from_entries",
    "rules_from_form",
    "run",
    "split",
    "summarise",
    "validate",
    "violations",
    "with_pass_rate",
]
