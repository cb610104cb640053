"""Declarative quality rules and the ways a caller may hand them over."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

DEFAULT_THRESHOLD = 0.95

# The vocabularies and defaults a rule set is written against.
BUILTIN_TYPES = ("completeness", "uniqueness", "validity")
SEVERITIES = ("error", "warning", "info")
RULE_SET_VERSION = "1.0"
FORM_DEFAULTS = {"type": "completeness", "threshold": 0.80, "severity": "warning"}
TYPE_WORDS = {
    "completeness": "tamlık",
    "uniqueness": "tekrarsızlık",
    "validity": "geçerlilik",
}
ID_WORDS = ("id", "key", "uuid", "kod", "code", "no", "num", "ref", "pk")


class RuleError(ValueError):
    """A rule that cannot be turned into a check."""


@dataclass(frozen=True)
class Rule:
    """One rule. ``column`` wins over ``columns`` when both are given."""

    id: str
    name: str
    type: str
    severity: str = "error"
    column: str | None = None
    columns: tuple[str, ...] = ()
    threshold: float | None = None
    validator: str | None = None
    params: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.column is None and not self.columns:
            raise RuleError(f"rule {self.id!r} names neither 'column' nor 'columns'")
        if self.threshold is not None and not 0.0 <= self.threshold <= 1.0:
            raise RuleError(f"rule {self.id!r}: threshold {self.threshold} is outside [0, 1]")

    @property
    def targets(self) -> tuple[str, ...]:
        return self.columns if self.column is None else (self.column,)

    def threshold_or(self, default: float) -> float:
        return default if self.threshold is None else self.threshold


def known_types() -> set[str]:
    """The built-in rule types and those registered as custom or table checks."""
    from rowsieve.functions.validators import custom_checks
    from rowsieve.operators.context import table_checks

    return {*BUILTIN_TYPES, *custom_checks(), *table_checks()}


def rule_from_entry(entry: Mapping[str, Any]) -> Rule:
    """Strict form: ``id``, ``name`` and ``type`` are required, severity defaults to error."""
    label = entry.get("id", "<no id>")
    absent = [name for name in ("id", "name", "type") if name not in entry]
    if absent:
        raise RuleError(f"rule {label!r} lacks {', '.join(absent)}")
    kind = str(entry["type"]).lower()
    if kind not in known_types():
        raise RuleError(f"rule {label!r} has unknown type {kind!r}")
    severity = str(entry.get("severity", "error")).lower()
    if severity not in SEVERITIES:
        warnings.warn(f"rule {label!r}: unknown severity {severity!r}, using 'error'", stacklevel=2)
        severity = "error"
    threshold = entry.get("threshold")
    return Rule(
        id=str(label),
        name=str(entry["name"]),
        type=kind,
        severity=severity,
        column=entry.get("column"),
        columns=tuple(map(str, entry.get("columns") or ())),
        threshold=None if threshold is None else float(threshold),
        validator=entry.get("validator") or entry.get("validator_type"),
        params=dict(entry.get("params") or {}),
    )


def rules_from_entries(entries: Iterable[Mapping[str, Any]]) -> list[Rule]:
    return [rule_from_entry(entry) for entry in entries]


def rules_from_form(entries: Iterable[Mapping[str, Any]]) -> list[Rule]:
    """Lenient form: missing parts take ``FORM_DEFAULTS``, unknown types are dropped."""
    known = known_types()
    rules = []
    for number, entry in enumerate(entries, start=1):
        filled = {**FORM_DEFAULTS, **entry}
        kind = str(filled["type"])
        if kind not in known:
            warnings.warn(f"rule {number}: unknown type {kind!r} dropped", stacklevel=2)
            continue
        column = str(filled.get("column", ""))
        rules.append(
            Rule(
                id=filled.get("id", f"ui_{number:03d}"),
                name=filled.get("name", f"{column}_{TYPE_WORDS.get(kind, kind)}"),
                type=kind,
                severity=filled["severity"],
                column=column or None,
                threshold=float(filled["threshold"]),
                validator=filled.get("validator") or filled.get("validator_type"),
                params=dict(filled.get("params") or {}),
            )
        )
    return rules


def is_id_like(column: str) -> bool:
    name = column.lower()
    return any(word in name for word in ID_WORDS)


def default_rules(df: DataFrame) -> list[Rule]:
    """Completeness for each column, plus uniqueness for columns named like identifiers."""
    rules = []
    for number, column in enumerate(df.columns, start=1):
        tag = f"auto_{number:03d}"
        word = TYPE_WORDS["completeness"]
        rules.append(
            Rule(f"{tag}_c", f"{column}_{word}", "completeness", "warning", column, threshold=0.80)
        )
        if is_id_like(column):
            word = TYPE_WORDS["uniqueness"]
            rules.append(
                Rule(f"{tag}_u", f"{column}_{word}", "uniqueness", "error", column, threshold=1.0)
            )
    return rules


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Read a rule set (``{"version": ..., "rules": [...]}``) in JSON or YAML.

    The text comes through Spark's file systems, so the path may live wherever the
    cluster's tables live. YAML needs the PyYAML package on the driver.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.lower().endswith(".json"):
        document = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as exc:
            raise RuleError("reading YAML rules needs PyYAML; give JSON instead") from exc
        document = yaml.safe_load(text)
    if not isinstance(document, dict):
        raise RuleError(f"{path}: the rule set must be a mapping with a 'rules' list")
    version = str(document.get("version", "") or RULE_SET_VERSION)
    if version != RULE_SET_VERSION:
        warnings.warn(f"{path}: version {version!r}, expected {RULE_SET_VERSION!r}", stacklevel=2)
    return rules_from_entries(document.get("rules") or [])
