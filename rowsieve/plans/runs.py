"""A full run: validate, judge, split, and write what was asked for."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row

from rowsieve.operators.checks import compile_checks
from rowsieve.operators.duplicates import RowOrderError, has_positions
from rowsieve.operators.report import summarise
from rowsieve.operators.split import Split, split
from rowsieve.operators.validate import RESULT_COLUMNS, RESULT_SCHEMA, results_of
from rowsieve.operators.violations import ENGLISH_LABELS, Labels
from rowsieve.plans.cluster import fresh_folder
from rowsieve.rules import DEFAULT_THRESHOLD, Rule, default_rules
from rowsieve.sources.readers import land
from rowsieve.sources.writers import write_counted_split, write_report


@dataclass(frozen=True)
class Run:
    """``verdicts`` holds one row per rule; ``rows`` stays lazy. ``written`` has the
    split's counts where the rows were written, observed in that pass."""

    run_id: str
    verdicts: list[Row]
    results: DataFrame
    summary: DataFrame
    rows: Split
    written: Row | None = None


def run(
    df: DataFrame,
    rules: Iterable[Rule] | None = None,
    root: str | None = None,
    run_id: str | None = None,
    order_by: Sequence[str] | None = None,
    default_threshold: float = DEFAULT_THRESHOLD,
    labels: Labels = ENGLISH_LABELS,
    source: str = "",
    rules_source: str = "",
) -> Run:
    """Without ``rules`` the default rules apply. With ``root`` report and rows are written.

    The table is read once for the verdicts and once more for the rows. If duplicates have
    to be told from first rows and nothing gives their order, the table is landed as
    Parquet in the shared folder before either pass, and positions there count: verdicts
    and rows then come from the same rows, even of a source that changes meanwhile.
    """
    chosen = default_rules(df) if rules is None else list(rules)
    spark = df.sparkSession
    name = run_id or str(uuid.uuid4())
    unordered = not order_by and not has_positions(df)
    if unordered and any(rule.type == "uniqueness" for rule in chosen):
        df = land(df, fresh_folder(spark, f"landed/{name}"))
    counted = results_of(df, compile_checks(df, chosen, default_threshold)).collect()
    verdicts = [Row(**{name: row[name] for name in RESULT_COLUMNS}) for row in counted]
    results = spark.createDataFrame(verdicts, RESULT_SCHEMA)
    try:
        rows = split(df, chosen, counted, order_by, default_threshold, labels)
    except RowOrderError:
        landed = land(df, fresh_folder(spark, f"landed/{name}"))
        rows = split(landed, chosen, counted, None, default_threshold, labels)
    written = None
    if root is not None:
        origin = rules_source or ("default rules" if rules is None else "")
        write_report(spark, verdicts, root, name, source, origin)
        written = write_counted_split(rows, root, name)[2]
    return Run(name, verdicts, results, summarise(results), rows, written)
