"""Sinks for reports and for the two halves of a split.

Every run writes its report below ``run_date=<day>/run_id=<id>`` and replaces only that
folder, so a repeated run, or a micro-batch that is tried again, leaves one copy that
day. ``compact_history`` rewrites a day's reports as one file of each kind, with
``run_id`` as a column, and deletes the day's run folders; ``history`` reads both forms
and keeps the latest copy of each run, so a run repeated on another day, or compacted
while its folder was still there, counts once. Rows of a split go below ``run_id=<id>``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from rowsieve.operators.report import summarise
from rowsieve.operators.split import OUTCOME_COLUMN, Split
from rowsieve.operators.validate import RESULT_SCHEMA

# Fixed value: reports show scores with this many decimals.
REPORT_DECIMALS = 4


def write_report(
    spark: SparkSession,
    results: Sequence[Row],
    root: str,
    run_id: str,
    source: str = "",
    rules_source: str = "",
    fmt: str = "json",
    run_date: str | None = None,
) -> None:
    """Write ``results`` and ``summary`` below ``root``; one row per rule and one in all,
    in the partition of ``run_date`` (today, in UTC, if not given)."""
    day = run_date or dt.datetime.now(dt.timezone.utc).date().isoformat()
    table = spark.createDataFrame(list(results), RESULT_SCHEMA)
    stamp = {
        "source": F.lit(source),
        "rules_source": F.lit(rules_source),
        "executed_at": F.current_timestamp(),
    }
    shown = table.withColumns(
        {name: F.round(name, REPORT_DECIMALS) for name in ("score", "threshold")}
    )
    summary = summarise(table).withColumn(
        "overall_score", F.round("overall_score", REPORT_DECIMALS)
    )
    for name, part in (("results", shown), ("summary", summary)):
        part.withColumns(stamp).coalesce(1).write.mode("overwrite").format(fmt).save(
            f"{root}/{name}/run_date={day}/run_id={run_id}"
        )


REPORTS = ("results", "summary")


def compact_history(spark: SparkSession, root: str, run_date: str, fmt: str = "json") -> None:
    """One file of each report kind for ``run_date``, in ``<kind>_compacted``, and the
    day's run folders deleted. The new file is written before anything is deleted, so an
    interrupted compaction leaves copies that ``history`` counts once."""
    from rowsieve.plans.cluster import drop_folder

    for name in REPORTS:
        day = f"{root}/{name}/run_date={run_date}"
        try:
            rows = spark.read.format(fmt).load(day)
        except AnalysisException:
            continue
        # A day's reports are a few rows a run.
        rows.coalesce(1).write.mode("append").parquet(f"{root}/{name}_compacted/run_date={run_date}")
        drop_folder(spark, day)


def history(spark: SparkSession, root: str, name: str = "results", fmt: str = "json") -> DataFrame:
    """Every run's report rows of kind ``name``, compacted or not, the latest copy of each
    run only; with ``run_date`` and ``run_id``."""
    parts = []
    for path, reader in ((f"{root}/{name}", spark.read.format(fmt)), (f"{root}/{name}_compacted", spark.read.format("parquet"))):
        try:
            parts.append(reader.load(path))
        except AnalysisException:
            continue
    if not parts:
        raise FileNotFoundError(f"no reports below {root}/{name}")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    stamp = F.col("executed_at").cast("string")
    latest = F.max(stamp).over(Window.partitionBy("run_id"))
    return rows.withColumn("__latest", latest).filter(stamp == F.col("__latest")).drop("__latest")


def write_split(parts: Split, root: str, run_id: str, fmt: str = "parquet") -> tuple[str, str]:
    """Write both halves in one pass over the table; gives the two folders.

    The outcome is a partition column, so a task writes its clean and its quarantined
    rows side by side and the table is neither read nor checked twice.
    """
    clean, held, _ = write_counted_split(parts, root, run_id, fmt)
    return clean, held


def write_counted_split(
    parts: Split, root: str, run_id: str, fmt: str = "parquet"
) -> tuple[str, str, Row]:
    """As ``write_split``, and the split's counts (``total_rows``, ``clean_rows``,
    ``quarantine_rows``), observed by the tasks that write: no second pass reads the table.

    Observed metrics are merged from the tasks that succeed, so a task tried again after a
    lost executor counts once.
    """
    base = f"{root}/rows/run_id={run_id}"
    seen = Observation()
    outcome = F.col(OUTCOME_COLUMN)
    tagged = parts.tagged.observe(
        seen,
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(outcome == "clean").alias("clean_rows"),
        F.count_if(outcome == "quarantine").alias("quarantine_rows"),
    )
    writer = tagged.write.mode("overwrite").partitionBy(OUTCOME_COLUMN).format(fmt)
    # Two files open at a time spare the sort by outcome that each task would else make.
    with _setting(parts.tagged.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", "2"):
        writer.save(base)
    counts = seen.get
    row = Row(*[name for name in ("total_rows", "clean_rows", "quarantine_rows")])
    return (
        f"{base}/{OUTCOME_COLUMN}=clean",
        f"{base}/{OUTCOME_COLUMN}=quarantine",
        row(*[int(counts[name]) for name in ("total_rows", "clean_rows", "quarantine_rows")]),
    )


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
