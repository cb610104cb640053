"""Report-level views of a results table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarise(results: DataFrame) -> DataFrame:
    """One row: verdict, mean score (skipped rules count as 0) and rule counts."""
    blocking = (F.col("status") == "failed") & (F.col("severity") == "error")
    return results.agg(
        F.when(F.coalesce(F.bool_or(blocking), F.lit(False)), F.lit("failed"))
        .otherwise(F.lit("passed"))
        .alias("overall_status"),
        F.coalesce(F.avg("score"), F.lit(1.0)).alias("overall_score"),
        F.count(F.lit(1)).alias("total_rules"),
        *[
            F.count_if(F.col("status") == status).alias(f"{status}_rules")
            for status in ("passed", "failed", "skipped")
        ],
    )


def blocking_failures(results: DataFrame) -> DataFrame:
    """Failed rules of severity error, the ones that fail the whole report."""
    return results.filter((F.col("status") == "failed") & (F.col("severity") == "error"))


def with_pass_rate(results: DataFrame) -> DataFrame:
    """Adds the share of rows that passed; 1.0 where no row was tested."""
    total = F.col("total_count")
    passed = (total - F.col("failed_count")).cast("double")
    return results.withColumn("pass_rate", F.when(total == 0, 1.0).otherwise(passed / total))
