"""Settings and folders that depend on the cluster a session runs on."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import SparkSession

PARTITION_BYTES = 256 * 1024 * 1024
SCAN_BYTES = 1024 * 1024 * 1024
LEAST_PARTITIONS = 200
MOST_PARTITIONS = 50_000
# Regular expressions with nested repeats go down one stack frame for each character.
EXECUTOR_OPTIONS = {"spark.executor.extraJavaOptions": "-Xss64m"}


def shuffle_settings(
    table_bytes: int, shuffled_bytes: int | None = None, partition_bytes: int = PARTITION_BYTES
) -> dict[str, str]:
    """Session settings for tables of about ``table_bytes`` on disk.

    What is shuffled are narrow keys, by default taken for a tenth of the table; give rows
    times key width where it is known. Adaptive execution merges partitions that turn out
    small, but it can not split an aggregate's, so the count has to be high enough before.
    It is bounded, as the driver keeps a size for each pair of a map task and a partition;
    scans take larger pieces of large tables for the same reason.
    """
    moved = table_bytes / 10 if shuffled_bytes is None else shuffled_bytes
    partitions = max(LEAST_PARTITIONS, min(MOST_PARTITIONS, math.ceil(moved / partition_bytes)))
    scan = SCAN_BYTES if table_bytes > 10**13 else partition_bytes
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(scan),
    }


def size_shuffles(spark: SparkSession, table_bytes: int) -> None:
    for key, value in shuffle_settings(table_bytes).items():
        spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which all executors see; where
    that is unset, below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    application = spark.conf.get("spark.app.id", "application")
    return f"{root.rstrip('/')}/rowsieve/{application}"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own each time, so that lazy readers of earlier ones keep their files."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes what was landed at ``path``, once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
