"""What the corpus operators share: tables, words, durable intermediate results, places."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsieve.plans.cluster import drop_folder

# White space between words: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WORDS_PER_SHINGLE = 5
LEAST_SIMILARITY = 0.8


# What Spark hands to a Python worker at a time: texts may be long.
BYTES_PER_BATCH = 16 * 1024 * 1024


def small_batches(spark: SparkSession, most: int = BYTES_PER_BATCH) -> None:
    """Keeps what a Python worker gets at once within bounds; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = int(spark.conf.get(name).removesuffix("b"))
    if had <= 0 or had > most:
        spark.conf.set(name, str(most))


# Spark drops a query's shuffle files as soon as the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# Folders that the innermost ``passing`` deletes at its end.
_PASSING: ContextVar[list[str] | None] = ContextVar("_PASSING", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is ``stored`` inside is deleted at the end, but for what the given function stores."""
    folders: list[str] = []
    before = _PASSING.set(folders)

    def keep(df: DataFrame) -> DataFrame:
        found, path = stored_at(df)
        folders.remove(path)
        outer = before.old_value if before.old_value is not before.MISSING else None
        if outer is not None:
            outer.append(path)
        return found

    try:
        yield keep
    finally:
        _PASSING.reset(before)
        for path in folders:
            drop_folder(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows that a task writes at least, where their number is known beforehand.
ROWS_PER_FILE = 50_000


def stored(df: DataFrame, most: int | None = None, each: int = ROWS_PER_FILE) -> DataFrame:
    """The rows written once as Parquet in the shared folder, and read back.

    ``most`` is a number that the rows do not exceed: then there are no more files than it
    takes at ``each`` rows a file, however many partitions the shuffles before have.

    Cuts lineage: an executor lost later costs no recomputation, and no value read twice
    can differ between reads. The folder is the one that ``spark.checkpoint.dir`` names, or
    the warehouse where that is unset; clearing it is up to whoever provides it.
    """
    return stored_at(df if most is None else df.coalesce(max(1, -(-most // each))))[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``stored``, with the folder, for a caller that deletes it when done."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/rowsieve-llm/{uuid.uuid4().hex}"
    # Nobody reads the shuffle files of a result that is written.
    had = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, had)
    if (folders := _PASSING.get()) is not None:
        folders.append(path)
    return spark.read.schema(df.schema).parquet(path), path


# Bits of the bitmaps that go to tasks, in 64-bit words: 16 MB, whatever they are made from.
BITMAP_BITS = 2**27


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """A bit for the leading bits of each of these longs; OR-ed together by Spark, so the
    driver gets at most the bitmap's own words."""
    words = BITMAP_BITS // 64
    place = F.shiftrightunsigned(column, 64 - (BITMAP_BITS.bit_length() - 1))
    bit = F.expr("shiftleft(1L, int(_place % 64))")
    rows = (
        hashes.select(place.alias("_place"))
        .groupBy((F.col("_place") / 64).cast("int").alias("at"))
        .agg(F.bit_or(bit).alias("bits"))
        .toArrow()
    )
    out = np.zeros(words, dtype=np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash (uint64) is set."""
    place = hashes >> np.uint64(64 - ((len(bits) * 64).bit_length() - 1))
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def full_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Number of maximal runs of other characters than ``BLANKS``; 0 for NULL."""
    # Java's split keeps at most one empty piece in front, once the end is trimmed.
    trimmed = F.regexp_replace(full_text(column), rf"^{BLANKS}|{BLANKS}$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, BLANKS))).cast("long")


def with_copies(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Equal rows merged, before any shuffle where they meet; ``copies`` has their number."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))


def placed(
    rows: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], weight: Column
) -> DataFrame:
    """Adds each row's ``before`` (rows) and ``weight_before`` in its group, in bucket order.

    A group may hold any share of the rows: it is sorted bucket by bucket, and only the
    buckets' totals are summed along the group. ``rows`` come from ``with_copies`` and are
    read twice, so they should be stored. ``group`` and ``bucket`` must not be NULL.
    """
    names, copies = [*group, bucket], F.col("copies")
    totals = rows.groupBy(*names).agg(
        F.sum(copies).alias("_n"), F.sum(copies * weight).alias("_w")
    )
    along = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *names,
        F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum("_w").over(along), F.lit(0)).alias("_weight"),
    )
    inside = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        "*",
        F.coalesce(F.sum(copies).over(inside), F.lit(0)).alias("_in_rows"),
        F.coalesce(F.sum(copies * weight).over(inside), F.lit(0)).alias("_in_weight"),
    )
    return (
        local.join(offsets, names)
        .withColumn("before", F.col("_rows") + F.col("_in_rows"))
        .withColumn("weight_before", F.col("_weight") + F.col("_in_weight"))
        .drop("_rows", "_weight", "_in_rows", "_in_weight")
    )


def each_copy(rows: DataFrame) -> DataFrame:
    """One row for each copy again, with ``copy`` counting from 0."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))


def neutral(df: DataFrame, *names: str) -> tuple[DataFrame, list[str], list[Column]]:
    """``df`` with its columns renamed ``__in_0``, ``__in_1``, ...; the new names of
    ``names``; and the Columns that give the input's columns back under their own names.
    Operators that add columns of their own work on this form, so that no column of the
    input, whatever its name, meets one of theirs."""
    renamed = [f"__in_{place}" for place in range(len(df.columns))]
    inner = df.toDF(*renamed)
    where = {name: new for name, new in zip(df.columns, renamed)}
    back = [F.col(new).alias(name) for name, new in zip(df.columns, renamed)]
    return inner, [where[name] for name in names], back
