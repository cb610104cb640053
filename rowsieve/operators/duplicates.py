"""Marking duplicate rows: every row of a key but the first in row order.

A window over the key would send all copies of a hot key to one task. Instead the first
row of each key is found by an aggregate, which merges copies before the shuffle, and
the rows are compared with it:

* few repeated keys, be it with many rows each: those keys are broadcast. Their number
  is known, or at most the number of duplicates, and their width is bounded, so their
  size is proven before the hint is given. The table itself is not shuffled.
* many repeated keys: the first rows are joined on row order. That key is unique, so
  the join spreads evenly however skewed the duplicated keys are.

Row order is made unique by file positions before either way is taken, so both mark the same
rows, and as many as a uniqueness rule counts, whatever ties or NULLs the given order has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsieve.functions.text import NARROW_KEY_BYTES, named
from rowsieve.operators.validate import key_columns
from rowsieve.plans.cluster import fresh_folder
from rowsieve.sources.readers import land

BROADCAST_BYTES = 32 * 1024 * 1024
# Row header, null bits and offsets of one entry in the broadcast hash table.
ENTRY_OVERHEAD_BYTES = 64

# A path is taken to be this long, rather than measured by one more scan.
LONGEST_PATH_BYTES = 1024
FILE_POSITION = ("__file_path", "__row_index")


class RowOrderError(ValueError):
    """The first row of a key is asked for, but the rows have no order."""


def with_row_order(df: DataFrame, order_by: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """The table and the columns giving its row order, unique per row.

    Rows go by ``order_by``, NULL first, and where that ties by file and position in the
    file. A table without positions is taken as it is if ``order_by`` tells all of its rows
    apart, which one job over these columns finds out, and landed as Parquet if not.
    """
    wanted = [order_by] if isinstance(order_by, str) else list(order_by or ())
    try:
        placed, place = _with_positions(df)
    except RowOrderError:
        if not wanted:
            raise
        if not count_duplicates(df, tuple(wanted)).rows:
            return df, wanted
        spark = df.sparkSession
        placed, place = _with_positions(land(df, fresh_folder(spark, "landed/ordered")))
    return placed, [*wanted, *place]


def has_positions(df: DataFrame) -> bool:
    """Whether the rows of ``df`` have file positions, as rows read from Parquet have."""
    try:
        _with_positions(df)
    except RowOrderError:
        return False
    return True


def with_positions(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table with its file path and row index, and their names; RowOrderError where
    its rows have no positions."""
    return _with_positions(df)


def _with_positions(df: DataFrame) -> tuple[DataFrame, list[str]]:
    try:
        placed = df.select(
            "*",
            F.col("_metadata.file_path").alias(FILE_POSITION[0]),
            F.col("_metadata.row_index").alias(FILE_POSITION[1]),
        )
        placed.schema  # noqa: B018 - forces analysis, which is where the columns may be missing
        return placed, list(FILE_POSITION)
    except AnalysisException as exc:
        raise RowOrderError(
            "row order is needed to tell the first row from its duplicates: pass order_by, "
            "or read the table from Parquet"
        ) from exc


@dataclass(frozen=True)
class Duplicates:
    """How many rows repeat an earlier row's key, and how many keys have such rows."""

    rows: int
    keys: int | None = None


def count_duplicates(df: DataFrame, keys: tuple[str, ...]) -> Duplicates:
    per_key = df.select(*key_columns(df, keys)).groupBy(*_key_names(keys)).count()
    counted = per_key.selectExpr("coalesce(sum(count - 1), 0L)", "count_if(count > 1)").first()
    return Duplicates(*counted)


def _key_names(keys: tuple[str, ...]) -> list[str]:
    return [f"__key_{place}" for place in range(len(keys))]


def _first_names(order: list[str]) -> list[str]:
    return [f"__first_{place}" for place in range(len(order))]


def _order_value(names: list[str]) -> Column:
    # A struct compares NULL as smaller than all values, where min() of a bare column would
    # pass over it and a comparison give NULL.
    return F.struct(*[named(name).alias(f"o{place}") for place, name in enumerate(names)])


def _keys_and_order(df: DataFrame, keys: tuple[str, ...], order: list[str]) -> DataFrame:
    return df.select(*key_columns(df, keys), _order_value(order).alias("__order"))


def first_rows(
    rows: DataFrame, keys: tuple[str, ...], order: list[str], least: int = 1
) -> DataFrame:
    """The order of the first row of each key that has at least ``least`` rows."""
    found = rows.groupBy(*_key_names(keys)).agg(
        F.min("__order").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    first = F.col("__first")
    parts = [first[f"o{place}"] for place in range(len(order))]
    return found.filter(F.col("__n") >= least).select(
        *[F.col(name).alias(f"{name}_r") for name in _key_names(keys)],
        *[part.alias(name) for part, name in zip(parts, _first_names(order), strict=True)],
        F.lit(True).alias("__hit"),
    )


def _first_of_repeated(df: DataFrame, keys: tuple[str, ...], order: list[str]) -> DataFrame:
    """First rows of the keys seen more than once, which are known to be few.

    Rows of other keys are dropped before the aggregate, by a count that hashes, so that
    only rows of repeated keys are ever sorted.
    """
    rows = _keys_and_order(df, keys, order)
    names = _key_names(keys)
    repeated = rows.groupBy(*names).count().filter(F.col("count") > 1)
    repeated = repeated.select(*[F.col(name).alias(f"{name}_r") for name in names])
    suspects = rows.join(F.broadcast(repeated), _same(names), "left_semi")
    return first_rows(suspects, keys, order)


def fits_broadcast(
    df: DataFrame, keys: tuple[str, ...], order: list[str], entries: int, limit: int
) -> bool:
    """Whether so many keys, each with its first row's order, surely fit in ``limit`` bytes."""
    types = {field.name: field.dataType for field in df.schema.fields}
    width = ENTRY_OVERHEAD_BYTES + sum(_key_bytes(types[name]) for name in keys)
    if entries * width > limit:
        return False
    # A file's path is part of the order only where positions stand in for it.
    if FILE_POSITION[0] in order:
        width += LONGEST_PATH_BYTES
    order = [name for name in order if name not in FILE_POSITION]
    texts = [name for name in order if isinstance(types[name], (T.StringType, T.BinaryType))]
    width += 16 * (len(order) - len(texts))
    if texts:
        longest = df.agg(*[F.max(F.octet_length(named(name))) for name in texts]).first()
        width += sum(size or 0 for size in longest)
    return entries * width <= limit


def _key_bytes(dtype: T.DataType) -> int:
    return NARROW_KEY_BYTES + 16 if isinstance(dtype, (T.StringType, T.BinaryType)) else 16


def _few_keys(
    df: DataFrame, keys: tuple[str, ...], order: list[str], found: Duplicates, limit: int
) -> bool:
    if found.keys is None:
        if fits_broadcast(df, keys, order, found.rows, limit):
            return True
        # One hot key may own all duplicates. Counting narrow keys once more is cheap
        # beside shuffling whole rows.
        found = count_duplicates(df, keys)
    return fits_broadcast(df, keys, order, found.keys, limit)


def mark_duplicates(
    df: DataFrame,
    keys: tuple[str, ...],
    order: list[str],
    flag: str,
    found: Duplicates,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Adds the boolean ``flag``, TRUE for each of the ``found`` rows."""
    if found.rows == 0:
        return df.withColumn(flag, F.lit(False))
    names, firsts = _key_names(keys), _first_names(order)
    here = _order_value(order)
    keyed = df.withColumns(dict(zip(names, key_columns(df, keys), strict=True)))
    if _few_keys(df, keys, order, found, broadcast_bytes):
        leaders = F.broadcast(_first_of_repeated(df, keys, order))
        matched = keyed.join(leaders, _same(names), "left")
        repeats = F.col("__hit").isNotNull() & (here > _order_value(firsts))
    else:
        leaders = first_rows(_keys_and_order(df, keys, order), keys, order)
        at_first = [
            named(name).eqNullSafe(F.col(first)) for name, first in zip(order, firsts, strict=True)
        ]
        # The keys join in as well, so that an order value shared by two rows of
        # different keys cannot multiply rows.
        matched = keyed.join(leaders, reduce(and_, at_first) & _same(names), "left")
        repeats = F.col("__hit").isNull()
    extra = [*names, *[f"{name}_r" for name in names], *firsts, "__hit"]
    return matched.withColumn(flag, repeats).drop(*extra)


def _same(names: list[str]) -> Column:
    """NULL keys are equal to each other, as every other value is to itself."""
    return reduce(and_, [F.col(name).eqNullSafe(F.col(f"{name}_r")) for name in names])


def duplicate_rows(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    duplicates: int | None = None,
) -> DataFrame:
    """The rows that repeat an earlier row's key. If their number is not given, for instance
    from a uniqueness result, one job counts them first."""
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    placed, order = with_row_order(df, order_by)
    found = count_duplicates(df, keys) if duplicates is None else Duplicates(duplicates)
    marked = mark_duplicates(placed, keys, order, "__duplicate", found, broadcast_bytes)
    return marked.filter("__duplicate").select(*[named(name) for name in df.columns])
