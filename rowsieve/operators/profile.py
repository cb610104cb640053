"""``profile``: one row per column with kind, null count, samples and suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsieve.functions.text import FLOATING, as_text, named, sql_text
from rowsieve.operators.duplicates import has_positions, with_positions
from rowsieve.rules import ID_WORDS

KIND_ROWS = 10
SAMPLE_ROWS = 5
COLUMNS_PER_SCAN = 90

# Name parts that suggest a validator, first match wins, and the marks
# and least length of text that looks like a date.
VALIDATOR_HINTS = (
    ("tckn", ("tc", "tckn", "kimlik")),
    ("tr_iban", ("iban",)),
    ("phone_tr", ("tel", "telefon", "phone", "gsm", "cep")),
    ("vkn", ("vkn", "vergi")),
)
DATE_MARKS = "[-/:]"
DATE_LENGTH = 8

_HEAD = "__head"


def profile(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """Columns: column_position, column, kind, is_id_like, suggested_validator, row_count,
    column_count, null_count, sample.

    One aggregate over the table gives the counts. Kind and sample look at the first rows
    only; without ``order_by`` those are the first rows Spark reads.
    """
    counts = null_counts(df)
    looks = _looks(df, order_by)
    name = F.lower("column")
    hint: Column = F.lit(None).cast("string")
    for validator, words in reversed(VALIDATOR_HINTS):
        hint = F.when(name.rlike("|".join(words)), F.lit(validator)).otherwise(hint)
    return counts.join(F.broadcast(looks), "column_position").select(
        "column_position",
        "column",
        "kind",
        name.rlike("|".join(ID_WORDS)).alias("is_id_like"),
        hint.alias("suggested_validator"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        "null_count",
        "sample",
    ).orderBy("column_position")


def null_counts(df: DataFrame) -> DataFrame:
    """column_position, column, row_count, null_count. Blank text is not counted as null."""
    numbered = list(enumerate(df.columns, start=1))
    parts = []
    for start in range(0, len(numbered), COLUMNS_PER_SCAN):
        batch = numbered[start : start + COLUMNS_PER_SCAN]
        counted = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count(named(name)).alias(f"present_{place}") for place, name in batch],
        )
        rows = [
            f"named_struct('column_position', {place}, 'column', {sql_text(name)}, "
            f"'row_count', rows, 'null_count', rows - present_{place})"
            for place, name in batch
        ]
        parts.append(counted.selectExpr(f"inline(array({', '.join(rows)}))"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def first_rows_of(df: DataFrame, order_by: Sequence[str] | None, count: int) -> DataFrame:
    """The first ``count`` rows. The leading order column alone is read to find where they
    end; that bound is then pushed to the scan, which skips the rest of the table. Without
    ``order_by`` a table with file positions gives its first rows by file and position,
    and any other table the rows that come first."""
    if not order_by:
        if not has_positions(df):
            return df.limit(count)
        placed, order = with_positions(df)
        return first_rows_of(placed, order, count).select(*[named(name) for name in df.columns])
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    lead = named(order[0])
    last = df.select(lead.alias("lead")).orderBy("lead").limit(count).agg(
        F.max("lead").alias("last"), F.count(F.lit(1)).alias("n")
    ).first()
    bounded = df
    if last["n"] == count and last["last"] is not None:
        bounded = df.filter(lead.isNull() | (lead <= F.lit(last["last"])))
    return bounded.orderBy(*[named(name) for name in order]).limit(count)


def _looks(df: DataFrame, order_by: Sequence[str] | None) -> DataFrame:
    """column_position, kind, sample: worked out from one array holding the first rows."""
    order = [order_by] if isinstance(order_by, str) else list(order_by or [])
    fields = df.schema.fields
    if not order and has_positions(df):
        df, order = with_positions(df)
    texts = [
        as_text(named(field.name), field.dataType).alias(f"c{place}")
        for place, field in enumerate(fields, start=1)
    ]
    rank = [named(name).alias(f"o{place}") for place, name in enumerate(order)]
    head = first_rows_of(df, order, KIND_ROWS).select(F.struct(*rank, *texts).alias("row"))
    gathered = F.collect_list("row")
    packed = head.agg((F.array_sort(gathered) if rank else gathered).alias(_HEAD))
    rows = [
        f"named_struct('column_position', {place}, "
        f"'kind', {_kind(field.dataType, _values(place, KIND_ROWS))}, "
        f"'sample', {_values(place, SAMPLE_ROWS)})"
        for place, field in enumerate(fields, start=1)
    ]
    return packed.selectExpr(f"inline(array({', '.join(rows)}))")


def _values(place: int, rows: int) -> str:
    """The texts of one column in the first rows, without the missing ones."""
    return f"array_compact(slice({_HEAD}.c{place}, 1, {rows}))"


def _kind(dtype: T.DataType, values: str) -> str:
    first = f"get({values}, 0)"
    if isinstance(dtype, T.BooleanType):
        known = "'boolean'"
    elif isinstance(dtype, (T.IntegralType, T.DecimalType, *FLOATING)):
        known = "'number'"
    elif isinstance(dtype, T.StringType):
        dated = f"{first} RLIKE '{DATE_MARKS}' AND length({first}) >= {DATE_LENGTH}"
        known = f"CASE WHEN {dated} THEN 'date' ELSE 'text' END"
    else:
        known = "'unknown'"
    return f"CASE WHEN {first} IS NULL THEN 'unknown' ELSE {known} END"
