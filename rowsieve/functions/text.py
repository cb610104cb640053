"""Text helpers that give Spark columns Python's notion of blank, strip and ``str()``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that Python's str.strip() removes; all lie at or below U+3000.
WHITESPACE = "".join(char for char in map(chr, range(0x3001)) if char.isspace())

FLOATING = (T.FloatType, T.DoubleType)
COMPLEX = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)

# Long keys are replaced by a digest, so a key never takes more bytes than this plus a tag.
NARROW_KEY_BYTES = 64


def named(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def sql_text(value: str | None) -> str:
    """A string as a SQL literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# A way to use a costly value at several places of an expression.
Let = Callable[[Column, Callable[[Column], Column]], Column]


def inline(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` as it stands. In a projection Spark works out the repeated value
    once and all of it is compiled."""
    return body(value)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once wherever it is used. In a filter,
    where Spark shares nothing, this saves more than its interpreted body costs."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_blank(text: Column) -> Column:
    """Empty or only whitespace. Left trim stops at the first other character."""
    return F.ltrim(text, F.lit(WHITESPACE)) == F.lit("")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_missing(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return value.isNull() | is_blank(value)
    return value.isNull()


def _float_text(value: Column) -> Column:
    """Doubles as Python prints them: plain from 1e-4 up to 1e16, else like ``1e-05``."""
    number = value.cast("double")
    size = F.abs(number)
    java = number.cast("string")
    digits = number.try_cast("decimal(38,21)").cast("string")
    power = F.regexp_replace(java, r"(?:\.0)?E(\d)", "e+$1")
    power = F.regexp_replace(power, r"(?:\.0)?E-(\d)\z", "e-0$1")
    power = F.regexp_replace(power, r"(?:\.0)?E-", "e-")
    special = F.replace(F.replace(power, F.lit("NaN"), F.lit("nan")), F.lit("Infinity"), F.lit("inf"))
    return (
        F.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), java)
        .when((size >= 1e-4) & (size < 1e16), F.regexp_replace(digits, r"(\.\d+?)0+\z", "$1"))
        .otherwise(special)
    )


def as_text(value: Column, dtype: T.DataType) -> Column:
    """The text Python's ``str()`` gives for a value of this type; NULL stays NULL."""
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, T.BooleanType):
        return F.when(value, F.lit("True")).when(~value, F.lit("False"))
    if isinstance(dtype, FLOATING):
        return _float_text(value)
    if isinstance(dtype, TIMESTAMPS):
        whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        exact = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return F.when(exact.endswith(".000000"), whole).otherwise(exact)
    return value.cast("string")


def narrow_key(value: Column, dtype: T.DataType) -> Column:
    """A grouping key of bounded width that is equal exactly when the values are.

    Short text goes as it is behind a 0 byte, long text as SHA-256 behind a 1 byte, so
    whole documents never travel through a shuffle to be counted. Other types stay put.
    """
    if not isinstance(dtype, (T.StringType, T.BinaryType)):
        return value
    raw = value.cast("binary")
    return F.when(
        F.octet_length(raw) <= NARROW_KEY_BYTES, F.concat(F.lit(b"\x00"), raw)
    ).when(
        raw.isNotNull(), F.concat(F.lit(b"\x01"), F.unhex(F.sha2(raw, 256)))
    )
