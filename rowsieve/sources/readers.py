"""Table sources: CSV and JSON with null and type clean-up, Parquet, ORC and catalog tables."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsieve.functions.numbers import FLOAT_TEXT
from rowsieve.functions.text import FLOATING, named
from rowsieve.functions.validators import TEXT_VALIDATORS, validator_name
from rowsieve.rules import Rule

# Text that stands for a missing cell in CSV files, as pandas reads it.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
BOOLEAN_WORDS = ("True", "TRUE", "true", "False", "FALSE", "false")
FORMATS = {
    ".csv": "csv",
    ".json": "json",
    ".jsonl": "json",
    ".ndjson": "json",
    ".parquet": "parquet",
    ".orc": "orc",
}
# Four counts per column; one aggregate stays inside whole-stage codegen below 100 fields.
COLUMNS_PER_SCAN = 24


def supports(path: str) -> bool:
    return PurePosixPath(path).suffix.lower() in FORMATS


def read(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read by format name or file extension. ``fmt='table'`` reads a catalog table."""
    if fmt == "table":
        return null_nans(spark.table(path))
    suffix = PurePosixPath(path).suffix.lower()
    kind = fmt or FORMATS.get(suffix)
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind == "json":
        options.setdefault("lines", suffix in (".jsonl", ".ndjson"))
        return read_json(spark, path, **options)
    if kind in ("parquet", "orc"):
        return null_nans(spark.read.format(kind).options(**options).load(path))
    raise ValueError(f"no reader for {path!r}; known: {', '.join(FORMATS)}")


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    encoding: str = "UTF-8",
    keep_text: Iterable[str] = (),
    infer: bool = True,
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
    rules: Iterable[Rule] = (),
) -> DataFrame:
    """CSV with a header row. Cells that spell a missing value become NULL.

    Types are the narrowest each whole column fits, which costs one extra pass; give a
    ``schema`` to save it. Columns in ``keep_text`` stay text, so that identifiers keep
    their leading zeros and plus signs; so do columns whose ``rules`` read them as text.
    Quoted line breaks need ``multi_line``, which
    makes each file one task. Code pages other than the Unicode ones and Latin-1, such as
    windows-1254, need ``spark.sql.legacy.javaCharsets=true`` in the session.
    """
    reader = spark.read.options(
        header=True, sep=sep, encoding=encoding, multiLine=multi_line, quote='"', escape='"'
    )
    if schema is not None:
        return null_tokens(null_nans(reader.options(nullValue="").schema(schema).csv(path)))
    text = null_tokens(reader.csv(path))
    return infer_types(text, {*keep_text, *text_columns(rules)}) if infer else text


def read_json(
    spark: SparkSession,
    path: str,
    lines: bool = False,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """An array of records per file, or with ``lines`` one record per line, which splits."""
    if schema is not None:
        return null_nans(spark.read.schema(schema).json(path, multiLine=not lines))
    df = null_nans(spark.read.json(path, multiLine=not lines))
    # Spark sorts the columns it finds by name. They come in the first record's order again,
    # with those that it lacks behind.
    first = [name for name in _first_record(spark, path) if name in df.columns]
    return df.select(*[named(name) for name in dict.fromkeys([*first, *df.columns])])


def _first_record(spark: SparkSession, path: str) -> list[str]:
    """The names in the first record, from no more lines, and no more characters of each,
    than it takes to close it. Lines are cut on the executors, so a file that holds its
    whole array in one line sends the driver its beginning only."""
    lines, width = 64, 4096
    while True:
        cut = spark.read.text(path).select(
            F.substring("value", 1, width).alias("head"), (F.length("value") > width).alias("longer")
        )
        rows = cut.limit(lines).collect()
        text = "\n".join(row["head"] for row in rows).lstrip("\ufeff \t\r\n[")
        try:
            record, _ = json.JSONDecoder().raw_decode(text)
        except ValueError:
            longer = any(row["longer"] for row in rows)
            if len(rows) < lines and not longer:
                return []
            lines, width = (lines * 8 if len(rows) == lines else lines), (width * 8 if longer else width)
        else:
            return list(record) if isinstance(record, dict) else []


def text_columns(rules: Iterable[Rule]) -> set[str]:
    """Columns that a rule reads character by character."""
    return {
        rule.column
        for rule in rules
        if rule.column and rule.type == "validity" and validator_name(rule.validator) in TEXT_VALIDATORS
    }


def land(df: DataFrame, path: str) -> DataFrame:
    """Write the table as Parquet and read it back. This gives rows of any source a lasting
    order and later scans only the columns they need; ``path`` must be seen by all executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def null_nans(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column."""
    return df.select(
        *[
            F.when(~F.isnan(named(field.name)), named(field.name)).alias(field.name)
            if isinstance(field.dataType, FLOATING)
            else named(field.name)
            for field in df.schema.fields
        ]
    )


def null_tokens(df: DataFrame, tokens: Iterable[str] = NA_TOKENS) -> DataFrame:
    """Text equal to one of the tokens becomes NULL; text of blanks only is kept."""
    tokens = list(tokens)
    return df.select(
        *[
            F.when(~named(field.name).isin(*tokens), named(field.name)).alias(field.name)
            if isinstance(field.dataType, T.StringType)
            else named(field.name)
            for field in df.schema.fields
        ]
    )


def infer_types(df: DataFrame, keep_text: Iterable[str] = ()) -> DataFrame:
    """Cast each text column to bigint, double or boolean if all of its values fit."""
    kept = set(keep_text)
    names = [
        field.name
        for field in df.schema.fields
        if isinstance(field.dataType, T.StringType) and field.name not in kept
    ]
    found: dict[str, str] = {}
    for start in range(0, len(names), COLUMNS_PER_SCAN):
        found.update(_narrowest(df, names[start : start + COLUMNS_PER_SCAN]))
    return df.select(
        *[
            _parse(named(name), found[name]).alias(name) if name in found else named(name)
            for name in df.columns
        ]
    )


def _parse(text: Column, kind: str) -> Column:
    trimmed = F.btrim(text)
    if kind == "boolean":
        return F.lower(trimmed).try_cast("boolean")
    return trimmed.try_cast(kind)


def _fits(text: Column) -> dict[str, Column]:
    whole = text.rlike(r"\A *[+-]?[0-9]+ *\z") & _parse(text, "bigint").isNotNull()
    decimal = text.rlike(FLOAT_TEXT) & ~text.contains("_") & _parse(text, "double").isNotNull()
    return {"bigint": whole, "double": whole | decimal, "boolean": text.isin(*BOOLEAN_WORDS)}


def _narrowest(df: DataFrame, names: list[str]) -> dict[str, str]:
    counts = []
    for place, name in enumerate(names):
        counts.append(F.count(named(name)).alias(f"all_{place}"))
        for kind, fits in _fits(named(name)).items():
            counts.append(F.count_if(fits).alias(f"{kind}_{place}"))
    seen = df.agg(*counts).first()
    found = {}
    for place, name in enumerate(names):
        present = seen[f"all_{place}"]
        for kind in ("bigint", "double", "boolean"):
            if present and seen[f"{kind}_{place}"] == present:
                found[name] = kind
                break
    return found
