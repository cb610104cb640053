"""The named queries: every operator, run over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsieve.functions.text import as_text
from rowsieve.functions.validators import register_check
from rowsieve.operators.context import register_table_check
from rowsieve.operators.duplicates import BROADCAST_BYTES, duplicate_rows
from rowsieve.operators.profile import null_counts, profile
from rowsieve.operators.report import blocking_failures, summarise, with_pass_rate
from rowsieve.operators.split import Split, split
from rowsieve.operators.validate import RESULT_COLUMNS, validate
from rowsieve.operators.violations import violations
from rowsieve.plans.cluster import fresh_folder
from rowsieve.plans.runs import run
from rowsieve.rules import Rule, default_rules, rules_from_form
from rowsieve.sources.readers import infer_types, null_nans, null_tokens, read
from rowsieve.sources.writers import (
    compact_history,
    history,
    write_counted_split,
    write_report,
    write_split,
)

Query = Callable[[SparkSession, str], DataFrame]

# Columns that give the NULL-free test tables gaps, mixed text and identifiers. Written
# once, in SQL that Spark and DuckDB read alike.
DERIVED = {
    "gap": "case event_type when 'error' then null when 'view' then '   ' "
    "when 'click' then '' else event_type end",
    "mix": "case event_id % 7 when 0 then '12' when 1 then ' 7 ' when 2 then '1_000' "
    "when 3 then '1.5' when 4 then 'abc' when 5 then null else 'nan' end",
    "some_user": "nullif(user_id % 50, 0)",
    "no_error": "nullif(event_type, 'error')",
    "na_type": "case event_type when 'error' then 'N/A' when 'view' then 'null' else event_type end",
    "nan_value": "case when event_type = 'error' then cast('NaN' as double) else value end",
    "tck": "cast(10000000000 + o_orderkey * 7919 as varchar(20))",
    "vk": "lpad(cast(o_orderkey * 7919 as varchar(20)), 10, '0')",
    "ib": "concat('TR', lpad(cast(o_orderkey % 97 as varchar(20)), 2, '0'), "
    "lpad(cast(o_orderkey * 7919 as varchar(20)), 22, '0'))",
    "ph": "concat(case o_orderkey % 4 when 0 then '0' when 1 then '+90 ' when 2 then '' "
    "else '0212' end, '5', lpad(cast(o_orderkey * 7919 % 1000000000 as varchar(20)), 9, '0'))",
}
URL_PATTERN = "https?://[a-z.]+/[a-z]{2}/[0-9]+.*"


def table(spark: SparkSession, sf_dir: str, name: str, *derived: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({column: F.expr(DERIVED[column]) for column in derived})


def rule(rule_id: str, kind: str, column: str | None = None, **parts) -> Rule:
    return Rule(id=rule_id, name=rule_id, type=kind, column=column, **parts)


def valid(rule_id: str, column: str, validator: str, threshold=None, severity="error", **params):
    return rule(
        rule_id,
        "validity",
        column,
        validator=validator,
        params=params,
        threshold=threshold,
        severity=severity,
    )


ORDER_RULES = [
    rule("priority_present", "completeness", "o_orderpriority", threshold=1.0),
    rule("key_unique", "uniqueness", "o_orderkey", threshold=1.0),
    valid("status_known", "o_orderstatus", "enum", 0.9, allowed_values=["F", "O"]),
    valid(
        "price_range", "o_totalprice", "range", 0.9, "warning", min_value=1000, max_value=400000
    ),
    valid("priority_form", "o_orderpriority", "regex", pattern="[1-5]-[A-Z ]+"),
    rule("absent_column", "completeness", "no_such_column", severity="info"),
]
CUSTOMER_RULES = [
    rule("name_present", "completeness", "c_name"),
    rule("key_unique", "uniqueness", "c_custkey", threshold=1.0),
    valid("balance_range", "c_acctbal", "range", 0.9, min_value=0),
    valid("segment_form", "c_mktsegment", "regex", 1.0, pattern="[A-Z]{8,}"),
]
SPLIT_RULES = [
    valid("balance", "c_acctbal", "range", 0.5, min_value=0, max_value=9000),
    valid(
        "segment",
        "c_mktsegment",
        "enum",
        0.5,
        "warning",
        allowed_values=["BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE"],
    ),
    valid("nation", "c_nationkey", "range", 1.0, "warning", max_value=20),
]
IDENTIFIER_RULES = [
    valid("national_id", "tck", "tc_kimlik"),
    valid("tax_no", "vk", "vergi_no"),
    valid("bank_account", "ib", "iban"),
    valid("mobile", "ph", "telefon"),
]
LINE_KEY = ("l_orderkey", "l_linenumber")
LINE_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def compared(results: DataFrame) -> DataFrame:
    """Results without the display text, whose rounding differs between engines."""
    return results.drop("message")


def checked(name: str, rules: list[Rule], *derived: str, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compared(validate(table(spark, sf_dir, name, *derived), rules, **options))

    return query


def _validate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(with_pass_rate(validate(table(spark, sf_dir, "orders"), ORDER_RULES)))


def _threshold_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = valid("status_known", "o_orderstatus", "enum", allowed_values=["F", "O"])
    score = validate(orders, [status]).first()["score"]
    edge = valid("status_known", "o_orderstatus", "enum", score, allowed_values=["F", "O"])
    return compared(validate(orders, [edge]))


def _threshold_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "gap")
    standard = validate(events, [rule("standard_default", "completeness", "gap")])
    lower = validate(events, [rule("lower_default", "completeness", "gap")], 0.25)
    return compared(standard.unionByName(lower))


def _empty_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [rule_ for rule_ in ORDER_RULES if rule_.column != "no_such_column"]
    return compared(validate(table(spark, sf_dir, "orders").filter("o_orderkey < 0"), rules))


def _form_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rules_from_form(
        [
            {"column": "c_name"},
            {"column": "c_custkey", "type": "uniqueness", "severity": "error"},
            {
                "id": "balance",
                "name": "balance",
                "column": "c_acctbal",
                "type": "validity",
                "validator_type": " RANGE ",
                "params": {"min_value": 0},
                "threshold": 0.99,
            },
        ]
    )
    return compared(validate(table(spark, sf_dir, "customer"), rules))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = validate(table(spark, sf_dir, "events", "gap"), [
        rule("gap_present", "completeness", "gap"),
        rule("user_unique", "uniqueness", "user_id", threshold=0.001),
        valid("type_known", "event_type", "enum", allowed_values=["view", "click"]),
        rule("absent_column", "completeness", "no_such_column"),
    ])
    return results.select("rule_position", "rule_id", "status", "message")


def _violations_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = [SPLIT_RULES[0], SPLIT_RULES[2]]
    return violations(table(spark, sf_dir, "customer"), active, ["c_custkey"])


def _violations_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        rule("text_unique", "uniqueness", "text"),
        valid("lang_known", "lang", "enum", allowed_values=["en", "fr", "de"]),
    ]
    found = violations(table(spark, sf_dir, "documents"), rules, ["doc_id"])
    return found.select("doc_id", "rule_position", "rule_id", "column", "value")


def _duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_rows(table(spark, sf_dir, "documents"), ["text"], ["doc_id"])


def _duplicate_rows_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_rows(table(spark, sf_dir, "lineitem"), LINE_KEY, LINE_ORDER)


def _duplicate_rows_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return duplicate_rows(lines, LINE_KEY, LINE_ORDER, broadcast_bytes=0)


def _customer_split(spark: SparkSession, sf_dir: str) -> Split:
    return split(table(spark, sf_dir, "customer"), SPLIT_RULES)


def _document_split(spark: SparkSession, sf_dir: str) -> Split:
    rules = [
        rule("text_unique", "uniqueness", "text", threshold=0.5),
        valid("long_enough", "n_chars", "range", 0.5, min_value=200),
    ]
    return split(table(spark, sf_dir, "documents"), rules, order_by=["doc_id"])


def _line_split(spark: SparkSession, sf_dir: str) -> Split:
    rules = [
        rule("line_unique", "uniqueness", columns=LINE_KEY, threshold=0.5),
        valid("quantity_range", "l_quantity", "range", 1.0, min_value=5),
    ]
    return split(table(spark, sf_dir, "lineitem"), rules, order_by=LINE_ORDER)


def _document_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_split(spark, sf_dir).quarantine


def _split_counts_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of ``split_counts``, observed while the split is written."""
    root = fresh_folder(spark, "customer_counted")
    counts = write_counted_split(_customer_split(spark, sf_dir), root, "customer")[2]
    return spark.createDataFrame([counts], "total_rows long, clean_rows long, quarantine_rows long")


def _line_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_split(spark, sf_dir).counts()


def _line_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_split(spark, sf_dir).quarantine.select(*LINE_KEY, "l_partkey", "violation_reasons")


def _auto_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name in ("nation", "supplier"):
        df = table(spark, sf_dir, name)
        results = compared(validate(df, default_rules(df)))
        parts.append(results.withColumn("table_name", F.lit(name)))
    return parts[0].unionByName(parts[1])


def _custom_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_check("even_number", lambda value, dtype, params: value % 2 != 0)
    rules = [rule("size_even", "even_number", "p_size", threshold=0.4)]
    return compared(validate(table(spark, sf_dir, "part"), rules))


def table_check_types() -> None:
    """Three rule types that weigh a row against the table or its group."""
    register_table_check(
        "group_share",
        lambda value, dtype, params: {"total": F.sum(value)},
        lambda value, dtype, params, stats: value > F.lit(float(params["share"])) * stats["total"],
    )
    register_table_check(
        "outlier",
        lambda value, dtype, params: {"mean": F.avg(value), "spread": F.stddev_samp(value)},
        lambda value, dtype, params, stats: F.abs(value - stats["mean"])
        > F.lit(float(params["limit"])) * stats["spread"],
    )
    register_table_check(
        "determined_by",
        lambda value, dtype, params: {"kinds": F.count_distinct(value)},
        lambda value, dtype, params, stats: stats["kinds"] > 1,
    )


# A line holding more than half of its order's quantity.
LINE_SHARE = rule("line_share", "group_share", "l_quantity", threshold=0.9,
                  params={"group_by": ["l_orderkey"], "share": 0.5})
PRICE_OUTLIER = rule("price_outlier", "outlier", "o_totalprice", threshold=0.9, params={"limit": 2.0})
# Each customer's orders share one priority.
PRIORITY_BY_CUSTOMER = rule("priority_by_customer", "determined_by", "o_orderpriority",
                            threshold=0.5, params={"group_by": "o_custkey"})


# Five key sets, one of them in two rules, counted in one scan.
ALL_LINE_KEYS = [
    rule("order_unique", "uniqueness", "l_orderkey", threshold=0.5),
    rule("line_unique", "uniqueness", columns=LINE_KEY, threshold=1.0),
    rule("part_unique", "uniqueness", "l_partkey", threshold=0.5),
    rule("part_supplier_unique", "uniqueness", columns=("l_partkey", "l_suppkey"), threshold=0.9),
    rule("ship_date_unique", "uniqueness", "l_shipdate", threshold=0.1),
    rule("line_unique_loose", "uniqueness", columns=LINE_KEY, threshold=0.5, severity="warning"),
]


def _table_checked(name: str, rules: list[Rule]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table_check_types()
        return compared(validate(table(spark, sf_dir, name), rules))

    return query


def _table_check_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_check_types()
    parts = split(table(spark, sf_dir, "lineitem"), [LINE_SHARE])
    return parts.quarantine.select(*LINE_KEY, "l_quantity", "violation_reasons")


def _full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(table(spark, sf_dir, "customer"), SPLIT_RULES).summary


def _profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_counts(table(spark, sf_dir, "events", "gap"))


def _profile(*columns: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        profiled = profile(table(spark, sf_dir, "events", "gap"), ["event_id"])
        return profiled.select("column_position", "column", *columns)

    return query


def _profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled = profile(table(spark, sf_dir, "events", "gap"), ["event_id"])
    return profiled.select("column", F.concat_ws("|", "sample").alias("sample"))


def _profile_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "tck", "vk", "ib", "ph")
    named = orders.withColumnsRenamed(
        {"tck": "tc_kimlik", "vk": "vergi_no", "ib": "iban_text", "ph": "telefon"}
    )
    profiled = profile(named, ["o_orderkey"])
    return profiled.select("column", "is_id_like", "suggested_validator", "row_count", "null_count")


def _null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = null_tokens(table(spark, sf_dir, "events", "na_type"))
    return compared(validate(events, [rule("type_present", "completeness", "na_type")]))


def _null_nans(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = null_nans(table(spark, sf_dir, "events", "nan_value"))
    return compared(validate(events, [rule("value_present", "completeness", "nan_value")]))


def _inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders turned to text and back; sums show that the values survive."""
    orders = table(spark, sf_dir, "orders")
    types = {field.name: field.dataType for field in orders.schema.fields}
    text = orders.select(*[as_text(F.col(name), types[name]).alias(name) for name in types])
    typed = infer_types(text, keep_text=["o_custkey"])
    return typed.agg(
        F.max(F.typeof("o_orderkey")).alias("orderkey_type"),
        F.max(F.typeof("o_custkey")).alias("custkey_type"),
        F.max(F.typeof("o_totalprice")).alias("totalprice_type"),
        F.max(F.typeof("o_orderstatus")).alias("orderstatus_type"),
        F.sum("o_orderkey").alias("orderkey_sum"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("totalprice_sum"),
    )


def _round_trip(fmt: str, **options) -> Query:
    """Orders written as text files to the shared folder, read back and validated."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = fresh_folder(spark, f"orders_{fmt}")
        orders = table(spark, sf_dir, "orders")
        orders.write.mode("overwrite").option("header", True).format(fmt).save(path)
        return compared(validate(read(spark, path, fmt, **options), ORDER_RULES))

    return query


SCHEMA_RULES = [
    rule("type_present", "completeness", "na_type", threshold=1.0),
    valid("type_known", "na_type", "enum", 0.5, allowed_values=["view", "click", "purchase"]),
    valid("value_range", "value", "range", 0.5, min_value=5),
]


def _csv_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that spell a missing value are missing with a schema too."""
    path = fresh_folder(spark, "events_csv")
    events = table(spark, sf_dir, "events", "na_type").select("event_id", "na_type", "value")
    events.write.option("header", True).csv(path)
    df = read(spark, path, "csv", schema="event_id bigint, na_type string, value double")
    return compared(validate(df, SCHEMA_RULES))


def _json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are one array of records each; the columns keep the records' order."""
    path = fresh_folder(spark, "labels_json")
    records = F.to_json(F.struct("toxic", "quality", "doc_id"))
    # A thousand ids to an array, and one array to a folder.
    part = F.floor(F.col("doc_id") / 1000).alias("part")
    labels = table(spark, sf_dir, "labels").select(part, records.alias("one"))
    arrays = labels.groupBy("part").agg(F.collect_list("one").alias("all"))
    joined = F.concat(F.lit("["), F.array_join("all", ",\n"), F.lit("]"))
    arrays.select("part", joined.alias("value")).write.partitionBy("part").text(path)
    df = read(spark, f"{path}/*", "json")
    order = ",".join(df.columns)
    return df.agg(
        F.lit(order).alias("column_order"),
        F.count(F.lit(1)).alias("row_count"),
        F.sum("doc_id").alias("doc_id_sum"),
        F.sum("quality").alias("quality_sum"),
        F.sum("toxic").alias("toxic_sum"),
    )


def _identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers read from CSV stay text where a rule reads them so."""
    path = fresh_folder(spark, "identifiers_csv")
    orders = table(spark, sf_dir, "orders", "tck", "vk", "ib", "ph")
    orders.select("o_orderkey", "tck", "vk", "ib", "ph").write.option("header", True).csv(path)
    return compared(validate(read(spark, path, "csv", rules=IDENTIFIER_RULES), IDENTIFIER_RULES))


def _enum_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").withColumn(
        "tenths", F.col("l_discount").cast("decimal(10,2)")
    )
    return compared(
        validate(parts, [valid("listed", "tenths", "enum", allowed_values=[0.5, 0, 0.1])])
    )


def _tied(limit: int, order: str = "lang") -> Query:
    """Repeats of a language, in an order that ties for all of them, counted."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        documents = table(spark, sf_dir, "documents")
        if order not in documents.columns:
            documents = documents.withColumn(order, F.expr("nullif(doc_id % 3, 0)"))
        marked = duplicate_rows(documents, ["lang"], [order], broadcast_bytes=limit)
        return marked.groupBy("lang").agg(F.count(F.lit(1)).alias("repeats"))

    return query


def _split_counts_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [rule("lang_unique", "uniqueness", "lang", threshold=1.0)]
    return split(table(spark, sf_dir, "documents"), rules, order_by=["lang"]).counts()


def _in_row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing rows in row order; each row's number in the sorted result shows it."""
    found = violations(
        table(spark, sf_dir, "customer"), SPLIT_RULES, ["c_custkey"], in_row_order=True
    )
    return numbered(found.select("c_custkey", "rule_position"), "c_custkey", ["rule_position"])


# Keys of one bucket when rows are numbered in order.
BUCKET_WIDTH = 1024


def numbered(rows: DataFrame, key: str, then: list[str]) -> DataFrame:
    """Adds ``row_number``, the place of each row in the order of the integer ``key`` and
    ``then``. Rows are numbered within buckets of ``BUCKET_WIDTH`` keys, in as many tasks,
    and each bucket starts after the rows of all buckets before it, which a window over
    one row per bucket sums; no task sees all rows."""
    bucket = F.floor(F.col(key) / F.lit(BUCKET_WIDTH)).alias("_bucket")
    rows = rows.select("*", bucket)
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key, *then))
    return rows.join(starts, "_bucket").select(
        *[name for name in rows.columns if name != "_bucket"],
        (F.col("_start") + inside).cast("long").alias("row_number"),
    )


def _sink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_folder(spark, "customer_rows")
    write_split(_customer_split(spark, sf_dir), root, "customer")
    rows = spark.read.parquet(f"{root}/rows")
    return rows.groupBy("run_id", F.col("sieve_outcome").alias("outcome")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("violation_reasons").alias("reason_count"),
        F.sum("c_custkey").alias("custkey_sum"),
    )


def _sink_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_folder(spark, "customer_report")
    verdicts = validate(table(spark, sf_dir, "customer"), SPLIT_RULES).collect()
    write_report(spark, verdicts, root, "customer", source="customer")
    written = spark.read.json(f"{root}/results")
    return written.select("run_id", "source", "rule_id", "status", "score", "failed_count")


def _sink_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over two days, the first one repeated on the second day, the first day
    compacted: the history holds each run once."""
    root = fresh_folder(spark, "customer_history")
    verdicts = validate(table(spark, sf_dir, "customer"), SPLIT_RULES).collect()
    for run_id, day in (("run0", "2026-01-01"), ("run1", "2026-01-01"), ("run2", "2026-01-02"), ("run0", "2026-01-02")):
        write_report(spark, verdicts, root, run_id, source="customer", run_date=day)
    compact_history(spark, root, "2026-01-01")
    return history(spark, root).select("run_id", "rule_id", "status", "score", "failed_count")


QUERIES: dict[str, Query] = {
    "completeness_gaps": checked("events", [rule("gap_present", "completeness", "gap")], "gap"),
    "completeness_full": checked(
        "orders", [rule("priority_present", "completeness", "o_orderpriority")]
    ),
    "completeness_text": checked("documents", [rule("text_present", "completeness", "text")]),
    "uniqueness_single": checked("orders", [rule("key_unique", "uniqueness", "o_orderkey")]),
    "uniqueness_text": checked("documents", [rule("text_unique", "uniqueness", "text")]),
    "uniqueness_all_keys": checked("lineitem", ALL_LINE_KEYS),
    "uniqueness_null_keys": checked(
        "events", [rule("user_unique", "uniqueness", "some_user")], "some_user"
    ),
    "uniqueness_composite": checked(
        "lineitem", [rule("line_unique", "uniqueness", columns=LINE_KEY)]
    ),
    "uniqueness_turns": checked(
        "conversations",
        [
            rule("turn_unique", "uniqueness", columns=("conv_id", "turn"), threshold=1.0),
            rule("said_once", "uniqueness", columns=("role", "text"), severity="info"),
        ],
    ),
    "validity_regex": checked("pages", [valid("url_form", "url", "regex", pattern=URL_PATTERN)]),
    "validity_regex_number": checked(
        "customer",
        [valid("two_decimals", "c_acctbal", "regex", pattern=r"-?[0-9]+\.[0-9]{2}")],
    ),
    "validity_regex_empty": checked("events", [valid("no_pattern", "gap", "regex")], "gap"),
    "validity_enum": checked(
        "orders", [valid("status_known", "o_orderstatus", "enum", allowed_values=["F", "O"])]
    ),
    "validity_enum_null": checked(
        "events",
        [
            valid(
                "null_fails", "no_error", "enum", allowed_values=["view", "click", "purchase"]
            ),
            valid(
                "null_listed",
                "no_error",
                "enum",
                allowed_values=["view", "click", "purchase", None],
            ),
            valid("nothing_allowed", "no_error", "enum", allowed_values=[]),
        ],
        "no_error",
    ),
    "validity_enum_typed": checked(
        "labels",
        [
            valid("number_as_text", "quality", "enum", allowed_values=["1", 0]),
            valid("number_as_float", "quality", "enum", allowed_values=[1.0, 0.5]),
            valid("truth_value", "toxic", "enum", allowed_values=[True]),
        ],
    ),
    "validity_dtype_int": checked(
        "events", [valid("int_text", "mix", "dtype", expected_type="int")], "mix"
    ),
    "validity_dtype_float": checked(
        "events", [valid("float_text", "mix", "dtype", expected_type="float")], "mix"
    ),
    "validity_dtype_str": checked(
        "events", [valid("str_text", "mix", "dtype", expected_type="str")], "mix"
    ),
    "validity_dtype_bool": checked(
        "events", [valid("bool_text", "mix", "dtype", expected_type="bool")], "mix"
    ),
    "validity_range": checked(
        "customer", [valid("balance", "c_acctbal", "range", min_value=0, max_value=9000)]
    ),
    "validity_range_open": checked(
        "lineitem", [valid("quantity", "l_quantity", "range", min_value=5)]
    ),
    "validity_range_text": checked(
        "events", [valid("mix_range", "mix", "range", min_value=0, max_value=100)], "mix"
    ),
    "validity_range_nan": checked(
        "events", [valid("value_range", "nan_value", "range", min_value=5)], "nan_value"
    ),
    "validity_tckn": checked("orders", [valid("national_id", "tck", "tckn")], "tck"),
    "validity_vkn": checked("orders", [valid("tax_no", "vk", "vkn")], "vk"),
    "validity_tr_iban": checked("orders", [valid("bank_account", "ib", "tr_iban")], "ib"),
    "validity_phone_tr": checked("orders", [valid("mobile", "ph", "phone_tr")], "ph"),
    "validity_aliases": checked("orders", IDENTIFIER_RULES, "tck", "vk", "ib", "ph"),
    "threshold_edge": _threshold_edge,
    "threshold_default": _threshold_default,
    "empty_table": _empty_table,
    "skipped_rule": checked("orders", [ORDER_RULES[-1], ORDER_RULES[0]]),
    "validate_orders": _validate_orders,
    "validate_customer": checked("customer", CUSTOMER_RULES),
    "form_rules": _form_rules,
    "result_messages": _messages,
    "report_summary": lambda spark, sf_dir: summarise(
        validate(table(spark, sf_dir, "orders"), ORDER_RULES)
    ),
    "report_of_run": _full_run,
    "blocking_failures": lambda spark, sf_dir: compared(
        blocking_failures(validate(table(spark, sf_dir, "orders"), ORDER_RULES))
    ),
    "violations_long": _violations_long,
    "violations_duplicates": _violations_duplicates,
    "duplicate_rows": _duplicate_rows,
    "duplicate_rows_composite": _duplicate_rows_composite,
    "duplicate_rows_shuffled": _duplicate_rows_shuffled,
    "clean_rows": lambda spark, sf_dir: _customer_split(spark, sf_dir).clean,
    "quarantine_rows": lambda spark, sf_dir: _customer_split(spark, sf_dir).quarantine,
    "split_counts": lambda spark, sf_dir: _customer_split(spark, sf_dir).counts(),
    "quarantine_documents": _document_quarantine,
    "quarantine_lines": _line_quarantine,
    "split_counts_lines": _line_split_counts,
    "split_counts_written": _split_counts_written,
    "sink_history": _sink_history,
    "auto_validate": _auto_validate,
    "custom_check": _custom_check,
    "table_check_group_share": _table_checked("lineitem", [LINE_SHARE]),
    "table_check_outliers": _table_checked("orders", [PRICE_OUTLIER]),
    "table_check_pair": _table_checked("orders", [PRIORITY_BY_CUSTOMER]),
    "table_check_all": _table_checked("orders", [PRICE_OUTLIER, PRIORITY_BY_CUSTOMER]),
    "table_check_quarantine": _table_check_quarantine,
    "profile_nulls": _profile_nulls,
    "profile_kinds": _profile("kind"),
    "profile_samples": _profile_samples,
    "profile_flags": _profile_flags,
    "source_null_tokens": _null_tokens,
    "source_null_nans": _null_nans,
    "source_inferred_types": _inferred_types,
    "source_csv": _round_trip("csv"),
    "source_json": _round_trip("json", lines=True),
    "source_csv_schema": _csv_schema,
    "source_json_array": _json_array,
    "source_identifiers": _identifiers,
    "duplicate_rows_tied": _tied(BROADCAST_BYTES),
    "duplicate_rows_tied_shuffled": _tied(0),
    "duplicate_rows_null_order": _tied(BROADCAST_BYTES, "third"),
    "duplicate_rows_null_order_shuffled": _tied(0, "third"),
    "split_counts_tied": _split_counts_tied,
    "violations_in_row_order": _in_row_order,
    "validity_enum_decimal": _enum_decimal,
    "validity_regex_text": checked(
        "documents", [valid("characters", "text", "regex", pattern=r"(a|b|[^ab])*")]
    ),
    "sink_rows": _sink_rows,
    "sink_report": _sink_report,
}
