"""Sources, sinks, rule files and streams, each with files in a fresh folder."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rowsieve import Rule, RuleError, load_rules, read, rules_from_entries, run, split, validate
from rowsieve.plans.cluster import drop_folder, fresh_folder, shared_folder, shuffle_settings
from rowsieve.sources.readers import infer_types, null_nans, null_tokens, supports
from rowsieve.sources.writers import compact_history, history, write_counted_split, write_report, write_split
from rowsieve.streaming.batches import validate_stream

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
READINGS_CSV = """meter,site,month,kwh,unit,inspector
M1,alpha,1,120.5,kwh,IN-001
M1,alpha,2,130.0,kwh,IN-001
M2,beta,1,-4.0,kwh,IN-002
M2,beta,1,88.0,kwh,in-2
M3,gamma,1,,kwh,IN-003
M4,delta,3,9999.0,kwh,IN-004
"""
BINS_CSV = """bin,label,weight,shelf
B-10,bolts,2.5,upper
B-11,,3.0,lower
B-11,nuts,0.2,lower
B-12,washers,7.5,roof
"""
RULE_SET = {
    "version": "1.0",
    "rules": [
        {"id": "once", "name": "one_reading_a_month", "type": "uniqueness", "columns": ["meter", "month"], "threshold": 1.0},
        {
            "id": "kwh",
            "name": "kwh_plausible",
            "type": "validity",
            "column": "kwh",
            "validator": "range",
            "params": {"min_value": 0, "max_value": 5000},
            "threshold": 0.9,
        },
        {
            "id": "who",
            "name": "inspector_code",
            "type": "validity",
            "column": "inspector",
            "validator": "regex",
            "params": {"pattern": "IN-[0-9]{3}"},
            "threshold": 0.8,
            "severity": "warning",
        },
    ],
}


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def types(df):
    return dict(df.dtypes)


def test_csv_with_rule_file(spark, tmp_path):
    df = read(spark, write(tmp_path / "readings.csv", READINGS_CSV))
    assert types(df) == {
        "meter": "string", "site": "string", "month": "bigint", "kwh": "double", "unit": "string",
        "inspector": "string",
    }
    rules = load_rules(spark, write(tmp_path / "rules.json", json.dumps(RULE_SET)))
    done = run(df, rules, order_by=["meter"])
    # A repeated month of M2; a negative, a missing and an implausible reading; one code.
    assert [(row.failed_count, row.total_count) for row in done.verdicts] == [(1, 6), (3, 6), (1, 6)]
    summary = done.summary.first()
    assert (summary.overall_status, summary.passed_rules, summary.failed_rules) == ("failed", 1, 2)
    assert summary.overall_score == pytest.approx((5 / 6 + 3 / 6 + 5 / 6) / 3)
    assert sorted((row.meter, row.month) for row in done.rows.clean.collect()) == [("M1", 1), ("M1", 2)]


def test_yaml_rule_file(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    path = write(tmp_path / "rules.yaml", yaml.safe_dump({**RULE_SET, "version": "2.0"}))
    with pytest.warns(UserWarning, match="version"):
        rules = load_rules(spark, path)
    assert [rule.name for rule in rules] == [entry["name"] for entry in RULE_SET["rules"]]
    with pytest.raises(RuleError, match="mapping"):
        load_rules(spark, write(tmp_path / "list.yaml", "- a\n"))
    assert load_rules(spark, write(tmp_path / "none.yaml", "version: '1.0'\n")) == []


def identifier_rules(*pairs):
    return [
        Rule(name, name, "validity", column=name, validator=validator, threshold=1.0)
        for name, validator in pairs
    ]


def test_phone_and_tax_numbers_kept_as_text(spark, tmp_path):
    rules = identifier_rules(("tax", "vergi_no"), ("mobile", "telefon"))
    path = write(tmp_path / "contacts.csv", "tax;mobile\n4829153708;+905427773311\n4829153709;05427773311\n")
    df = read(spark, path, sep=";", rules=rules)
    assert types(df) == {"tax": "string", "mobile": "string"}
    assert [row.mobile for row in df.collect()] == ["+905427773311", "05427773311"]
    assert [row.failed_count for row in validate(df, rules).collect()] == [1, 0]


def test_account_and_national_numbers(spark, tmp_path):
    account = "TR750009900000001234567890"
    spaced = " ".join([account[:4], *[account[at : at + 4] for at in range(4, 26, 4)]])
    rules = identifier_rules(("account", "iban"), ("national", "tc_kimlik"))
    text = f"\ufeffaccount,national\n{spaced},27182818254\nDE{account[2:]},27182818255\n"
    df = read(spark, write(tmp_path / "accounts.csv", text), rules=rules)
    assert df.columns == ["account", "national"]
    assert [row.failed_count for row in validate(df, rules).collect()] == [1, 1]


def test_csv_without_row_order_is_landed(spark, tmp_path):
    df = read(spark, write(tmp_path / "bins.csv", BINS_CSV))
    rules = [
        Rule("bin_once", "bin_once", "uniqueness", column="bin", threshold=0.9),
        Rule("weight", "weight", "validity", "warning", "weight", (), 0.5, "range", {"min_value": 0.5, "max_value": 5.0}),
        Rule("label", "label", "completeness", column="label", threshold=0.9),
        Rule("shelf", "shelf", "validity", "warning", "shelf", (), 0.7, "enum", {"allowed_values": ["upper", "lower"]}),
    ]
    done = run(df, rules)
    assert [row.failed_count for row in done.verdicts] == [1, 2, 1, 1]
    # Both warnings pass their thresholds, so only the repeated bin and the blank label hold rows.
    assert sorted(row.label for row in done.rows.clean.collect()) == ["bolts", "washers"]
    reasons = {row.weight: row.violation_reasons for row in done.rows.quarantine.collect()}
    assert reasons == {3.0: "[label] missing value (blank)", 0.2: "[bin] duplicate record ('B-11')"}


def test_schema_and_inference_agree_on_missing_cells(spark, tmp_path):
    path = write(tmp_path / "cells.csv", "a,b\nN/A,1\nnull,NA\nx,3\n")
    for df in (read(spark, path), read(spark, path, schema="a string, b bigint")):
        assert [tuple(row) for row in df.collect()] == [(None, 1), (None, None), ("x", 3)]


def test_json_columns_keep_the_first_records_order(spark, tmp_path):
    records = [{"z": 1, "a": {"q": 1}, "m": None}, {"z": 2, "b": 3}]
    array = write(tmp_path / "array.json", json.dumps(records, indent=1))
    lines = write(tmp_path / "lines.jsonl", "\n".join(map(json.dumps, records)))
    assert [read(spark, path).columns[:2] for path in (array, lines)] == [["z", "a"]] * 2


def test_two_lazy_round_trips_keep_their_files(spark):
    from rowsieve.plans.workload import QUERIES

    frames = [QUERIES["source_csv"](spark, SF_DIR) for _ in range(2)]
    assert [frame.count() for frame in frames] == [6, 6]


def test_csv_in_a_turkish_code_page(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes("ad;yaş\nAyşe;3\nN/A;\n".encode("cp1254"))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        df = read(spark, str(path), sep=";", encoding="windows-1254")
        assert df.columns == ["ad", "yaş"]
        assert [tuple(row) for row in df.collect()] == [("Ayşe", 3), (None, None)]
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")


def test_csv_options(spark, tmp_path):
    path = write(tmp_path / "semicolons.csv", "ad;yas\nAyşe;3\nN/A;\n")
    df = read(spark, path, sep=";")
    assert [tuple(row) for row in df.collect()] == [("Ayşe", 3), (None, None)]
    quoted = write(tmp_path / "quoted.csv", 'a,b\n"x ""y"", z","line\nbreak"\n')
    assert read(spark, quoted, multi_line=True).collect()[0].asDict() == {"a": 'x "y", z', "b": "line\nbreak"}
    typed = read(spark, path, sep=";", schema="ad string, yas double")
    assert types(typed) == {"ad": "string", "yas": "double"}


def test_type_inference(spark):
    rows = [
        ("1", "1.5", "True", "a", None, "1", "007"),
        ("-2", "2", "FALSE", "1", None, "1_0", "7"),
        (None, "inf", None, "", None, None, None),
    ]
    df = spark.createDataFrame(rows, "i string, d string, b string, s string, n string, u string, k string")
    got = infer_types(df, keep_text=["k"])
    assert types(got) == {
        "i": "bigint", "d": "double", "b": "boolean", "s": "string", "n": "string", "u": "string", "k": "string",
    }
    assert tuple(got.first()) == (1, 1.5, True, "a", None, "1", "007")
    big = spark.createDataFrame([("99999999999999999999",)], "v string")
    assert types(infer_types(big)) == {"v": "double"}


def test_null_normalisation(spark):
    df = spark.createDataFrame([("NA", float("nan")), ("na", 1.0), ("  ", None)], "s string, d double")
    assert [tuple(row) for row in null_nans(null_tokens(df)).collect()] == [
        (None, None), ("na", 1.0), ("  ", None),
    ]


def test_json_sources(spark, tmp_path):
    records = [{"a": 1, "b": "x"}, {"a": None, "b": "y"}]
    array = write(tmp_path / "array.json", json.dumps(records, indent=1))
    lines = write(tmp_path / "lines.jsonl", "\n".join(json.dumps(record) for record in records))
    for path in (array, lines):
        df = read(spark, path)
        assert types(df) == {"a": "bigint", "b": "string"}
        assert sorted((row.b, row.a) for row in df.collect()) == [("x", 1), ("y", None)]


def test_columnar_and_catalog_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.0)], "id long, v double")
    for fmt in ("parquet", "orc"):
        path = str(tmp_path / f"t.{fmt}")
        df.write.format(fmt).save(path)
        assert sorted(read(spark, path).collect()) == [(1, None), (2, 2.0)]
    df.createOrReplaceTempView("some_table")
    assert read(spark, "some_table", fmt="table").filter("v is null").count() == 1
    assert supports("x.CSV") and supports("x.json") and not supports("x.xlsx")
    with pytest.raises(ValueError, match="no reader"):
        read(spark, "x.xlsx")


def test_position_survives_null_clean_up(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, 1.0), (1, 1.0)], "id long, v double").coalesce(1).write.parquet(path)
    held = split(read(spark, path), [Rule("u", "u", "uniqueness", column="id")]).quarantine
    assert held.count() == 1


def test_report_and_rows_are_written_once_per_run(spark, tmp_path):
    root = str(tmp_path / "out")
    df = read(spark, write(tmp_path / "readings.csv", READINGS_CSV))
    rules = load_rules(spark, write(tmp_path / "rules.json", json.dumps(RULE_SET)))
    for run_id in ("one", "two", "two"):
        done = run(df, rules, root=root, run_id=run_id, order_by=["meter"], source="readings.csv")
        assert tuple(done.written) == (6, 2, 4) == tuple(done.rows.counts().first())
    results = spark.read.json(f"{root}/results")
    assert results.groupBy("run_id").count().orderBy("run_id").collect() == [("one", 3), ("two", 3)]
    summary = spark.read.json(f"{root}/summary").filter("run_id = 'two'").first()
    assert (summary.overall_status, summary.source) == ("failed", "readings.csv")
    assert summary.overall_score == pytest.approx((5 / 6 + 3 / 6 + 5 / 6) / 3, abs=1e-3)
    assert summary.executed_at
    rows = spark.read.parquet(f"{root}/rows")
    counts = rows.groupBy("run_id", "sieve_outcome").count().orderBy("run_id", "sieve_outcome").collect()
    assert counts == [("one", "clean", 2), ("one", "quarantine", 4), ("two", "clean", 2), ("two", "quarantine", 4)]


def test_history_by_day_compacted_and_repeated_once(spark, tmp_path):
    root = str(tmp_path / "reports")
    verdicts = validate(spark.createDataFrame([(1,), (None,)], "x long"), [Rule("c", "c", "completeness", column="x")]).collect()
    for place in range(12):
        day = f"2026-01-0{1 + place % 3}"
        write_report(spark, verdicts, root, f"run{place}", source="t", run_date=day)
    write_report(spark, verdicts, root, "run0", source="again", run_date="2026-01-01")
    write_report(spark, verdicts, root, "run1", source="later", run_date="2026-01-03")
    for day in ("2026-01-01", "2026-01-02"):
        compact_history(spark, root, day)
    results = history(spark, root)
    assert results.count() == 12
    assert {row.run_id: row.source for row in results.select("run_id", "source").collect()}["run1"] == "later"
    assert history(spark, root, "summary").count() == 12
    # Two compacted days hold one file each; the third day keeps its run folders.
    assert len([f for f in results.inputFiles() if "/results_compacted/" in f]) == 2


def test_counts_are_observed_while_writing(spark, tmp_path):
    df = spark.createDataFrame([(place, place % 4) for place in range(41)], "id long, v long")
    rules = [Rule("r", "r", "validity", column="v", validator="range", params={"min_value": 1})]
    parts = split(df, rules)
    clean, held, counts = write_counted_split(parts, str(tmp_path / "out"), "x")
    assert tuple(counts) == (41, 30, 11) == tuple(parts.counts().first())
    assert (spark.read.parquet(clean).count(), spark.read.parquet(held).count()) == (30, 11)


def test_split_is_written_without_a_sort(spark, tmp_path):
    df = spark.createDataFrame([(place, place % 3) for place in range(30)], "id long, v long")
    rules = [Rule("r", "r", "validity", column="v", validator="range", params={"min_value": 1})]
    clean, held = write_split(split(df, rules), str(tmp_path / "out"), "x")
    assert spark.read.parquet(clean).count() == 20
    assert spark.read.parquet(held).select("violation_reasons").distinct().collect() == [
        ("[v] invalid value ('0')",)
    ]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_stream_of_files(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    rules = [
        Rule("u", "u", "uniqueness", column="id", threshold=1.0),
        Rule("c", "c", "completeness", column="name", threshold=1.0),
    ]
    schema = "id long, name string"

    def arrive(number, rows):
        df = spark.createDataFrame(rows, schema).coalesce(1)
        df.write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = validate_stream(stream, rules, root, str(tmp_path / "state"))
        query.awaitTermination()

    arrive(0, [(1, "a"), (2, "b"), (2, "c")])
    arrive(1, [(1, "a"), (3, None)])
    results = spark.read.json(f"{root}/results").select("run_id", "rule_id", "failed_count")
    assert sorted(tuple(row) for row in results.collect()) == [
        ("batch-000000000000", "c", 0),
        ("batch-000000000000", "u", 1),
        ("batch-000000000001", "c", 1),
        ("batch-000000000001", "u", 0),
    ]
    rows = spark.read.parquet(f"{root}/rows")
    assert rows.filter(F.col("sieve_outcome") == "clean").count() == 3
    assert rows.filter(F.col("sieve_outcome") == "quarantine").count() == 2


def test_shuffle_settings_grow_with_the_table():
    assert shuffle_settings(10**9)["spark.sql.shuffle.partitions"] == "200"
    large = shuffle_settings(100 * 10**12)
    assert 30_000 < int(large["spark.sql.shuffle.partitions"]) <= 50_000
    assert int(large["spark.sql.files.maxPartitionBytes"]) == 2**30
    narrow = shuffle_settings(100 * 10**12, shuffled_bytes=10**12)
    assert int(narrow["spark.sql.shuffle.partitions"]) < 4_000


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert folder.startswith(root or spark.conf.get("spark.sql.warehouse.dir"))
    assert folder == shared_folder(spark)
    fresh = [fresh_folder(spark, "x") for _ in range(2)]
    assert fresh[0] != fresh[1]
    spark.range(1).write.parquet(fresh[0])
    drop_folder(spark, fresh[0])
    with pytest.raises(AnalysisException):
        spark.read.parquet(fresh[0])


def test_json_array_in_one_long_line(spark, tmp_path):
    records = [{"zeta": place, "alpha": "x" * 50, "mid": None} for place in range(2000)]
    path = write(tmp_path / "one_line.json", json.dumps(records))
    df = read(spark, path)
    assert df.columns == ["zeta", "alpha", "mid"]
    assert df.count() == 2000
