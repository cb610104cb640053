"""Column expressions against Python's own answers, on small tables and random values."""

from __future__ import annotations

import re
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsieve.functions import identifiers, numbers
from rowsieve.functions.patterns import full_match_pattern
from rowsieve.functions.text import as_text, bind, inline, is_blank, narrow_key, strip
from rowsieve.functions.validators import VALIDATORS
from rowsieve.rules import RuleError

TEXTS = [
    "", " ", "\t", " ", "　", "\x1c", "\x1f", "\u0085", "​", "  x ", "7", " 7 ",
    "+5", "-5", "1_000", "1__0", "_1", "1_", "1.5", "1.5e3", "1e5", "1E+5", "1e", "e5", "5.", ".5",
    ".", "-.5", "1.0d", "0x10", "inf", "-Inf", "+infinity", "infinit", "nan", "-NaN", "nano",
    "٣", "１２", "1\n", "\n1", "1 2", "²", "12345678901234567890123",
    "9" * 400, "1_" * 3000 + "1", " " * 3000, "1e400", "-1e400", "ınf",
]


def frame(spark, values, dtype=None):
    schema = T.StructType([T.StructField("v", dtype or T.StringType())])
    return spark.createDataFrame([(value,) for value in values], schema)


def evaluate(spark, values, expression, dtype=None):
    df = frame(spark, values, dtype)
    return [row[0] for row in df.select(expression(F.col("v"))).collect()]


def python_accepts(cast, value):
    try:
        cast(value)
        return True
    except (ValueError, OverflowError):
        return False


def test_blank_and_strip_follow_python(spark):
    assert evaluate(spark, TEXTS, is_blank) == [not text.strip() for text in TEXTS]
    assert evaluate(spark, TEXTS, strip) == [text.strip() for text in TEXTS]


@pytest.mark.parametrize(
    ("cast", "accepts"), [(int, numbers.is_int_text), (float, numbers.is_float_text)]
)
def test_number_grammars_follow_python(spark, cast, accepts):
    expected = [python_accepts(cast, text) for text in TEXTS]
    assert evaluate(spark, TEXTS, accepts) == expected


def test_text_numbers_have_python_values(spark):
    ascii_texts = [text for text in TEXTS if text.isascii()]
    got = evaluate(spark, ascii_texts, numbers.text_to_double)
    for text, value in zip(ascii_texts, got, strict=True):
        expected = float(text) if python_accepts(float, text) else None
        assert value == expected or (value != value and expected != expected), text


def test_doubles_print_as_in_python(spark):
    values = [
        0.0, -0.0, 1.0, -1.5, 100.0, 0.001, 0.0001, 0.00012345, 0.00001, 1.5e-7, 9999999.0,
        1e7, 12345678.9, -98765432.125, 1e15, 9999999999999998.0, 1e16, 1.5e16, 1e22, -2.5e300,
        1e-300, float("inf"), float("-inf"), float("nan"), None,
    ]
    got = evaluate(spark, values, lambda v: as_text(v, T.DoubleType()), T.DoubleType())
    assert got == [None if value is None else str(value) for value in values]


def test_other_types_print_as_in_python(spark):
    assert evaluate(
        spark, [True, False, None], lambda v: as_text(v, T.BooleanType()), T.BooleanType()
    ) == ["True", "False", None]
    assert evaluate(spark, [7, None], lambda v: as_text(v, T.LongType()), T.LongType()) == ["7", None]


def tckn(text):
    text = text.strip()
    if not re.fullmatch("[1-9][0-9]{10}", text):
        return False
    digits = [int(char) for char in text]
    odd, even = sum(digits[0:9:2]), sum(digits[1:8:2])
    return digits[9] == (7 * odd - even) % 10 and digits[10] == sum(digits[:10]) % 10


def vkn(text):
    text = text.strip()
    if not re.fullmatch("[0-9]{10}", text):
        return False
    total = 0
    for place, char in enumerate(text[:9], start=1):
        shifted = (int(char) + 10 - place) % 10
        share = shifted * 2 ** (10 - place) % 9
        total += 9 if shifted and not share else share
    return int(text[9]) == -total % 10


def iban(text):
    text = text.replace(" ", "").upper()
    if not re.fullmatch("TR[0-9]{24}", text):
        return False
    return int(text[4:] + "2927" + text[2:4]) % 97 == 1


def mobile(text):
    return bool(re.fullmatch(r"(\+90|0)?5[0-9]{9}", re.sub(r"[\s()-]", "", text)))


# Known good and bad identifiers, with some of our own at the end.
NAMED = {
    "tckn": (
        identifiers.is_tckn,
        tckn,
        ["10000000146", " 10000000146\t"],
        ["00000000146", "10000000145", "12345", "1000000014a", "10000000146 1", ""],
    ),
    "vkn": (
        identifiers.is_vkn,
        vkn,
        ["1234567890", " 1234567890"],
        ["12345", "1111111111", "9999999999", "0000000000", ""],
    ),
    "tr_iban": (
        identifiers.is_tr_iban,
        iban,
        [
            "TR400006200000000000000001",
            "tr400006200000000000000001",
            "TR40 0006 2000 0000 0000 0000 01",
        ],
        ["US890006200000000000000001", "TR12345", "98", "\tTR400006200000000000000001", ""],
    ),
    "phone_tr": (
        identifiers.is_tr_mobile,
        mobile,
        ["05321234567", "5321234567", "+90 532 123 45 67", "0 (532) 123 4567", "0532\t123-4567"],
        ["02121234567", "123456", "905321234567", ""],
    ),
}


@pytest.mark.parametrize("name", NAMED)
@pytest.mark.parametrize("let", [inline, bind])
def test_identifier_vectors(spark, name, let):
    expression, _, good, bad = NAMED[name]
    got = evaluate(spark, [*good, *bad, None], lambda v: F.coalesce(expression(v, let), F.lit(False)))
    assert got == [True] * len(good) + [False] * (len(bad) + 1)


def candidates(name):
    """Many numbers of the right shape, so that each check digit is met in both states."""
    if name == "tckn":
        return [str(10000000000 + step * 7919 + step % 97) for step in range(20000)]
    if name == "vkn":
        return [f"{step * 104729 % 10**10:010d}" for step in range(20000)]
    if name == "tr_iban":
        return [f"TR{step % 100:02d}{step * 1000003:022d}" for step in range(20000)]
    return [f"{('', '0', '+90', '90')[step % 4]}{step * 5 + 5 * 10**9 - 7}" for step in range(5000)]


@pytest.mark.parametrize("name", NAMED)
def test_identifiers_against_brute_force(spark, name):
    expression, brute, _, _ = NAMED[name]
    texts = candidates(name)
    expected = [brute(text) for text in texts]
    assert 0 < sum(expected) < len(expected)
    for let in (inline, bind):
        got = evaluate(spark, texts, lambda v, let=let: F.coalesce(expression(v, let), F.lit(False)))
        assert got == expected


def test_tckn_of_a_number(spark):
    test = VALIDATORS["tckn"]
    fails = lambda v: test(v, T.LongType(), {}, inline)
    assert evaluate(spark, [10000000146, 10000000145, None], fails, T.LongType()) == [
        False, True, True,
    ]


PATTERNS = [
    "", "a", "^a$", "a|bc", "(?i)AB", r"[\w.+-]+@[\w-]+\.[\w.]+", r"^[\w.+-]+@[\w-]+\.[\w.]+$",
    r"\d+", r"\D+", r"\s*", r"\S+", r"\W", r"[\W_]+", r"[^\W\d_]+", r"[[a]+", r"[]a]+", r"[^]a]+",
    r"[a&&b]+", r"(?P<first_part>a)(?P=first_part)", r"a{,2}", r"a{2}", r"a{1,}", r"a{x}", r"{",
    r"}", r"a.c", r"(?s)a.c", r"a\Z", r"\bab\b", r"(?#note)ab", r"\x41", r"A", r"\U00000041",
    r"(a)(b)\2", r"[a-z\d]+", r"a+?b*", r"(?:ab)+", r"\v", r"[\b]", r"\.", r"[\s\S]*", r"(?=a)ab",
]
SUBJECTS = [
    "", "a", "a\n", "aa", "aaa", "ab", "AB", "bc", "abb", "a.c", "a\nc", "a\rc", "a c", "A",
    "valid@test.com", "not-an-email", "7", "٣", "²", "½", "é", "é", "_",
    "-", "[", "[a", "]", "]a", "&", "a&b", "b", "{", "}", "a{x}", "a{,2}", " ", "\x1c", "　",
    "\x0b", "\x08", "‿", "‍", "z9",
]


@pytest.fixture(scope="module")
def java_matches(spark):
    """Which subjects each pattern matches in Spark, found by one job."""
    columns = [F.col("v").rlike(full_match_pattern(pattern)) for pattern in PATTERNS]
    rows = frame(spark, SUBJECTS).select(*columns).collect()
    return {pattern: [row[place] for row in rows] for place, pattern in enumerate(PATTERNS)}


@pytest.mark.filterwarnings("ignore:Possible nested set", "ignore:Possible set intersection")
@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_match_as_in_python(java_matches, pattern):
    compiled = re.compile(pattern)
    wrong = [
        text
        for text, matched in zip(SUBJECTS, java_matches[pattern], strict=True)
        if matched != bool(compiled.fullmatch(text))
    ]
    assert not wrong


def test_bad_pattern_is_named():
    with pytest.raises(RuleError, match="invalid pattern"):
        full_match_pattern("a(b")


def enum_passes(value, allowed):
    return value in set(allowed)


@pytest.mark.parametrize(
    ("dtype", "values"),
    [
        (T.StringType(), ["1", "a", "True", None]),
        (T.LongType(), [0, 1, 2, 2**53 + 1, None]),
        (T.DoubleType(), [0.0, 1.0, 0.5, float(2**53), None]),
        (T.BooleanType(), [True, False, None]),
    ],
)
@pytest.mark.parametrize(
    "allowed",
    [
        [], ["1"], [1], [1.0, 0.5], [True], [False, None], ["a", 2, 0.0], [2**53 + 1], [2**70],
        [float("nan"), float("inf")],
    ],
)
def test_enum_is_type_strict(spark, dtype, values, allowed):
    fails = lambda v: VALIDATORS["enum"](v, dtype, {"allowed_values": allowed}, inline)
    assert evaluate(spark, values, fails, dtype) == [
        not enum_passes(value, allowed) for value in values
    ]


def cast_passes(value, cast):
    return value is not None and python_accepts(cast, value)


@pytest.mark.parametrize("wanted", ["int", "float", "str", "bool", "other"])
@pytest.mark.parametrize(
    ("dtype", "values"),
    [
        (T.StringType(), [*TEXTS, None]),
        (T.LongType(), [0, -3, None]),
        (T.DoubleType(), [1.5, 2.0, float("nan"), float("inf"), None]),
        (T.BooleanType(), [True, False, None]),
    ],
)
def test_dtype_follows_python_casts(spark, wanted, dtype, values):
    cast = {"int": int, "float": float, "bool": bool}.get(wanted, str)
    fails = lambda v: VALIDATORS["dtype"](v, dtype, {"expected_type": wanted}, inline)
    assert evaluate(spark, values, fails, dtype) == [not cast_passes(v, cast) for v in values]


def range_passes(value, low, high):
    if value is None or not python_accepts(float, value):
        return False
    number = float(value)
    return not ((low is not None and number < low) or (high is not None and number > high))


@pytest.mark.parametrize(("low", "high"), [(0, 150), (5, None), (None, 5), (None, None), (1e400, 3)])
@pytest.mark.parametrize(
    ("dtype", "values"),
    [
        (T.StringType(), [text for text in TEXTS if text.isascii()] + [None]),
        (T.LongType(), [-5, 0, 5, 150, 151, None]),
        (T.DoubleType(), [-0.5, 5.0, 150.0, 150.5, float("nan"), float("inf"), None]),
        (T.BooleanType(), [True, False, None]),
    ],
)
@pytest.mark.parametrize("let", [inline, bind])
def test_range_follows_python(spark, low, high, dtype, values, let):
    bounds = {"min_value": low, "max_value": high}
    params = {name: bound for name, bound in bounds.items() if bound is not None}
    fails = lambda v: VALIDATORS["range"](v, dtype, params, let)
    assert evaluate(spark, values, fails, dtype) == [not range_passes(v, low, high) for v in values]


@settings(
    max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.text(max_size=12), min_size=20, max_size=60))
def test_random_text(spark, texts):
    texts = [text for text in texts if not any(0xD800 <= ord(c) < 0xE000 for c in text)]
    df = frame(spark, texts)
    v = F.col("v")
    rows = df.select(is_blank(v), strip(v), numbers.is_int_text(v), numbers.is_float_text(v)).collect()
    assert [tuple(row) for row in rows] == [
        (not t.strip(), t.strip(), python_accepts(int, t), python_accepts(float, t)) for t in texts
    ]


@settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.floats(), min_size=20, max_size=60))
def test_random_doubles_keep_their_value(spark, values):
    got = evaluate(spark, values, lambda v: as_text(v, T.DoubleType()), T.DoubleType())
    for value, text in zip(values, got, strict=True):
        assert struct.pack("d", float(text)) == struct.pack("d", value) or value != value


def test_narrow_keys_are_short_and_equal_only_for_equal_text(spark):
    texts = ["", "a", "x" * 64, "x" * 65, "x" * 66, "é" * 32, "é" * 33, "y" * 100000, None]
    keys = evaluate(spark, texts + texts, lambda v: narrow_key(v, T.StringType()))
    assert all(key is None or len(key) <= 65 for key in keys)
    assert keys[: len(texts)] == keys[len(texts) :]
    assert len({None if key is None else bytes(key) for key in keys}) == len(texts)
