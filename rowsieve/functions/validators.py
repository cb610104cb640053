"""Validity validators and the registry of custom checks.

A validator takes ``(value, dtype, params, let)`` and gives the Column that is TRUE for
rows which FAIL and never NULL; ``let`` says how to use a value more than once. A custom
check takes ``(value, dtype, params)``, and where it gives NULL the row fails.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsieve.functions import identifiers, numbers
from rowsieve.functions.patterns import full_match_pattern
from rowsieve.functions.text import COMPLEX, FLOATING, TIMESTAMPS, Let, as_text
from rowsieve.rules import BUILTIN_TYPES, RuleError

Params = Mapping[str, Any]
Validator = Callable[[Column, T.DataType, Params, Let], Column]
CustomCheck = Callable[[Column, T.DataType, Params], Column]

_NUMERIC = (T.IntegralType, T.DecimalType, *FLOATING)


def _fails(passes: Column) -> Column:
    return ~F.coalesce(passes, F.lit(False))


def _regex(value: Column, dtype: T.DataType, params: Params, let: Let) -> Column:
    pattern = full_match_pattern(str(params.get("pattern", "")))
    return _fails(as_text(value, dtype).rlike(pattern))


def _comparable(item: Any, dtype: T.DataType) -> Any:
    """The allowed value as a literal of the column's type, or None if it can never be equal.

    Equality follows Python: text never equals a number, while 1, 1.0 and True are equal.
    """
    if isinstance(dtype, T.StringType):
        return item if isinstance(item, str) else None
    if isinstance(dtype, T.BooleanType):
        return bool(item) if _is_number(item) and item in (0, 1) else None
    if isinstance(dtype, T.IntegralType):
        if not _is_number(item) or item != item or item in (float("inf"), float("-inf")):
            return None
        whole = int(item)
        return whole if whole == item and -(2**63) <= whole < 2**63 else None
    if isinstance(dtype, FLOATING):
        if not _is_number(item) or item != item:
            return None
        try:
            return float(item) if float(item) == item else None
        except OverflowError:
            return None
    if isinstance(dtype, T.DecimalType):
        if not _is_number(item) or item != item or item in (float("inf"), float("-inf")):
            return None
        exact = decimal.Decimal(item)
        places = max(0, -exact.as_tuple().exponent)
        # A value of more places or digits than the column has is equal to none of its values.
        fits = places <= dtype.scale and abs(exact) < 10 ** (dtype.precision - dtype.scale)
        return exact if fits else None
    if isinstance(dtype, TIMESTAMPS):
        return item if isinstance(item, dt.datetime) else None
    if isinstance(dtype, T.DateType):
        return item if isinstance(item, dt.date) and not isinstance(item, dt.datetime) else None
    return None


def _is_number(item: Any) -> bool:
    return isinstance(item, (bool, int, float, decimal.Decimal))


def _enum(value: Column, dtype: T.DataType, params: Params, let: Let) -> Column:
    allowed = list(params.get("allowed_values", ()))
    matching = (_comparable(item, dtype) for item in allowed)
    literals = list(dict.fromkeys(item for item in matching if item is not None))
    if isinstance(dtype, T.FloatType):
        value = value.cast("double")
    passes = value.isin(*literals) if literals else F.lit(False)
    passes = F.coalesce(passes, F.lit(False))
    if None in allowed:
        passes = passes | value.isNull()
    return ~passes


def _dtype(value: Column, dtype: T.DataType, params: Params, let: Let) -> Column:
    wanted = str(params.get("expected_type", "str"))
    if wanted not in ("int", "float"):
        return value.isNull()
    if isinstance(dtype, T.StringType):
        grammar = numbers.is_int_text if wanted == "int" else numbers.is_float_text
        return _fails(grammar(value))
    if isinstance(dtype, FLOATING) and wanted == "int":
        return _fails(~F.isnan(value) & (F.abs(value) != float("inf")))
    if isinstance(dtype, (T.BooleanType, *_NUMERIC)):
        return value.isNull()
    return F.lit(True)


def _range(value: Column, dtype: T.DataType, params: Params, let: Let) -> Column:
    low, high = (_bound(params, name) for name in ("min_value", "max_value"))

    may_be_nan = isinstance(dtype, (T.StringType, *FLOATING))

    def inside(number: Column) -> Column:
        within = number.isNotNull()
        if low is not None:
            within = within & (number >= low)
        if high is not None:
            within = within & (number <= high)
        # NaN lies beyond no bound in Python, while Spark sorts it above every number.
        return within | F.isnan(number) if may_be_nan else within

    if isinstance(dtype, T.StringType):
        return _fails(let(numbers.text_to_double(value), inside))
    if isinstance(dtype, T.BooleanType):
        return _fails(inside(value.cast("int").cast("double")))
    if isinstance(dtype, _NUMERIC):
        return _fails(inside(value.cast("double")))
    return F.lit(True)


def pushable(
    name: str, value: Column, dtype: T.DataType, params: Params
) -> tuple[Column, Column] | None:
    """For filters that a scan can use: what holds for all failing rows, and for all others.

    Both leave NaN aside, so neither says which of the two a row is.
    """
    if name == "range" and isinstance(dtype, _NUMERIC) and not isinstance(dtype, T.DecimalType):
        low, high = (_bound(params, bound) for bound in ("min_value", "max_value"))
        if isinstance(dtype, T.IntegralType):
            # Bounds of the column's own type, as a cast of the column is not pushed.
            low = None if low is None or low < -(2.0**62) else math.ceil(min(low, 2.0**62))
            high = None if high is None or high > 2.0**62 else math.floor(max(high, -(2.0**62)))
        fails, passes = value.isNull(), value.isNotNull()
        if low is not None:
            fails, passes = fails | (value < low), passes & (value >= low)
        if high is not None:
            fails = fails | (value > high)
            if not isinstance(dtype, FLOATING):
                passes = passes & (value <= high)
        return fails, passes
    if name == "enum":
        allowed = list(params.get("allowed_values", ()))
        matching = (_comparable(item, dtype) for item in allowed)
        literals = list(dict.fromkeys(item for item in matching if item is not None))
        if not literals or isinstance(dtype, T.FloatType):
            return None
        listed = value.isin(*literals)
        if None in allowed:
            return ~listed, listed | value.isNull()
        return value.isNull() | ~listed, value.isNotNull() & listed
    return None


def _bound(params: Params, name: str) -> float | None:
    if name not in params:
        return None
    try:
        bound = float(params[name])
    except (TypeError, ValueError) as exc:
        raise RuleError(f"{name} {params[name]!r} is not a number") from exc
    return None if bound != bound else bound


def _identifier(valid: Callable[[Column, Let], Column]) -> Validator:
    return lambda value, dtype, params, let: _fails(valid(as_text(value, dtype), let))


# Validator names and their aliases.
VALIDATORS: dict[str, Validator] = {
    "regex": _regex,
    "enum": _enum,
    "dtype": _dtype,
    "range": _range,
    "tckn": _identifier(identifiers.is_tckn),
    "vkn": _identifier(identifiers.is_vkn),
    "tr_iban": _identifier(identifiers.is_tr_iban),
    "phone_tr": _identifier(identifiers.is_tr_mobile),
}
TEXT_VALIDATORS = ("regex", "tckn", "vkn", "tr_iban", "phone_tr")
ALIASES = {"tc_kimlik": "tckn", "vergi_no": "vkn", "iban": "tr_iban", "telefon": "phone_tr"}

_CUSTOM: dict[str, CustomCheck] = {}


def validator_name(raw: Any) -> str:
    name = str(raw).strip().lower()
    return ALIASES.get(name, name)


def validator_for(raw: Any) -> Validator:
    name = validator_name(raw)
    if name not in VALIDATORS:
        raise RuleError(f"unsupported validator {name!r}")
    return VALIDATORS[name]


def register_check(type_name: str, fails: CustomCheck) -> None:
    """Add a rule type whose rows fail where ``fails(value, dtype, params)`` is TRUE."""
    name = type_name.lower()
    if name in BUILTIN_TYPES:
        raise RuleError(f"{name!r} is a built-in rule type")
    _CUSTOM[name] = fails


def custom_checks() -> dict[str, CustomCheck]:
    return dict(_CUSTOM)


def reject_complex(dtype: T.DataType, rule_id: str) -> None:
    if isinstance(dtype, COMPLEX):
        raise RuleError(f"rule {rule_id!r} cannot test a column of type {dtype.simpleString()}")
