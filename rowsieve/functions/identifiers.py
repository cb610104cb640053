"""Turkish national, tax and bank identifiers and mobile numbers, as column expressions.

Each function takes text and gives TRUE when it is valid, NULL or FALSE otherwise. The
shape test also picks out the digits; they become one number, and the rest is plain
integer arithmetic on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsieve.functions.text import WHITESPACE, Let, inline

# Shapes and constants set by the issuing authorities.
TCKN_SHAPE = "[1-9][0-9]{10}"
VKN_SHAPE = "[0-9]{10}"
IBAN_SHAPE = r"\ATR([0-9]{24})\z"
MOBILE_SHAPE = r"\A(?:\+90|0)?5[0-9]{9}\z"
IBAN_COUNTRY_DIGITS = 2927
IBAN_MODULUS = 97

_PAD = r"[\s\x1c-\x1f]*+"


def _padded_number(text: Column, shape: str) -> Column:
    """The number inside any blanks around it, or NULL if the text has another shape."""
    found = F.regexp_extract(text, rf"(?U)\A{_PAD}({shape}){_PAD}\z", 1)
    return found.try_cast("bigint")


def _digits(number: Column, count: int) -> list[Column]:
    """The decimal digits of a number from the left, leading zeros included."""
    return [
        F.call_function("div", number, F.lit(10**power)) % 10
        for power in range(count - 1, -1, -1)
    ]


def is_tckn(text: Column, let: Let = inline) -> Column:
    def sums_agree(number: Column) -> Column:
        digit = _digits(number, 11)
        odd, even = sum(digit[0:9:2], F.lit(0)), sum(digit[1:8:2], F.lit(0))
        tenth = F.pmod(odd * 7 - even, F.lit(10)) == digit[9]
        return tenth & ((odd + even + digit[9]) % 10 == digit[10])

    return let(_padded_number(text, TCKN_SHAPE), sums_agree)


def _vkn_share(digit: int, weight: int) -> int:
    """What a digit of the given weight adds: a residue modulo 9, written as 1 to 9."""
    shifted = (digit + weight) % 10
    return (shifted * 2**weight - 1) % 9 + 1 if shifted else 0


def is_vkn(text: Column, let: Let = inline) -> Column:
    def sum_agrees(number: Column) -> Column:
        *body, check = _digits(number, 10)
        shares = [
            F.get(F.lit([_vkn_share(value, weight) for value in range(10)]), digit.cast("int"))
            for weight, digit in zip(range(9, 0, -1), body, strict=True)
        ]
        return (sum(shares, F.lit(0)) + check) % 10 == 0

    return let(_padded_number(text, VKN_SHAPE), sum_agrees)


def is_tr_iban(text: Column, let: Let = inline) -> Column:
    """The account digits, then the country as digits, then the two check digits, must
    leave 1 modulo 97. Taken piece by piece, the remainder stays in plain longs."""

    def remainder_is_one(digits: Column) -> Column:
        high, low, check = (
            F.substring(digits, start, length).try_cast("bigint")
            for start, length in ((3, 11), (14, 11), (1, 2))
        )
        account = ((high % IBAN_MODULUS) * 10**11 + low) % IBAN_MODULUS
        return (account * 10**6 + IBAN_COUNTRY_DIGITS * 100 + check) % IBAN_MODULUS == 1

    code = F.upper(F.translate(text, " ", ""))
    return let(F.regexp_extract(code, IBAN_SHAPE, 1), remainder_is_one)


def is_tr_mobile(text: Column, let: Let = inline) -> Column:
    return F.translate(text, WHITESPACE + "-()", "").rlike(MOBILE_SHAPE)
