"""Which text Python's ``int()`` and ``float()`` accept, as regular expressions.

All repeats are possessive: they never backtrack and never recurse, so a hostile value
of any length costs one pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsieve.functions.text import WHITESPACE

_PAD = r"[\s\x1c-\x1f]*+"
_DIGITS = r"\p{Nd}++(?:_\p{Nd}++)*+"
_SPECIAL = r"[iI][nN][fF](?:[iI][nN][iI][tT][yY])?+|[nN][aA][nN]"
_DECIMAL = rf"(?:{_DIGITS}(?:\.(?:{_DIGITS})?+)?+|\.{_DIGITS})(?:[eE][+-]?+{_DIGITS})?+"

INT_TEXT = rf"(?U)\A{_PAD}[+-]?+{_DIGITS}{_PAD}\z"
FLOAT_TEXT = rf"(?U)\A{_PAD}[+-]?+(?:{_DECIMAL}|{_SPECIAL}){_PAD}\z"
NAN_TEXT = rf"(?U)\A{_PAD}[+-]?+[nN][aA][nN]{_PAD}\z"


def is_int_text(text: Column) -> Column:
    return text.rlike(INT_TEXT)


def is_float_text(text: Column) -> Column:
    return text.rlike(FLOAT_TEXT)


def text_to_double(text: Column) -> Column:
    """The number ``float()`` makes of the text, NULL where it makes none.

    Digits of other scripts, which Python also reads, give NULL.
    """
    bare = F.translate(text, WHITESPACE + "_", "")
    return F.when(text.rlike(NAN_TEXT), F.lit(float("nan"))).when(
        is_float_text(text), bare.try_cast("double")
    )
