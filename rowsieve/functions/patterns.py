"""Python regular expressions, rewritten for the Java engine behind ``rlike``."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rowsieve.rules import RuleError

# Python escapes whose Java meaning differs, outside and inside brackets.
_OUTSIDE = {
    "d": r"\p{Nd}",
    "D": r"\P{Nd}",
    "w": r"[\p{L}\p{N}_]",
    "W": r"[^\p{L}\p{N}_]",
    "s": r"[\s\x1c-\x1f]",
    "S": r"[^\s\x1c-\x1f]",
    "v": r"\x0B",
    "Z": r"\z",
}
_INSIDE = {
    "d": r"\p{Nd}",
    "D": r"\P{Nd}",
    "w": r"\p{L}\p{N}_",
    "W": r"[^\p{L}\p{N}_]",
    "s": r"\s\x1c-\x1f",
    "S": r"[^\s\x1c-\x1f]",
    "v": r"\x0B",
    "b": r"\x08",
}
_ESCAPE = re.compile(
    r"\\(?:U([0-9a-fA-F]{8})|N\{([^}]+)\}|(0[0-7]{0,2}|[1-3][0-7]{2})|(.))", re.DOTALL
)
# What the classes mean under the ASCII flag.
_ASCII = {"d": "0-9", "w": "a-zA-Z0-9_", "s": r"\t\n\x0B\f\r "}
_FLAGS = re.compile(r"\A\(\?([aiLmsux]+)\)")
# One character out of several, over and over, to the end of the pattern.
_ONE = r"(?:[^\\\[\](){}|*+?.^$]|\[\^?[^\\\[\]]+\])"
_TAIL = re.compile(rf"\((?:\?:)?{_ONE}(?:\|{_ONE})+\)[*+]\Z")
_ONE_OF = re.compile(r"\((?:\?:)?((?:[A-Za-z0-9 _,;:@%-]\|)+[A-Za-z0-9 _,;:@%-])\)(?=[*+])")
_GROUP_NAME = re.compile(r"\(\?P(?:<(\w+)>|=(\w+)\))")
_COMMENT = re.compile(r"\(\?#[^)]*\)")
_REPEAT = re.compile(r"\{(\d*)(,?)(\d*)\}")


def full_match_pattern(pattern: str) -> str:
    """A Java pattern that matches where Python's ``fullmatch`` does."""
    try:
        re.compile(pattern)
    except re.error as exc:
        raise RuleError(f"invalid pattern {pattern!r}: {exc}") from exc
    flags = _FLAGS.match(pattern)
    letters = flags[1] if flags else ""
    ascii_only = "a" in letters
    if flags:
        pattern = pattern[flags.end() :]
    if not re.compile(pattern).groupindex and not re.search(r"\\[1-9]", pattern):
        # Repeats of one character out of several need no stack as a class.
        pattern = _ONE_OF.sub(lambda one: f"[{re.escape(one[1].replace('|', ''))}]", pattern)
    out: list[str] = []
    groups: dict[str, str] = {}
    bracket_at: int | None = None
    at = 0
    while at < len(pattern):
        char = pattern[at]
        if char == "\\":
            found = _ESCAPE.match(pattern, at)
            out.append(_escaped(found, bracket_at is not None, ascii_only))
            at = found.end()
            continue
        if bracket_at is not None:
            first = at == bracket_at + 1 or (at == bracket_at + 2 and pattern[at - 1] == "^")
            if char == "]" and not first:
                bracket_at = None
                out.append(char)
            else:
                out.append("\\" + char if char in "[]&" else char)
            at += 1
            continue
        special = None
        if char == "[":
            bracket_at = at
        elif char == "(":
            special = _GROUP_NAME.match(pattern, at) or _COMMENT.match(pattern, at)
        elif char == "{":
            special = _REPEAT.match(pattern, at)
        if special is None:
            out.append(r"\{" if char == "{" else char)
            at += 1
            continue
        out.append(_rewrite(special, groups))
        at = special.end()
    if _TAIL.search(pattern):
        # All of the rest has to match anyway, so nothing read is ever given back; a repeat
        # that may give back takes a stack frame for each character.
        out.append("+")
    kept = "".join(letter for letter in letters if letter in "imsx")
    return f"(?{'' if ascii_only else 'U'}d{kept})" + r"\A(?:" + "".join(out) + r")\z"


def _escaped(found: re.Match[str], in_bracket: bool, ascii_only: bool) -> str:
    code, name, octal, letter = found.groups()
    if code or name or octal:
        number = int(code, 16) if code else ord(unicodedata.lookup(name)) if name else int(octal, 8)
        return rf"\x{{{number:x}}}"
    if ascii_only and letter.lower() in _ASCII:
        inside = _ASCII[letter.lower()]
        if letter.isupper():
            return f"[^{inside}]"
        return inside if in_bracket else f"[{inside}]"
    return (_INSIDE if in_bracket else _OUTSIDE).get(letter, found[0])


def _rewrite(found: re.Match[str], groups: dict[str, str]) -> str:
    if found.re is _COMMENT:
        return ""
    if found.re is _GROUP_NAME:
        opened, used = found.groups()
        if opened:
            # Java allows no underscore in a group name.
            groups[opened] = f"g{len(groups) + 1}"
            return f"(?<{groups[opened]}>"
        return rf"\k<{groups[used]}>"
    low, comma, high = found.groups()
    if not low and not high:
        return "".join("\\" + c if c in "{}" else c for c in found[0])
    return f"{{{low or 0}{comma}{high}}}"


def check_patterns(spark: SparkSession, patterns: Iterable[str]) -> None:
    """Compile the Java patterns on a one-row local relation, so a bad one fails early."""
    patterns = list(patterns)
    if not patterns:
        return
    probe = spark.sql("SELECT * FROM VALUES ('') AS probe(t)")
    try:
        probe.select(*[F.col("t").rlike(p).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    except Exception as exc:
        raise RuleError(f"a pattern is not usable in Spark: {exc}") from exc
