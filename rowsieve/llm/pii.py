"""Personal data: generated candidates, boosted trees, calibrated selection.

For every kind there are two generators. The strict one finds what has the kind's exact form
and passes its check; these base spans are always selected. The loose one proposes whatever
looks like the kind, also spaced, bracketed or otherwise disguised; its spans may overlap each
other and the base. Each loose candidate is put back into plain form (``[at]`` and `` @ `` to
``@``, ``[dot]`` to ``.``, a leading ``00`` or the trunk ``0`` of a national number to ``+``,
commas of addresses to dots, the one kind of separator of a card number dropped), and its
label is whether that form has the kind's strict form and passes its check. Boosted trees
rate candidates by format (how far the match is from its plain form, number of digits) and
context (characters on both sides), learning from the corpus itself which formats and
contexts hold real data; nothing that tells the label itself is a feature. A candidate is
selected where its plain form passes and its code scores at or above its kind's threshold:
the lowest at which ``PRECISION`` of the kind's candidates held out of training (a fifth, by
their text) pass; codes of equal score are taken or left together.

Features are small categories, so a candidate is one of ``CODES`` codes. Counts of codes over
all documents are all that training needs; they are gathered as one row per code and label,
whatever the corpus's size, and the trees' verdict is a list of codes. Texts are read once.

Spans are in code points, the end exclusive. Defined cases: a NULL text is empty; matches of
one kind never overlap, of different kinds they may; a match that fails its check is dropped
and not retried; patterns never go back over what they have read, so that very long texts
take time in proportion to their length; repeated rows each get a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.common import neutral, stored

PRECISION = 0.99
ROUNDS = 30
RATE = 0.3
DEPTH = 3
HELD_OUT = 5


@dataclass(frozen=True)
class Kind:
    """``strict`` and ``loose`` patterns, the check on ``m``, what must be in a text, and
    the plain form of a loose match ``m``."""

    name: str
    strict: str
    loose: str
    check: str
    needs: str
    plain: str


_DIGITS = "length(regexp_replace(m, '[^0-9]+', ''))"
# A match of letters and digits can only begin where a run of them does, or where the last
# match has ended.
_EMAIL_RUN = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
KINDS = [
    Kind(
        "email",
        _EMAIL_RUN + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        _EMAIL_RUN
        + r"(?: ?@ ?| ?[\[(](?:at|AT)[\])] ?)[A-Za-z0-9-]++(?:(?: ?[\[(](?:dot|DOT)[\])] ?|\.)[A-Za-z0-9-]++)++",
        "true",
        r"@|[\[(](?:at|AT)[\])]",
        r"regexp_replace(regexp_replace(regexp_replace(m, ' ?[\\[(](?:dot|DOT)[\\])] ?', '.'),"
        r" ' ?[\\[(](?:at|AT)[\\])] ?', '@'), ' ?@ ?', '@')",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"(?<![0-9])[0-9]{1,3}+(?: ?[.,] ?[0-9]{1,3}+){3}+",
        r"forall(split(m, '[^0-9]+'), p -> length(ltrim('0', p)) < 4 and int(right(concat('00', p), 3)) < 256)",
        r"[0-9] ?[.,] ?[0-9]",
        "replace(replace(m, ' ', ''), ',', '.')",
    ),
    Kind(
        "card",
        r"[0-9](?:[ -]?+[0-9]){13,}+",
        r"[0-9](?:[ ./_-]?+[0-9]){12,}+",
        f"{_DIGITS} between 14 and 19 and luhn_check(regexp_replace(m, '[^0-9]+', ''))",
        r"(?:[0-9][ ./_-]?){13}",
        # Written with one kind of separator at most, as card numbers are.
        "if(replace(regexp_replace(m, '[0-9]+', ''), left(regexp_replace(m, '[0-9]+', ''), 1), '') = '',"
        " regexp_replace(m, '[^0-9]+', ''), m)",
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        r"(?<![0-9])(?:\+|00)?+\(?+[0-9]{1,4}+(?:[ ().-]{1,2}+[0-9]{2,8}+){2,5}+",
        f"{_DIGITS} between 10 and 15",
        r"[0-9][ ().-]{1,2}[0-9]|\+[0-9]",
        # A national number begins with its trunk 0; other bare numbers stay as they are.
        "case when m like '+%' then m when m like '00%' then concat('+', substr(m, 3))"
        " when m rlike '^[(]?0' then concat('+', m) else m end",
    ),
]
# Categories of each feature, in order.
FEATURES = {"form": 3, "digits": 4, "before": 3, "after": 3}
CODES = len(KINDS) * math.prod(FEATURES.values())


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _matches(text: str, pattern: str, needs: str) -> Column:
    """array of (m, start, end, before, after) of all matches; start and end in code points."""
    quoted = _sql(pattern)
    # Pieces between matches give the places that the matches alone do not.
    return F.expr(
        f"""if(not rlike({text}, '{_sql(needs)}'),
          cast(array() as array<struct<m: string, start: int, end: int, before: string, after: string>>),
          transform(array(named_struct(
            'p', split({text}, '{quoted}', -1), 'm', regexp_extract_all({text}, '{quoted}', 0))),
            x -> transform(
              aggregate(
                zip_with(slice(x.p, 1, size(x.m)), x.m, (p, m) -> named_struct('p', length(p), 'm', length(m))),
                named_struct('at', 0, 'got', cast(array() as array<struct<start: int, end: int>>)),
                (s, l) -> named_struct('at', s.at + l.p + l.m,
                  'got', array_append(s.got, named_struct('start', s.at + l.p, 'end', s.at + l.p + l.m))),
                s -> s.got),
              (g, i) -> named_struct('m', get(x.m, i), 'start', g.start, 'end', g.end,
                'before', right(get(x.p, i), 1), 'after', left(get(x.p, i + 1), 1))))[0])"""
    )


def _side(column: str) -> str:
    return rf"case when {column} rlike '^[\\x09-\\x0D\\x20]?$' then 0 when {column} rlike '[\\p{{L}}\\p{{Nd}}]' then 1 else 2 end"


def _code(at: int, kind: Kind) -> str:
    """The code of a match m with plain form p: kind and features as digits of one number."""
    form = "case when m = p then 0 when replace(m, ' ', '') = replace(p, ' ', '') then 1 else 2 end"
    digits = f"case when {_DIGITS} < 10 then 0 when {_DIGITS} < 14 then 1 when {_DIGITS} <= 19 then 2 else 3 end"
    values = [form, digits, _side("before"), _side("after")]
    code = str(at)
    for value, n in zip(values, FEATURES.values(), strict=True):
        code = f"({code}) * {n} + {value}"
    return code


def with_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_base`` (spans: start, kind number, end) and ``_loose`` (the same with code,
    whether its plain form passes, and whether it is held out of training)."""
    df = df.withColumn("_text", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    bases, looses = [], []
    for at, kind in enumerate(KINDS):
        df = df.withColumn(f"_strict{at}", _matches("_text", kind.strict, kind.needs))
        df = df.withColumn(f"_loose{at}", _matches("_text", kind.loose, kind.needs))
        # Names of fields stand for the parts of a match in checks and codes.
        inner = "transform(array(x.m), m -> {})[0]"
        passed = inner.format(kind.check)
        bases.append(
            f"""transform(filter(_strict{at}, x -> {passed}),
              x -> named_struct('start', x.start, 'kind', {at}, 'end', x.end))"""
        )
        plain = inner.format(kind.plain)
        # Its plain form has the strict form and passes the check.
        passes = f"transform(array({plain}), m -> m rlike '^(?:{_sql(kind.strict)})$' and {kind.check})[0]"
        code = (
            f"transform(array(x.m), m -> transform(array({kind.plain}), p -> transform(array(x.before), "
            f"before -> transform(array(x.after), after -> {_code(at, kind)})[0])[0])[0])[0]"
        )
        looses.append(
            f"""transform(_loose{at}, x -> named_struct('start', x.start, 'kind', {at}, 'end', x.end,
              'code', {code}, 'held', pmod(xxhash64(x.m), {HELD_OUT}) = 0, 'passes', coalesce({passes}, false)))"""
        )
    df = df.withColumn("_base", F.expr(f"array_sort(concat({', '.join(bases)}))"))
    df = df.withColumn(
        "_loose",
        F.expr(
            f"""transform(concat({', '.join(looses)}), x -> named_struct(
              'span', named_struct('start', x.start, 'kind', x.kind, 'end', x.end),
              'code', x.code, 'held', x.held, 'passes', x.passes))"""
        ),
    )
    return df.drop("_text", *[f"_{name}{at}" for name in ("strict", "loose") for at in range(len(KINDS))])


# (kind, features), positive and negative weight
Row = tuple[tuple[int, ...], float, float]


def features_of(code: int) -> tuple[int, ...]:
    values = []
    for n in reversed([len(KINDS), *FEATURES.values()]):
        values.append(code % n)
        code //= n
    return tuple(reversed(values))


def _grow(rows: list[tuple[tuple[int, ...], float, float]], depth: int):
    """A tree over (features, gradient, curvature): a leaf's step, or a question and two trees."""
    total = sum(g for _, g, _ in rows), sum(h for *_, h in rows)
    best, question = total[0] ** 2 / (total[1] + 1.0) + 1e-9, None
    if depth:
        sums: dict[tuple[int, int], tuple[float, float]] = {}
        for features, g, h in rows:
            for item in enumerate(features):
                had = sums.get(item, (0.0, 0.0))
                sums[item] = had[0] + g, had[1] + h
        for item, (g, h) in sorted(sums.items()):
            rest = total[0] - g, total[1] - h
            gain = g * g / (h + 1.0) + rest[0] ** 2 / (rest[1] + 1.0)
            if gain > best:
                best, question = gain, item
    if question is None:
        return total[0] / (total[1] + 1.0)
    at, value = question
    yes = [row for row in rows if row[0][at] == value]
    no = [row for row in rows if row[0][at] != value]
    return question, _grow(yes, depth - 1), _grow(no, depth - 1)


def _answer(tree, features: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        (at, value), yes, no = tree
        tree = yes if features[at] == value else no
    return tree


def boosted(rows: Sequence[Row]) -> list:
    """Trees fitted one after the other to what the sum of those before leaves unexplained."""
    trees: list = []
    scores = [0.0] * len(rows)
    for _ in range(ROUNDS):
        steps = []
        for (features, good, bad), score in zip(rows, scores, strict=True):
            chance = 1 / (1 + math.exp(-score))
            n = good + bad
            steps.append((features, good - n * chance, n * chance * (1 - chance)))
        tree = _grow(steps, DEPTH)
        trees.append(tree)
        scores = [s + RATE * _answer(tree, row[0]) for s, row in zip(scores, rows, strict=True)]
    return trees


def score(trees: Sequence, code: int) -> float:
    features = features_of(code)
    return sum(RATE * _answer(tree, features) for tree in trees)


def selected_codes(counts: Sequence[tuple[int, bool, bool, int]]) -> list[int]:
    """Codes to select, from (code, held out, plain form passes, number of candidates).

    One model for all kinds, one threshold for each: codes of a kind in falling score,
    taken while the held-out candidates down to them pass in ``PRECISION`` of cases; codes
    of equal score are taken or left together."""
    taught: dict[int, list[float]] = {}
    held: dict[int, list[float]] = {}
    for code, is_held, passes, n in counts:
        (held if is_held else taught).setdefault(code, [0.0, 0.0])[0 if passes else 1] += n
    if not taught or not held:
        return []
    rows = [(features_of(code), good, bad) for code, (good, bad) in sorted(taught.items())]
    trees = boosted(rows)
    chosen: list[int] = []
    for kind in range(len(KINDS)):
        mine = [code for code in {*taught, *held} if features_of(code)[0] == kind]
        by_score: dict[float, list[int]] = {}
        for code in mine:
            by_score.setdefault(round(score(trees, code), 12), []).append(code)
        good = bad = 0.0
        taken: list[int] = []
        kept: list[int] = []
        for value in sorted(by_score, reverse=True):
            tie = by_score[value]
            taken += tie
            good += sum(held.get(code, [0, 0])[0] for code in tie)
            bad += sum(held.get(code, [0, 0])[1] for code in tie)
            if good and good >= PRECISION * (good + bad):
                kept = list(taken)
        chosen += kept
    return sorted(chosen)


def with_spans(candidates: DataFrame) -> DataFrame:
    """Adds ``_spans``, base and selected ones; ``candidates`` are stored."""
    seen = candidates.select(F.explode("_loose").alias("c"))
    counts = seen.groupBy("c.code", "c.held", "c.passes").count()
    codes = selected_codes([tuple(row) for row in counts.collect()])
    listed = ", ".join(map(str, codes)) or "-1"
    chosen = f"transform(filter(_loose, x -> x.passes and x.code in ({listed})), x -> x.span)"
    return candidates.withColumn("_spans", F.expr(f"array_sort(array_union(_base, {chosen}))"))


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = ", ".join(f"'{kind.name}'" for kind in KINDS)
    return F.expr(
        f"""array_join(transform({spans}, x -> concat_ws(':', get(array({names}), x.kind), x.start, x.end)), ',')"""
    )


def personal_data(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, ``n_<kind>`` of base spans, ``base`` and ``spans`` as text."""
    found = with_candidates(df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_t")), "_t").drop("_t")
    found = with_spans(stored(found))
    counts = [
        F.expr(f"cast(size(filter(_base, x -> x.kind = {at})) as long)").alias(f"n_{kind.name}")
        for at, kind in enumerate(KINDS)
    ]
    return found.select(F.col(f"`{key}`"), *counts, joined("_base").alias("base"), joined("_spans").alias("spans"))


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every selected span replaced by its kind in angle brackets; where
    spans overlap, they are replaced together by the first one's kind."""
    outer = df
    df, (text,), back = neutral(df, text)
    found = with_spans(stored(with_candidates(df, text)))
    names = ", ".join(f"'<{kind.name}>'" for kind in KINDS)
    done = f"""if(size(_spans) = 0, `{text}`, aggregate(_spans,
      named_struct('out', '', 'at', 0),
      (s, x) -> if(x.start >= s.at,
        named_struct('out', concat(s.out, substring(`{text}`, s.at + 1, x.start - s.at), get(array({names}), x.kind)), 'at', x.end),
        named_struct('out', s.out, 'at', greatest(s.at, x.end))),
      s -> concat(s.out, substring(`{text}`, s.at + 1))))"""
    return found.withColumn(text, F.expr(done)).select(*back).select(*[f"`{name}`" for name in outer.columns])
