"""Filter interaction audit by the Hart-Mas-Colell potential.

Five filters, each a condition that removes a document, are applied in every order. A
document falls to the first filter of an order that it fails, so what an order does depends
only on which filters each document fails: its mask, one of 32 coalitions. Every document
is reduced to (part, mask, good, toxic) on the executors, and counted per part and mask;
the rest works on 32 counts per part, which no table size changes.

The removal game gives a coalition ``S`` of filters the worth ``v(S)``: the documents that
fail any filter of ``S``. Its potential (Hart and Mas-Colell, 1989) is ``P({}) = 0`` and
``P(S) = (v(S) + sum over i in S of P(S - i)) / |S|``, computed coalition by coalition in
increasing mask order, where every ``S - i`` comes before ``S``. The Shapley value of a
filter is ``P(N) - P(N - i)``. To stay in integers the potential is kept as
``Q(S) = |S|! P(S)``, so that ``Q(S) = (|S| - 1)! v(S) + sum Q(S - i)``, and the removals of a
filter summed over all 120 orders are ``Q(N) - 5 Q(N - i)``. The steps of one order are
differences of the game: removed at a step is ``v(before + f) - v(before)``, kept after it
``total - v(before + f)``, and the same differences of the good and toxic games give what a
step loses of those.

All of it runs as built-in expressions over arrays of 32 per part: no Python workers.

Filters of the named query (words: maximal runs of other characters than blank, tab, line
feed, vertical tab, form feed and return; case-sensitive):

* A: under 100 words.
* B: 100 x distinct words < 80 x words.
* C: 100 x characters A-Z > 10 x code points.
* D: holds any of ``#$%&*|``.
* E: the same text as a document of smaller doc_id anywhere in the table, removed or not.

Defined cases: a NULL text is empty (it fails A only, and E where an empty text of smaller
doc_id exists); a NULL part is the empty string; a NULL doc_id is never smaller than any
other, so it neither fails E nor makes others fail it; repeated rows each count, and rows
repeating a doc_id with one text fail E against neither; labels count a document good (or
toxic) if any of its label rows says 1, and label rows without a document count for
nothing; an empty table gives no rows; other columns of the input, whatever their names,
are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.common import BLANKS, full_text

# The filters' letters, in the order of their mask bits.
FILTERS = "ABCDE"
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
SYMBOLS = r"[#$%&*|]"

COALITIONS = 1 << len(FILTERS)


def _two() -> Column:
    return F.array(*[F.lit(1 << bit) for bit in range(len(FILTERS))])


def _bit(letter: Column) -> Column:
    return F.create_map(*[one for bit, name in enumerate(FILTERS) for one in (F.lit(name), F.lit(1 << bit))])[letter]

ORDERS = ["".join(order) for order in permutations(FILTERS)]


def failures(text: str = "text") -> dict[str, Column]:
    """The Column of each filter that reads the text alone, true where the document fails
    it. E compares documents and is found by ``masks``."""
    whole = full_text(text)
    trimmed = F.regexp_replace(whole, rf"^{BLANKS}|{BLANKS}$", "")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))
    upper = F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_PERCENT,
        "C": upper * 100 > F.length(whole) * UPPER_PERCENT,
        "D": whole.rlike(SYMBOLS),
    }


def masks(
    docs: DataFrame,
    labels: DataFrame | None,
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """One row per part and mask: ``n``, ``good`` and ``toxic`` documents.

    The text is read where it lies: filters A to D become bits, the text a digest, and
    only these narrow rows meet again by digest to find E.
    """
    fails = failures(text)
    own = sum(
        (F.when(fails[letter], F.lit(1 << bit)).otherwise(F.lit(0)) for bit, letter in enumerate(FILTERS[:4])),
        F.lit(0),
    )
    rows = docs.select(
        F.col(doc_id).alias("_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"),
        own.alias("_own"),
        F.sha2(full_text(text), 256).alias("_digest"),
    )
    # Copies of one text merge per task before the shuffle, so a hot text weighs little.
    first = rows.groupBy("_digest").agg(F.min("_id").alias("_first_id"))
    copy = F.coalesce(F.col("_first_id") < F.col("_id"), F.lit(False))
    mask = F.col("_own") + F.when(copy, F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    judged = rows.join(first, "_digest").select("_id", "_part", mask.alias("mask"))
    if labels is not None:
        flags = labels.groupBy(F.col(doc_id).alias("_id")).agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"),
        )
        judged = judged.join(flags, "_id", "left")
    else:
        judged = judged.select("*", F.lit(False).alias("_good"), F.lit(False).alias("_toxic"))
    return judged.groupBy(F.col("_part").alias("part"), "mask").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce("_good", F.lit(False))).alias("good"),
        F.count_if(F.coalesce("_toxic", F.lit(False))).alias("toxic"),
    )


def _by_mask(counts: str) -> Column:
    """Array of 32 counts, index = mask, zeros where no document has that mask."""
    pairs = F.map_from_entries(F.collect_list(F.struct("mask", counts)))
    return F.transform(F.sequence(F.lit(0), F.lit(COALITIONS - 1)), lambda m: F.coalesce(pairs[m], F.lit(0).cast("long")))


def _game(counts: Column) -> Column:
    """v(S) for every coalition S: documents whose mask meets S."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(COALITIONS - 1)),
        lambda s: F.aggregate(
            F.sequence(F.lit(0), F.lit(COALITIONS - 1)),
            F.lit(0).cast("long"),
            lambda total, m: total + F.when((m.bitwiseAND(s)) != 0, counts[m]).otherwise(F.lit(0).cast("long")),
        ),
    )


def _potential(game: Column) -> Column:
    """Q(S) = |S|! P(S) for every coalition, built in increasing mask order."""
    size = lambda s: F.bit_count(s)
    fact = F.array(*[F.lit(factorial(k)).cast("long") for k in range(len(FILTERS) + 1)])

    def step(acc: Column, s: Column) -> Column:
        below = F.aggregate(
            F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)),
            F.lit(0).cast("long"),
            lambda total, i: total
            + F.when(s.bitwiseAND(_two()[i]) != 0, acc[s - _two()[i]]).otherwise(
                F.lit(0).cast("long")
            ),
        )
        return F.concat(acc, F.array(fact[size(s) - 1] * game[s] + below))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(COALITIONS - 1)), F.array(F.lit(0).cast("long")), step
    )


def audit(counts: DataFrame) -> DataFrame:
    """From ``masks``: one row per part, order of the five filters and step."""
    per_part = counts.groupBy("part").agg(
        _by_mask("n").alias("_n"), _by_mask("good").alias("_g"), _by_mask("toxic").alias("_t")
    )
    games = per_part.select(
        "part",
        "_n",
        _game(F.col("_n")).alias("_v"),
        _game(F.col("_g")).alias("_vg"),
        _game(F.col("_t")).alias("_vt"),
    ).select("*", _potential(F.col("_v")).alias("_q"))
    everyone = COALITIONS - 1
    orders = F.array(*[F.lit(order) for order in ORDERS])
    steps = games.select("*", F.explode(orders).alias("filter_order")).select(
        "*", F.posexplode(F.split("filter_order", "")).alias("_place", "_letter")
    )
    bit = _bit(F.col("_letter"))
    # Filters before this step: bits of the first _place letters of the order.
    before = F.aggregate(
        F.slice(F.split("filter_order", ""), 1, F.col("_place")),
        F.lit(0),
        lambda acc, letter: acc.bitwiseOR(_bit(letter)),
    )
    with_f = before.bitwiseOR(bit)
    # All documents of the part, those that fail no filter (mask 0) included.
    total = F.aggregate("_n", F.lit(0).cast("long"), lambda acc, n: acc + n)
    removed = F.col("_v")[with_f] - F.col("_v")[before]
    return steps.select(
        "part",
        "filter_order",
        (F.col("_place") + 1).cast("int").alias("step"),
        (total - F.col("_v")[with_f]).alias("kept"),
        removed.alias("removed"),
        (F.col("_v")[bit] - removed).alias("redundant"),
        F.col("_n")[bit].alias("unique_fails"),
        (F.col("_vg")[with_f] - F.col("_vg")[before]).alias("good_lost"),
        (F.col("_vt")[with_f] - F.col("_vt")[before]).alias("toxic_lost"),
        (F.col("_q")[everyone] - F.lit(len(FILTERS)) * F.col("_q")[everyone - bit]).alias("shapley"),
    )
