"""Quality rules by divergence from language references.

Two histograms describe a document: the classes of its characters, and how often the common
words of its language stand in it. Each is compared with the same histogram of all documents
of that language by Jensen-Shannon distance (base 2, from 0 to 1). Documents too short for
their histogram to mean anything are not judged by it (``LEAST_CHARS``, ``LEAST_WORDS``).
Next to these stand plain counts, and two rules on them that reject by themselves.

The references cover all documents and have one row per language. Common words are sought
among words of at most ``COMMON_LENGTH`` characters, as the commonest words of a language are
short; so the counts gathered stay few however many different words a corpus has.

Words are maximal runs of other characters than blank, tab, line feed, vertical tab, form
feed and return, as they stand. Defined cases: a NULL text counts as empty and fails, as all
texts under ``BASE_WORDS`` words do; NULL is a language of its own; a language with a single
document is at distance 0 from itself; repeated rows each count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsieve.llm.common import BLANKS, full_text, stored

# The base rules and their window.
BASE_WORDS = 10
BASE_REPEAT_PERCENT = 20
WINDOW = 5

COMMON_WORDS = 24
COMMON_LENGTH = 4
LEAST_CHARS = 200
LEAST_WORDS = 40
# Halfway between what labelled good and bad documents reach.
MOST_CLASS_DISTANCE = 0.3
MOST_WORD_DISTANCE = 0.42
# Blanks and all characters that are in none of these are two more classes.
CLASSES = {
    "lower": r"\p{Ll}",
    "upper": r"\p{Lu}",
    "digit": r"\p{Nd}",
    "stop": r".,;:?'\"()-",
    "symbol": r"#*$%&|<>",
}
_RARE = [characters for name, characters in CLASSES.items() if name != "lower"]
BROADCAST_LANGUAGES = 10_000


def with_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds ``_words`` (array), ``_classes`` (counts, blanks and others last) and ``_lang``."""
    whole = full_text(text)
    trimmed = F.btrim(whole, F.lit(" \t\n\x0b\f\r"))
    df = df.select(
        "*",
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang"),
        F.array_remove(F.split(trimmed, BLANKS), "").alias("_words"),
    )
    # Most characters are small letters and blanks. What is left without these is short.
    left, counts = whole, []
    for place, characters in enumerate((CLASSES["lower"], r"\x20\x09-\x0D", *_RARE)):
        df = df.withColumn(f"_left{place}", F.regexp_replace(left, f"[{characters}]+", ""))
        counts.append(F.length(left) - F.length(f"_left{place}"))
        left = F.col(f"_left{place}")
    lower, blank, *rare = counts
    classes = F.array(lower, *rare, blank, F.length(left))
    black = F.length(whole) - blank
    return df.select("*", classes.alias("_classes"), black.alias("_black")).drop(
        *[f"_left{place}" for place in range(len(counts))]
    )


def references(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per language: ``common`` words, ``common_share`` and ``class_share``.

    Shares hold one number per common word and one for all other words, or one per class.
    """
    # Each document gives its class counts, its number of words, and its short words.
    named = F.expr(
        f"""concat(
          transform(_classes, (n, i) -> named_struct('kind', 'class', 'name', cast(i as string), 'n', cast(n as bigint))),
          array(named_struct('kind', 'all', 'name', '', 'n', cast(size(_words) as bigint))),
          transform(filter(_words, w -> char_length(w) <= {COMMON_LENGTH}),
            w -> named_struct('kind', 'word', 'name', w, 'n', 1L)))"""
    )
    totals = (
        with_counts(df, text, lang)
        .select("_lang", F.explode(named).alias("c"))
        .groupBy("_lang", "c.kind", "c.name")
        .agg(F.sum("c.n").alias("n"))
    )
    by_count = Window.partitionBy("_lang", "kind").orderBy(F.desc("n"), "name")
    ranked = totals.withColumn("place", F.row_number().over(by_count))
    ranked = ranked.filter((F.col("kind") != "word") | (F.col("place") <= COMMON_WORDS))

    def gathered(kind: str, value: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, value)))

    found = ranked.groupBy("_lang").agg(
        gathered("word", F.struct("place", F.col("name").alias("word"), "n")).alias("_common"),
        gathered("class", F.struct(F.col("name").cast("int").alias("at"), "n")).alias("_at"),
        F.max(F.when(F.col("kind") == "all", F.col("n"))).alias("_all"),
    )
    found = found.withColumn("_class", F.col("_at.n"))
    found = found.select(
        "*",
        F.expr("_all - aggregate(_common, 0L, (s, c) -> s + c.n)").alias("_rest"),
        F.expr("aggregate(_class, 0L, (s, n) -> s + n)").alias("_characters"),
    )
    return found.select(
        "_lang",
        F.col("_common.word").alias("common"),
        F.expr("transform(concat(_common.n, array(_rest)), n -> n / greatest(_all, 1))").alias(
            "common_share"
        ),
        F.expr("transform(_class, n -> n / greatest(_characters, 1))").alias("class_share"),
    )


def distance(counts: str, total: str, shares: str) -> Column:
    """Jensen-Shannon distance of an array of counts, which sum up to ``total``, from shares."""
    return F.expr(
        f"""aggregate(
          zip_with({counts}, {shares}, (n, q) -> named_struct('p', n / greatest({total}, 1), 'q', q)),
          0D,
          (sum, x) -> sum
            + if(x.p > 0, x.p * log2(2 * x.p / (x.p + x.q)), 0D) / 2
            + if(x.q > 0, x.q * log2(2 * x.q / (x.p + x.q)), 0D) / 2,
          sum -> sqrt(greatest(sum, 0D)))"""
    )


def with_base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    lines = F.filter(F.split(full_text(text), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    # The last windows are cut short, each to another length, and so are like no other.
    pieces = ", ".join(f"get(_words, i + {step})" for step in range(1, WINDOW))
    windows = F.expr(f"transform(_words, (w, i) -> xxhash64(w, {pieces}))")
    df = df.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.col("_black").cast("long").alias("word_chars"),
        F.get("_classes", list(CLASSES).index("symbol")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        windows.alias("_windows"),
    )
    # Equal windows stand side by side once sorted.
    sorted_windows = F.expr(
        """if(size(array_distinct(_windows)) = size(_windows),
          cast(array() as array<struct<h: bigint, i: int>>),
          array_sort(transform(_windows, (h, i) -> named_struct('h', h, 'i', i))))"""
    )
    df = df.withColumn("_sorted", sorted_windows)
    places = F.expr(
        """array_sort(transform(filter(
          transform(_sorted, (x, i) -> named_struct('i', x.i, 'twin',
            x.h = get(_sorted, i - 1).h or x.h = get(_sorted, i + 1).h)),
          x -> x.twin), x -> x.i))"""
    )
    df = df.withColumn("_places", places)
    covered = F.expr(
        f"""aggregate(_places, named_struct('n', 0L, 'end', 0),
          (s, i) -> named_struct(
            'n', s.n + least({WINDOW}, i + {WINDOW} - s.end), 'end', i + {WINDOW}),
          s -> s.n)"""
    )
    return df.select(
        "*",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    ).drop(
        "_lines", "_windows", "_sorted", "_places"
    )


def judged(df: DataFrame, found: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds the base counts, ``class_distance``, ``word_distance``, ``base_failed`` and ``kept``.

    ``found`` are the ``references``.
    """
    # Written once, so that counting them and joining them read the text once.
    found = stored(found)
    small = F.broadcast(found) if found.count() <= BROADCAST_LANGUAGES else found
    rows = with_base_counts(with_counts(df, text, lang), text).join(small, "_lang", "left")
    rows = rows.withColumn("_hits", F.expr("filter(_words, w -> array_contains(common, w))"))
    common = "transform(common, c -> size(_hits) - size(array_remove(_hits, c)))"
    rows = rows.withColumn(
        "_common", F.expr(f"concat({common}, array(size(_words) - size(_hits)))")
    )
    rows = rows.withColumn("_characters", F.length(full_text(text)))
    rows = rows.select(
        "*",
        F.when(F.col("word_chars") >= LEAST_CHARS, distance("_classes", "_characters", "class_share")).alias(
            "class_distance"
        ),
        F.when(F.col("n_words") >= LEAST_WORDS, distance("_common", "n_words", "common_share")).alias(
            "word_distance"
        ),
    )
    failed = (F.col("n_words") < BASE_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words")
    )
    far = F.coalesce(F.col("class_distance") > MOST_CLASS_DISTANCE, F.lit(False)) | F.coalesce(
        F.col("word_distance") > MOST_WORD_DISTANCE, F.lit(False)
    )
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    added += ["class_distance", "word_distance"]
    return rows.select(
        *[F.col(f"`{name}`") for name in df.columns if name not in added],
        *added,
        failed.alias("base_failed"),
        (~failed & ~far).alias("kept"),
    )


def kept_documents(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that pass, with their own columns."""
    tagged = df.select(F.struct("*").alias("_row"), F.col(text).alias("_t"), F.col(lang).alias("_l"))
    verdicts = judged(tagged, references(tagged.select("_t", "_l"), "_t", "_l"), "_t", "_l")
    # A filter would be pushed below all that the verdict is made of, and repeat it there.
    return verdicts.select(F.inline(F.expr("if(kept, array(_row), filter(array(_row), x -> false))")))
