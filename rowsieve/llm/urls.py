"""URL filter by the ratio of two character language models.

Rules name hosts and paths to allow or to block; they decide by themselves wherever one
fits, the longest first. All other URLs are judged by what the two groups look like: one
variable-order Markov model is learned from the accepted URLs and one from the rejected, each
the counts of every character after every context of up to ``ORDER`` characters. Orders are
mixed as Witten and Bell do: the more different characters have followed a context, the more
the next shorter one has a say. A URL is scored by the difference of its log-likelihoods per
character, and blocked below a threshold calibrated on a tenth of the URLs that rules
decide, which the models have not seen: the one with the best mean of both groups' accuracy.

The counts cover all URLs that rules decide, each text once, and grow with the input. What is
broadcast is bounded: a context is kept from ``1 / SHARE`` of the characters on, so there are
at most ``ORDER * SHARE`` of them in a group, whatever the input; rarer ones fall back to
shorter ones. Hosts and their rules stand under the model's characters as they do in the
URLs; the scheme does not.

Defined cases: a URL that is NULL or has no ``://`` has empty host and path; no rule fits it
and the model sees only its end, so its score is near 0. With one group empty nothing can be
told apart: everything that no rule decides is allowed. Repeated URLs get one verdict each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.common import stored

ORDER = 4
SHARE = 1 << 14
HELD_OUT = 10
START, END = "\x02", "\x03"
BINS = 200


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in small letters."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; NULL if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: len(rule.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _grams(texts: DataFrame) -> DataFrame:
    """(verdict, gram, n): how often each context with its next character occurs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for verdict, own in batch.groupby("verdict")["text"]:
                found: dict[str, int] = {}
                for text in own:
                    padded = START * ORDER + text + END
                    for at in range(ORDER, len(padded)):
                        for order in range(ORDER + 1):
                            gram = padded[at - order : at + 1]
                            found[gram] = found.get(gram, 0) + 1
                yield pd.DataFrame(
                    {"verdict": verdict, "gram": list(found), "n": list(found.values())}
                )

    counted = texts.select("verdict", "text").mapInPandas(count, "verdict string, gram string, n long")
    return counted.groupBy("verdict", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log-likelihoods per character by one group's counts."""

    def __init__(self, contexts: dict[str, tuple[int, dict[str, int]]]):
        self.contexts = contexts
        self.cache: dict[tuple[str, str], float] = {}

    def chance(self, context: str, character: str) -> float:
        found = self.cache.get((context, character))
        if found is None:
            # Below the shortest context all characters are alike.
            shorter = self.chance(context[1:], character) if context else 1 / 0x110000
            total, following = self.contexts.get(context, (0, {}))
            if total:
                found = (following.get(character, 0) + len(following) * shorter) / (
                    total + len(following)
                )
            else:
                found = shorter
            if len(self.cache) < 1_000_000:
                self.cache[context, character] = found
        return found

    def score(self, text: str) -> float:
        padded = START * ORDER + text + END
        logs = [
            math.log(self.chance(padded[at - ORDER : at], padded[at]))
            for at in range(ORDER, len(padded))
        ]
        return sum(logs) / len(logs)


def kept_contexts(grams: DataFrame) -> DataFrame:
    """(verdict, context, total, following): the contexts common enough to be kept."""
    context = F.expr("substring(gram, 1, char_length(gram) - 1)")
    following = F.struct(F.expr("right(gram, 1)").alias("character"), "n")
    own = grams.groupBy("verdict", context.alias("context")).agg(
        F.sum("n").alias("total"), F.collect_list(following).alias("following")
    )
    characters = grams.filter("char_length(gram) = 1").groupBy("verdict").agg(F.sum("n").alias("all"))
    return own.join(F.broadcast(characters), "verdict").filter(
        (F.col("context") == "") | (F.col("total") * SHARE >= F.col("all"))
    )


def scores(texts: DataFrame, contexts: DataFrame, text: str, score: str) -> DataFrame:
    """Adds the score of every text: accepted less rejected log-likelihood per character."""
    spark = texts.sparkSession
    found = contexts.select("verdict", "context", "total", "following").collect()
    models: dict[str, dict] = {"allow": {}, "block": {}}
    for verdict, context, total, following in found:
        models[verdict][context] = (total, {c: n for c, n in following})
    if not models["allow"] or not models["block"]:
        return texts.withColumn(score, F.lit(0.0))
    shared = spark.sparkContext.broadcast(models)

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        accepted, rejected = (Model(shared.value[name]) for name in ("allow", "block"))
        for part in parts:
            yield pd.Series(
                [accepted.score(one) - rejected.score(one) for one in part], dtype="float64"
            )

    return texts.withColumn(score, rate(F.col(text)))


def threshold(rated: DataFrame) -> float:
    """The score that tells the held-out groups apart best; rated: verdict and score."""
    bin_of = F.least(F.greatest(F.round(F.col("score") * (BINS / 4)), F.lit(-BINS)), F.lit(BINS))
    counts = rated.groupBy(bin_of.cast("int").alias("bin"), "verdict").count().collect()
    table = {"allow": np.zeros(2 * BINS + 1), "block": np.zeros(2 * BINS + 1)}
    for at, verdict, n in counts:
        table[verdict][at + BINS] += n
    if not table["allow"].sum() or not table["block"].sum():
        return 0.0
    blocked = np.cumsum(table["block"]) / table["block"].sum()
    allowed = 1 - np.cumsum(table["allow"]) / table["allow"].sum()
    gain = blocked + allowed
    # The middle of the best stretch lies farthest from both groups.
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return (float(best[len(best) // 2]) - BINS + 0.5) * 4 / BINS


def judged_urls(df: DataFrame, key: str, url: str, rules: Sequence[Rule]) -> DataFrame:
    """Key, host, path, rule, verdict and, where the models decide, score of every row."""
    address = F.col(f"`{url}`")
    rows = df.select(F.col(f"`{key}`").alias("_key"), host_of(address).alias("host"), path_of(address).alias("path"))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("_ruled"))
    rows = rows.withColumn("_text", F.concat("host", "path"))

    # Equal texts merge before they are shuffled, and teach once.
    ruled = rows.filter("_ruled is not null").groupBy("_text", F.col("_ruled").alias("verdict")).count()
    ruled = stored(ruled.select(F.col("_text").alias("text"), "verdict"))
    held_out = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    contexts = stored(kept_contexts(_grams(ruled.filter(~held_out))))
    least = threshold(scores(ruled.filter(held_out), contexts, "text", "score"))

    open_rows = scores(rows.filter("_ruled is null"), contexts, "_text", "score")
    chosen = F.when(F.col("score") < least, "block").otherwise("allow")
    done = open_rows.withColumn("verdict", chosen).unionByName(
        rows.filter("_ruled is not null")
        .withColumn("score", F.lit(None).cast("double"))
        .withColumn("verdict", F.col("_ruled"))
    )
    return done.select(F.col("_key").alias(key), "host", "path", "rule", "verdict", "score")
