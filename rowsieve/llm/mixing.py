"""Mixing sources to target weights by a hypergeometric splitting tree.

Every source's rows are put into a random but repeatable order, a tape of words that may be
played up to ``LIMIT`` times. A source's target says how far its tape plays. What is played is
cut into blocks of equal words, and the tree deals the blocks to output shards: at each node
an urn holds the node's blocks of all sources, and the left child draws its share without
replacement, so that the sources' numbers in it are multivariate hypergeometric and the
quotas always sum up exactly. Each leaf then takes so many of the source's blocks, in another
random order and disjoint from all others, and ``turn`` shuffles the rows inside a shard.

Targets: sources weigh by ``WEIGHTS`` in order of their names, NULL last, and share
``SHARE`` times all words; none gets more than ``LIMIT`` times its own words, and the rest is
shared again by weight. That is one level of water over all sources: the target is
``min(LIMIT * size, level * weight)``.

Rows stay whole. Around the end of a tape's play the rows of ``ZONE`` words on both sides are
chosen by size, largest first, each if it still fits. What is then missing, as where one row
is longer than the zone, is taken from the rows behind it by their sizes, largest first; so
the words taken miss the target by less than the smallest of all rows left out.

The tables of sources (one row each) and of blocks (``BLOCKS`` and at most two more for each
source) do not grow with the text. Defined cases: NULL texts and texts without words have
size 0 and are never taken; repeated rows each count; a table without words has targets 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsieve.llm.common import each_copy, neutral, placed, stored, with_copies

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
BLOCKS = 4096
LEVELS = 4
ZONE = 8192
BUCKET_BITS = 12
BROADCAST_ROWS = 100_000

SOURCE = ["_source", "_unnamed"]


@dataclass(frozen=True)
class Mix:
    """``rows`` has every input row with its ``taken`` words and ``draws``, an array of the
    shard of each time that it is played; ``sources`` has one row for each source."""

    rows: DataFrame
    sources: DataFrame


def _small(df: DataFrame) -> DataFrame:
    """Broadcast where the number of rows allows it; else Spark joins as it sees fit."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def source_targets(totals: DataFrame) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row per source with its ``source_size``."""
    by_name = Window.orderBy("_unnamed", "_source")
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    weighed = totals.withColumn("weight", weight.cast("double"))
    limit = F.col("source_size") * LIMIT
    by_ratio = Window.orderBy(limit / F.col("weight"), "_unnamed", "_source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.lit(SHARE) * F.sum("source_size").over(everything) - F.coalesce(
        F.sum(limit).over(before), F.lit(0)
    )
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = weighed.select("*", (left / heavy).alias("_level"))
    # Sources before the first that can hold its share are full; that one sets the level,
    # the highest of all that hold.
    holds = F.col("_level") * F.col("weight") <= limit
    level = F.max(F.when(holds, F.col("_level"))).over(everything)
    target = F.least(limit.cast("double"), level * F.col("weight"))
    return leveled.select(*SOURCE, "source_size", "weight", target.alias("target"))


def deal_blocks(sources: DataFrame, seed: int) -> DataFrame:
    """The shard of every block played: source, ``block``, ``shard``."""
    blocks = sources.filter("quota > 0").select(
        *SOURCE, F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("block")
    )
    urn = blocks.withColumn("node", F.lit(0))
    for level in range(LEVELS):
        drawn = F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), *SOURCE, F.col("block"))
        turn = F.row_number().over(Window.partitionBy("node").orderBy(drawn, *SOURCE, "block"))
        half = F.count(F.lit(1)).over(Window.partitionBy("node"))
        urn = urn.select("*", turn.alias("_turn"), half.alias("_half")).select(
            *SOURCE,
            "block",
            (F.col("node") * 2 + (F.col("_turn") * 2 > F.col("_half") + 1).cast("int")).alias("node"),
        )
    # The urn gives each leaf its number of blocks of each source. Which blocks these are is
    # decided by a permutation of the source's blocks of its own.
    by_leaf = Window.partitionBy(*SOURCE).orderBy("node", "block")
    quotas = urn.select(*SOURCE, F.col("node").alias("shard"), F.row_number().over(by_leaf).alias("n"))
    mixed = F.xxhash64(F.lit(seed + 1), *SOURCE, F.col("block"))
    permuted = Window.partitionBy(*SOURCE).orderBy(mixed, "block")
    order = blocks.select(*SOURCE, "block", F.row_number().over(permuted).alias("n"))
    return order.join(quotas, [*SOURCE, "n"]).select(*SOURCE, "block", "shard")


def taken_behind(behind: DataFrame) -> DataFrame:
    """Which rows fill up what is missing: source, ``size`` and the ``last`` unit to take of it.

    ``behind`` has the rows left (source, ``left``, ``size``, ``unit``), none larger than
    ``left``. Of each size as many are taken as fit after the larger ones, first on the tape
    first. There are no more sizes than the words of the longest row.
    """
    behind = stored(behind.withColumn("bucket", F.shiftright("unit", BUCKET_BITS)))
    sizes = behind.groupBy(*SOURCE, "left", "size").agg(F.count(F.lit(1)).alias("n"))
    each = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("minus"), "n")))
    takes = sizes.groupBy(*SOURCE, "left").agg(each.alias("_sizes"))
    takes = takes.select(
        *SOURCE,
        F.explode(
            F.expr(
                """aggregate(_sizes,
                  named_struct('left', left, 'takes', cast(array() as array<struct<size: bigint, k: bigint>>)),
                  (had, row) -> if(-row.minus <= had.left,
                    named_struct(
                      'left', had.left + row.minus * least(row.n, had.left div -row.minus),
                      'takes', array_append(had.takes, named_struct(
                        'size', -row.minus, 'k', least(row.n, had.left div -row.minus)))),
                    had),
                  had -> had.takes)"""
            )
        ).alias("_take"),
    )
    takes = stored(takes.select(*SOURCE, "_take.size", "_take.k"))
    rows = behind.join(_small(takes), [*SOURCE, "size"]).withColumn("copies", F.lit(1))
    order = placed(rows, [*SOURCE, "size"], "bucket", ["unit"], F.lit(0))
    return order.filter("before < k").groupBy(*SOURCE, "size").agg(F.max("unit").alias("last"))


def mix(df: DataFrame, key: Column, source: Column, size: Column, seed: int = 0) -> Mix:
    """Decides how often every row is played, and in which shards.

    ``key`` tells rows apart where that matters; rows with equal key, source and size are
    interchangeable. Rows come back as ``key``, ``source``, ``size``, ``source_size``,
    ``target``, ``taken``, ``draws`` and ``turn``.
    """
    rows = df.select(
        key.alias("key"),
        F.coalesce(source, F.lit("")).alias("_source"),
        source.isNull().alias("_unnamed"),
        size.cast("long").alias("size"),
    )
    rows = with_copies(rows, rows.columns)
    turn = F.xxhash64(F.lit(seed), "key", "size", *SOURCE)
    rows = rows.withColumn("turn", turn)
    rows = rows.withColumn("bucket", F.shiftrightunsigned("turn", 64 - BUCKET_BITS))
    rows = stored(rows)

    totals = rows.groupBy(*SOURCE).agg(F.sum(F.col("copies") * F.col("size")).alias("source_size"))
    goal = F.round("target").cast("long")
    sources = source_targets(totals).withColumn("goal", goal)
    everything = F.sum("source_size").over(Window.partitionBy())
    sources = sources.withColumn("block_words", F.greatest(F.lit(1), F.ceil(everything / BLOCKS)))
    sources = stored(sources.withColumn("quota", F.ceil(F.col("goal") / F.col("block_words"))))

    tape = placed(rows, SOURCE, "bucket", ["turn", "key", "size"], F.col("size"))
    tape = stored(
        each_copy(tape).select(
            "key",
            *SOURCE,
            "size",
            "turn",
            (F.col("before") + F.col("copy")).alias("unit"),
            (F.col("weight_before") + F.col("copy") * F.col("size")).alias("start"),
        )
    )
    # Of the last play of a tape only a part is heard, up to ``rest``.
    plays = F.expr("if(goal >= source_size, 1, 0)")
    ends = sources.withColumn("plays", plays).withColumn(
        "rest", F.col("goal") - F.col("plays") * F.col("source_size")
    )
    near = (F.col("start") + F.col("size") > F.col("rest") - ZONE) & (
        F.col("start") < F.col("rest") + ZONE
    )
    heard = (F.col("size") > 0) & (F.col("rest") > 0)
    zone = tape.join(_small(ends), SOURCE).filter(heard & near)
    chosen = zone.groupBy(*SOURCE).agg(
        F.max("rest").alias("_rest"),
        F.min("start").alias("_first"),
        F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("minus"), "turn", "unit"))).alias(
            "_zone"
        ),
    )
    chosen = chosen.select(
        *SOURCE,
        F.expr(
            """aggregate(_zone,
              named_struct('left', _rest - _first, 'units', cast(array() as array<bigint>)),
              (had, row) -> if(-row.minus <= had.left,
                named_struct('left', had.left + row.minus, 'units', array_append(had.units, row.unit)),
                had))"""
        ).alias("_had"),
    )
    chosen = chosen.select(*SOURCE, F.col("_had.units").alias("chosen"), F.col("_had.left").alias("left"))
    sources = stored(ends.join(chosen, SOURCE, "left"))
    short = sources.filter("left > 0").select(*SOURCE, "rest", "left")
    behind = tape.join(_small(short), SOURCE).filter(
        heard & ~near & (F.col("start") >= F.col("rest")) & (F.col("size") <= F.col("left"))
    )
    more = stored(taken_behind(behind.select(*SOURCE, "left", "size", "unit")))
    blocks = stored(deal_blocks(sources, seed))

    joined = tape.join(_small(sources), SOURCE).join(_small(more), [*SOURCE, "size"], "left")
    again = heard & F.when(
        near, F.coalesce(F.array_contains("chosen", F.col("unit")), F.lit(False))
    ).otherwise(
        (F.col("start") < F.col("rest")) | F.coalesce(F.col("unit") <= F.col("last"), F.lit(False))
    )
    times = F.when(F.col("size") > 0, F.col("plays") + again.cast("int")).otherwise(0)
    joined = joined.withColumn("times", times)

    # A row's play begins somewhere in a block; the chosen ones near the end may begin a bit
    # beyond the last.
    def block(play: Column) -> Column:
        begins = play * F.col("source_size") + F.col("start")
        return F.least(F.floor(begins / F.col("block_words")), F.col("quota") - 1).cast("long")

    dealt = _small(blocks)
    for play in range(LIMIT):
        here = F.when(F.col("times") > play, block(F.lit(play)))
        found = dealt.withColumnsRenamed({"shard": f"_shard{play}", "block": f"_block{play}"})
        joined = joined.withColumn(f"_block{play}", here)
        joined = joined.join(found, [*SOURCE, f"_block{play}"], "left")
    draws = F.array_compact(F.array(*[F.col(f"_shard{play}") for play in range(LIMIT)]))
    name = F.when(~F.col("_unnamed"), F.col("_source"))
    done = joined.select(
        "key",
        name.alias("source"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("times")).alias("taken"),
        draws.alias("draws"),
        "turn",
    )
    return Mix(done, sources.select(name.alias("source"), "source_size", "weight", "target"))


def mixed_rows(df: DataFrame, source: str, size: Column, seed: int = 0) -> DataFrame:
    """The rows themselves, each as often as the mix plays it, with ``mix_shard`` and
    ``mix_turn``; sort by these when writing. Further columns pass through."""
    outer = df
    # The size is worked out on the input's own names, then all of them are put aside.
    df, (source,), _ = neutral(df.select("*", size.alias("__size")), source)
    columns = [F.col(name) for name in df.columns[:-1]]
    keyed = df.withColumn("_row", F.xxhash64(*columns, *[column.isNull() for column in columns]))
    plan = mix(keyed, F.col("_row"), F.col(source), F.col(df.columns[-1]), seed).rows
    # Equal rows are interchangeable: their draws go to one of them.
    plan = plan.filter("size(draws) > 0").groupBy(F.col("key").alias("_row")).agg(
        F.flatten(F.collect_list("draws")).alias("_draws"), F.min("turn").alias("_turn")
    )
    once = keyed.groupBy("_row").agg(
        *[F.first(column).alias(f"_v{place}") for place, column in enumerate(columns)]
    )
    played = once.join(plan, "_row").withColumn("mix_shard", F.explode("_draws"))
    return played.select(
        *[F.col(f"_v{place}").alias(name) for place, name in enumerate(outer.columns)],
        "mix_shard",
        F.xxhash64("_turn", "mix_shard").alias("mix_turn"),
    )
