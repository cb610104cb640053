"""From colliding signatures to classes of similar texts.

Texts that are equal are one node from the start. Nodes whose signatures agree in a band share
a bucket. Similar ones are found by rounds: every bucket compares all its nodes with its most
connected one, pairs above the limit join their classes, and what a bucket has seen compared
is done. The next round takes the buckets that still hold more than one class, with the next
node in the centre, and twice as many centres as the round before. So a large group of copies
is settled by as many comparisons as it has texts, never by all its pairs.

Buckets that are still open after ``COARSE`` centres hold texts that share much and are not
alike. Their nodes get finer buckets instead, one for each shingle of a prefix: shingles are
put in one order, those of few nodes first, and two sets of similarity ``least`` always have
one in common among the first of both, up to a share of ``1 - least`` of the larger set's
weight and ``(1 - least) / (1 + least)`` of the smaller one's. So only nodes with the shingle
in the shorter prefix need be a centre, and what a template or boilerplate has in common
makes no pairs, unless it is nearly all of a text. There every node also has ``PARITY_LONGS``
longs with the parity of its shingles in each bit: as many shingles as two nodes have bits
that differ are in only one of the two, and if these alone weigh too much the pair is not
made. All that is exact: no pair that shares a bucket and is similar is left in two classes.
Within one finer bucket the parities of centres and partners are still held side by side.

Texts travel only for nodes with a neighbour. A comparison's centre is sent once for every
``PER_TASK`` of its partners, so that one centre with many partners is many tasks' work.

Late rounds are many and small: what a count proves few is broadcast, and each step writes
as many files as its rows need, not one for every partition of a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsieve.llm.common import stored
from rowsieve.llm.shingles import chunks

PER_TASK = 256
# Buckets open after so many centres are replaced by finer ones.
COARSE = 3
# Shingles are ordered by how many nodes have one of the same slot, which is one number a slot.
SLOT_BITS = 17
PARITY_LONGS = 8
# More centres each round among finer buckets, whose pairs are few.
FINE_GROWTH = 4
# Sums of weights are rounded; a prefix is rather too long than too short.
SLACK = 1e-5
# Up to so many rows of two longs are broadcast; more are joined by shuffling.
BROADCAST_ROWS = 500_000
# Whole texts that a task writes at least.
TEXTS_PER_FILE = 2048

Shingled = Callable[[pa.Array], list]
Alike = Callable[[object, object], float]


def small(df: DataFrame, most: int | None = None, longs: int = 2) -> DataFrame:
    """``df``, marked for broadcast if it is small by its number of rows, or by ``most``."""
    rows = df.count() if most is None else most
    return F.broadcast(df) if rows * longs <= 2 * BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b): the smallest node it is tied to.

    Labels spread along edges and then jump to their label's own label, so that long chains
    take few rounds. Each round's labels are stored.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    loops = both.select("a", F.col("a").alias("b"))
    most = 2 * edges.count()
    both = stored(both.union(loops).distinct(), 2 * most)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), most)
    nodes = labels.count()
    while True:
        # A node is tied to itself as well, so it hears its own label with the others.
        heard = (
            both.join(small(labels, nodes), both.b == labels.node)
            .groupBy("a")
            .agg(
                F.min("component").alias("next"),
                F.max(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("was"),
            )
        )
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        after = heard.join(small(jump, nodes), "next", "left").select(
            F.col("a").alias("node"), "was", F.least("next", "beyond").alias("component")
        )
        after = stored(after, nodes)
        labels = after.select("node", "component")
        if not after.filter("was <> component").limit(1).count():
            return labels


def compared(
    pairs: DataFrame, texts: DataFrame, shingled: Shingled, alike: Alike, least: float
) -> DataFrame:
    """The pairs (centre, node) whose texts have a similarity of ``least`` or more, stored."""
    many = pairs.count()
    sizes = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / PER_TASK).cast("long")
    sizes = stored(sizes.select("centre", parts.alias("parts")), many)
    partners = pairs.join(small(sizes), "centre").select(
        "centre", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node"
    )
    centres = sizes.select(
        "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    ).withColumn("node", F.col("centre"))
    # No more centres than pairs.
    asked = texts.join(small(partners.unionByName(centres), 2 * many), "node")
    # Few pairs start few Python tasks; a part is never cut.
    dealt = asked.repartition("centre", "part").coalesce(max(1, -(-many // PER_TASK)))
    dealt = dealt.sortWithinPartitions("centre", "part", F.col("node") != F.col("centre"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in chunks(batches, 2):
            found: dict[str, list] = {"a": [], "b": [], "similarity": []}
            at, node, sets = batch.column(0), batch.column(1), shingled(batch.column(2))
            for one, row in zip(sets, zip(at.to_pylist(), node.to_pylist(), strict=True), strict=True):
                if row[0] == row[1]:
                    centre, own = row[0], one
                    continue
                assert centre == row[0], "a centre's text is missing"
                value = alike(own, one)
                if value >= least:
                    for name, part in zip(found, (*row, value), strict=True):
                        found[name].append(part)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found["a"], pa.int64()),
                    pa.array(found["b"], pa.int64()),
                    pa.array(found["similarity"], pa.float64()),
                ],
                names=list(found),
            )

    found = dealt.select("centre", "node", "text").mapInArrow(
        compare, "a long, b long, similarity double"
    )
    return stored(found)


def crowds(texts: DataFrame, shingled: Shingled) -> np.ndarray:
    """In how many texts a shingle of each slot stands: 2 ** ``SLOT_BITS`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in chunks(batches, 0):
            for numbers, _ in shingled(batch.column(0)):
                total += np.bincount(slots(numbers), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    counted = texts.select("text").mapInArrow(count, "slot long, n long")
    found = counted.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(1 << SLOT_BITS, np.int64)
    total[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return total


def slots(numbers: np.ndarray) -> np.ndarray:
    return (numbers >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def prefix(
    numbers: np.ndarray, weights: np.ndarray, crowd: np.ndarray, least: float
) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set that one of similarity ``least`` may share first with it, and
    which of them it may where the other set weighs as much or more."""
    order = np.lexsort((numbers, crowd[slots(numbers)]))
    own = weights[order].astype(np.float64)
    before = (np.cumsum(own) - own) / own.sum()
    own_order = numbers[order]
    taken = before <= 1 - least + SLACK
    return own_order[taken], before[taken] <= (1 - least) / (1 + least) + SLACK


def parities(numbers: np.ndarray) -> np.ndarray:
    """``PARITY_LONGS`` longs: each bit is whether an odd number of shingles falls on it."""
    at = numbers & np.uint64(64 * PARITY_LONGS - 1)
    odd = np.bincount(at.astype(np.int64), minlength=64 * PARITY_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SKETCH = [f"odd_{k}" for k in range(PARITY_LONGS)] + ["weight", "lightest"]


def may_be_alike(least: float) -> Column:
    """False for pairs that are less alike than ``least`` by their sketches alone."""
    odd = [F.bit_count(F.col(name).bitwiseXOR(F.col(f"c_{name}"))) for name in SKETCH[:-2]]
    apart = sum(odd[1:], odd[0]) * F.least("lightest", "c_lightest")
    limit = (1 - least) / (1 + least) + SLACK
    return apart <= (F.col("weight") + F.col("c_weight")) * limit


def finer(texts: DataFrame, shingled: Shingled, least: float) -> DataFrame:
    """(node, bucket, may, ``SKETCH``): a bucket for each shingle of the node's prefix, of at
    least two nodes; ``may`` marks those by which it can be a centre. Any two nodes of
    similarity ``least`` share a bucket in which one of them may be."""
    spark = texts.sparkSession
    table = spark.sparkContext.broadcast(crowds(texts, shingled))
    kinds = [*["long"] * PARITY_LONGS, "double", "double"]
    schema = "node long, buckets array<long>, may array<boolean>, "
    schema += ", ".join(f"{name} {kind}" for name, kind in zip(SKETCH, kinds, strict=True))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            sets = shingled(batch.column(1))
            full = [at for at, (numbers, _) in enumerate(sets) if len(numbers)]
            sets = [sets[at] for at in full]
            parts = [prefix(*one, table.value, least) for one in sets]
            odd = np.array([parities(numbers) for numbers, _ in sets]).reshape(-1, PARITY_LONGS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(full, pa.int64())),
                    pa.array([numbers.view(np.int64) for numbers, _ in parts], pa.list_(pa.int64())),
                    pa.array([may for _, may in parts], pa.list_(pa.bool_())),
                    *[pa.array(np.ascontiguousarray(column)) for column in odd.T],
                    pa.array([float(own.sum(dtype=np.float64)) for _, own in sets], pa.float64()),
                    pa.array([float(own.min()) for _, own in sets], pa.float64()),
                ],
                names=["node", "buckets", "may", *SKETCH],
            )

    found = stored(texts.select("node", "text").mapInArrow(cut, schema))
    many = _sum(found, F.size("buckets"))
    zipped = F.explode(F.arrays_zip(F.col("buckets").alias("bucket"), F.col("may").alias("may")))
    entries = found.select("node", zipped.alias("_e")).select("node", "_e.bucket", "_e.may")
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bool_or("may").alias("any"))
    shared = stored(shared.filter("n > 1 and any").select("bucket"), many)
    return entries.join(small(shared), "bucket").join(found.select("node", *SKETCH), "node")


def _sum(df: DataFrame, of: Column) -> int:
    return int(df.agg(F.coalesce(F.sum(of), F.lit(0))).first()[0])


ENTRY = ["node", "bucket", "crowd", "seen", "may", "class"]


def similar_pairs(
    entries: DataFrame, texts: DataFrame, shingled: Shingled, alike: Alike, least: float
) -> DataFrame | None:
    """Edges (a, b, similarity) that tie every class of similar nodes together.

    ``entries`` are (node, bucket), without repeats, of buckets with at least two nodes;
    ``texts`` (node, text) of the nodes in them. None if there are no entries.
    """
    many = entries.count()
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    crowd = entries.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("crowd"))
    # The centre of a group of copies meets all of them, copies meet each other less often.
    here = entries.join(crowd, "node").withColumn("seen", F.lit(False)).withColumn("may", F.lit(True))
    here = stored(here.withColumn("class", F.col("node")), many)
    edges, past, centres, sketch = None, None, 1, []
    while True:
        if centres > COARSE and not sketch:
            # Nodes keep their class and their crowd; what coarse buckets compared is past.
            open_ = here.groupBy("node").agg(F.first("crowd").alias("crowd"), F.first("class").alias("class"))
            open_ = stored(open_, many)
            if not open_.limit(1).count():
                return edges
            left = texts.join(small(open_.select("node")), "node", "left_semi")
            here = finer(left, shingled, least).join(small(open_), "node").withColumn("seen", F.lit(False))
            here = still_open(here.select(*ENTRY, *SKETCH))
            many = here.count()
            centres, sketch = 1, SKETCH
        unseen = here.filter(~F.col("seen"))
        able = unseen.filter("may")
        if centres == 1:
            ranked = able.groupBy("bucket").agg(
                F.max(F.struct("crowd", (-F.col("node")).alias("minus"), "class", *sketch)).alias("top")
            )
            middle = ranked.select(
                "bucket",
                (-F.col("top.minus")).alias("centre"),
                F.col("top.class").alias("own"),
                *[F.col(f"top.{name}").alias(f"c_{name}") for name in sketch],
            )
        else:
            by_crowd = Window.partitionBy("bucket").orderBy(F.desc("crowd"), "node")
            middle = (
                able.withColumn("place", F.row_number().over(by_crowd))
                .filter(F.col("place") <= centres)
                .select(
                    "bucket",
                    F.col("node").alias("centre"),
                    F.col("class").alias("own"),
                    *[F.col(name).alias(f"c_{name}") for name in sketch],
                )
            )
        middle = stored(middle, many)
        if not middle.limit(1).count():
            return edges
        # Earlier centres have met all, and one class has nothing to learn.
        pairs = unseen.join(small(middle, longs=len(middle.columns)), "bucket").filter("node <> centre and class <> own")
        if sketch:
            pairs = pairs.filter(may_be_alike(least))
        pairs = pairs.select("centre", "node").distinct()
        if past is not None:
            pairs = pairs.join(small(past), ["centre", "node"], "left_anti")
        # A node meets at most so many centres in each of its buckets.
        pairs = stored(pairs, many * centres)
        found = compared(pairs, texts, shingled, alike, least)
        past = pairs if past is None else past.union(pairs)
        marks = middle.select("bucket", F.col("centre").alias("node"), F.lit(True).alias("done"))
        after = here.join(small(marks), ["bucket", "node"], "left").withColumn(
            "seen", F.col("seen") | F.coalesce("done", F.lit(False))
        )
        if found.limit(1).count():
            if edges is not None:
                found = edges.unionByName(found)
                found = stored(found, found.count())
            edges = found
            after = after.drop("class").join(small(components(edges)), "node", "left")
            after = after.withColumn("class", F.coalesce("component", "node"))
        here = still_open(after.select(*ENTRY, *sketch), many)
        many = here.count()
        centres *= FINE_GROWTH if sketch else 2


def still_open(entries: DataFrame, most: int | None = None) -> DataFrame:
    """Entries of buckets with nodes of several classes, one of which is yet to be a centre;
    ``entries`` are no more than ``most``, if given."""
    entries = stored(entries, most)
    left = entries.groupBy("bucket").agg(
        F.min("class").alias("low"),
        F.max("class").alias("high"),
        F.bool_or(F.col("may") & ~F.col("seen")).alias("any"),
    )
    left = left.filter("low <> high and any").select("bucket")
    return stored(entries.join(left, "bucket", "left_semi"), entries.count())


def classes(
    signed: DataFrame,
    texts_of: Callable[[DataFrame], DataFrame],
    shingled: Shingled,
    alike: Alike,
    least: float,
) -> DataFrame:
    """Classes of similar texts: digest, ``component``, ``class`` (smallest key), ``size``,
    ``links``, ``blank``. Only ``component`` tells classes of one smallest key apart.

    ``signed`` is stored and has key, digest of the text and ``buckets``; ``texts_of`` joins
    ``first`` (a key), digest and node with the texts, as ``text``.
    """
    # Equal texts merge before the shuffle and go on as one node.
    nodes = signed.groupBy("digest").agg(
        F.min("key").alias("first"), F.first("buckets").alias("buckets"), F.count(F.lit(1)).alias("n")
    )
    rows = signed.count()
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), rows)
    many = _sum(nodes, F.greatest(F.size("buckets"), F.lit(0)))
    entries = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries = stored(entries.join(shared.select("bucket"), "bucket").select("node", "bucket"), many)
    wanted = nodes.join(entries.select("node").distinct(), "node", "left_semi")
    wanted = stored(wanted.select("first", "digest", "node"), rows)
    found = wanted.count()
    wanted = small(wanted, found)
    # A key may belong to rows of other texts as well.
    texts = texts_of(wanted).filter(F.unhex(F.md5("text")) == F.col("digest"))
    texts = stored(texts.select("node", "text").dropDuplicates(["node"]), found, TEXTS_PER_FILE)

    edges = similar_pairs(entries, texts, shingled, alike, least)
    none = F.lit(0).cast("long")
    if edges is None or not edges.limit(1).count():
        found = nodes.withColumn("component", F.col("node")).withColumn("links", none)
    else:
        ends = edges.select("a", "b").distinct()
        links = ends.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node")
        links = links.agg(F.count(F.lit(1)).alias("links"))
        found = nodes.join(components(edges), "node", "left").join(links, "node", "left")
        found = found.withColumn("component", F.coalesce("component", "node"))
        found = found.withColumn("links", F.coalesce("links", none))
    # Texts without words are alone even where they are equal.
    blank = F.size("buckets") == 0
    found = stored(found.select("digest", "component", "links", "first", "n", blank.alias("blank")), rows)
    sizes = found.groupBy("component").agg(F.min("first").alias("class"), F.sum("n").alias("size"))
    return found.join(sizes, "component").select("digest", "component", "class", "size", "links", "blank")
