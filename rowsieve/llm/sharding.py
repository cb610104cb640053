"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into ``RING_SLOTS`` slots. Every shard owns ``virtual_nodes`` points on it,
and a key belongs to the first point at or after its slot. A shard admits only its quota;
keys that find it full continue clockwise to the next point. Admission goes by rounds: all
keys that have moved equally far ask together, in ring order, so the result depends on the
rows alone and not on their arrival.

What is decided on the driver is how many keys of each arc go where: one count per point,
``shards * virtual_nodes`` of them whatever the table's size. Rows are placed by their rank
in the arc, which joins with at most one interval more than there are points and shards.

Defined cases: NULL keys are a key of their own; rows equal in every carried column are
interchangeable and merge before the shuffle; a key with many different rows is spread over
``SALTS`` sorts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsieve.llm.common import each_copy, placed, stored, with_copies

RING_BITS = 16
RING_SLOTS = 1 << RING_BITS
VIRTUAL_NODES = 64
SALTS = 16


def ring_points(spark: SparkSession, shards: int, virtual_nodes: int, seed: int) -> DataFrame:
    """The points in ring order: arc (0, 1, ...), slot and shard."""
    point = F.xxhash64(F.lit(seed), F.col("shard"), F.col("id"))
    points = spark.range(shards * virtual_nodes).withColumn(
        "shard", F.expr(f"cast(id div {virtual_nodes} as int)")
    )
    points = points.select("shard", F.shiftrightunsigned(point, 64 - RING_BITS).alias("slot"), "id")
    arc = F.row_number().over(Window.orderBy("slot", F.xxhash64("id", F.lit(seed)))) - 1
    return points.select(arc.alias("arc"), "slot", "shard")


def slot_arcs(spark: SparkSession, points: DataFrame) -> DataFrame:
    """Each slot's arc: that of the first point at or after it, or of the ring's first point."""
    firsts = points.groupBy("slot").agg(F.min("arc").alias("arc"))
    # Backwards, as a frame that grows keeps its state from row to row.
    ahead = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    slots = spark.range(RING_SLOTS).withColumnRenamed("id", "slot").join(firsts, "slot", "left")
    return slots.select(
        "slot", F.coalesce(F.last("arc", ignorenulls=True).over(ahead), F.lit(0)).alias("arc")
    )


def admit(
    owners: Sequence[int], counts: Sequence[int], shards: int, slack: float
) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first place) of every interval of keys.

    Quotas are the mean, of which ``total % shards`` shards hold one more, times 1 + slack.
    """
    total = sum(counts)
    quota = [int((total // shards + (s < total % shards)) * (1 + slack)) for s in range(shards)]
    taken = [0] * shards
    waiting = [(arc, 0, n, arc) for arc, n in enumerate(counts) if n]
    intervals = []
    while waiting:
        moved = []
        for arc, start, end, at in waiting:
            shard = owners[at]
            n = min(end - start, quota[shard] - taken[shard])
            if n:
                intervals.append((arc, start, start + n, shard, taken[shard]))
                taken[shard] += n
            if start + n < end:
                moved.append((arc, start + n, end, (at + 1) % len(owners)))
        waiting = moved
    return intervals


def ring_shards(
    df: DataFrame,
    key: str,
    shards: int,
    carry: Sequence[str] = (),
    virtual_nodes: int = VIRTUAL_NODES,
    slack: float = 0.0,
    seed: int = 0,
) -> DataFrame:
    """The key and carried columns of every row, with its ``shard`` and ``slot`` therein.

    Slots count from 0 without gaps. With ``slack`` 0 shards differ by one row at most; with
    more, fewer keys move when the number of shards changes. Carry narrow columns that tell
    rows apart; they must be comparable.
    """
    spark, columns = df.sparkSession, list(dict.fromkeys([key, *carry]))
    names = {column: f"_c{place}" for place, column in enumerate(columns)}
    rows = df.select(*[F.col(f"`{column}`").alias(name) for column, name in names.items()])
    rows = with_copies(rows, list(names.values()))
    position = F.xxhash64(F.lit(seed), F.col(names[key]), F.col(names[key]).isNull())
    points = ring_points(spark, shards, virtual_nodes, seed)
    # Ring, slots and points are of fixed size, whatever the table holds.
    rows = rows.withColumn("slot", F.shiftrightunsigned(position, 64 - RING_BITS))
    rows = rows.join(F.broadcast(slot_arcs(spark, points)), "slot")
    turn = F.xxhash64(*names.values(), F.lit(seed + 1))
    bucket = F.col("slot") * SALTS + F.pmod(turn, F.lit(SALTS))
    rows = stored(rows.select("*", turn.alias("turn"), bucket.alias("bucket")))

    owners = [row["shard"] for row in points.orderBy("arc").select("shard").collect()]
    counts = [0] * len(owners)
    for arc, n in rows.groupBy("arc").agg(F.sum("copies")).collect():
        counts[arc] = n
    intervals = admit(owners, counts, shards, slack)
    if not intervals:
        return df.select(*columns).limit(0).select("*", *_nothing())

    ranked = placed(rows, ["arc"], "bucket", ["turn", *names.values()], F.lit(1))
    ranked = each_copy(ranked).withColumn("rank", F.col("before") + F.col("copy"))
    values = ",".join(str(interval) for interval in intervals)
    admitted = spark.sql(
        f"select * from values {values} as t(_arc, first_rank, end_rank, shard, first_place)"
    )
    inside = (
        (F.col("arc") == F.col("_arc"))
        & (F.col("rank") >= F.col("first_rank"))
        & (F.col("rank") < F.col("end_rank"))
    )
    return ranked.join(F.broadcast(admitted), inside).select(
        *[F.col(name).alias(column) for column, name in names.items()],
        F.col("shard").cast("int").alias("shard"),
        (F.col("first_place") + F.col("rank") - F.col("first_rank")).cast("long").alias("slot"),
    )


def _nothing():
    return [F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot")]
