"""Exact top-k by inner product: columnar branch and bound.

Vectors are held in blocks of ``BLOCK`` rows, stored dimension by dimension. Queries come in
blocks too, and every block of rows meets every block of queries once; both are shipped as
packed bytes, never as pairs of rows. Within a pair of blocks the scores of one query are
summed up over ``STEP`` dimensions at a time. What the remaining dimensions can still add is
at most the product of the two remaining lengths, so that rows which cannot reach the query's
k-th lower bound are dropped and the survivors moved together before the next dimensions.
Bounds only drop rows that cannot be among the k best, ties included.

Components are ``floor(scale * x)``, x as double; scores are integers, exact as long as sums
stay under 2**63. Defined cases: vectors that are NULL, or hold a NULL or non-finite
component, take no part; vectors meet those of their own length only; equal vectors and equal
scores go by smaller id; with fewer than k others all are returned; repeated ids are rows of
their own, and a query leaves out all rows of its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsieve.llm.common import stored

BLOCK = 8192
QUERY_BLOCK = 256
# Copies of each block of queries, so that the blocks of rows that meet it are many tasks' work.
SPREAD = 16
STEP = 8
# Sums of doubles are exact below this; beyond it integers are used.
EXACT = float(2**53)


def _whole(vector: Column, scale: float) -> Column:
    usable = vector.isNotNull() & F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")),
    )
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows: dim, ids, values (column by column)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["v"].map(len)
            for dim, own in batch.groupby(lengths):
                for at in range(0, len(own), size):
                    part = own.iloc[at : at + size]
                    values = np.array(part["v"].tolist(), dtype=np.int64).reshape(len(part), dim)
                    yield pd.DataFrame(
                        {
                            "dim": [dim],
                            "ids": [part["id"].to_numpy(np.int64).tobytes()],
                            "values": [np.ascontiguousarray(values.T).tobytes()],
                        }
                    )

    return rows.mapInPandas(pack, "dim int, ids binary, values binary")


def best_of_block(
    query: np.ndarray, query_id: int, ids: np.ndarray, columns: np.ndarray, rest: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the block's rows that may be among the query's k best in it.

    ``columns`` has one row per dimension; ``rest`` the length of what follows each step.
    """
    alive = np.flatnonzero(ids != query_id)
    scores = np.zeros(len(alive), dtype=columns.dtype)
    for step, at in enumerate(range(0, len(query), STEP)):
        part = columns[at : at + STEP]
        part = part[:, alive] if len(alive) < len(ids) else part
        scores = scores + query[at : at + STEP] @ part
        left = query[at + STEP :].astype(np.float64)
        if len(alive) > k:
            # A little more than the product, against rounding.
            reach = np.sqrt(left @ left) * rest[step + 1][alive] * (1 + 1e-9) + 1e-6
            low = scores - reach
            bound = np.partition(low, len(low) - k)[len(low) - k]
            keep = scores + reach >= bound
            if not keep.all():
                alive, scores = alive[keep], scores[keep]
    if len(alive) > k:
        order = np.lexsort((ids[alive], -scores))[:k]
        alive, scores = alive[order], scores[order]
    return ids[alive], scores


def top_k(
    df: DataFrame, key: str, vector: str, is_query: Column, k: int, scale: float = 1024.0
) -> DataFrame:
    """For each query row the k other rows of highest inner product: query_id, rank, key, score."""
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        _whole(F.col(f"`{vector}`"), scale).alias("v"),
        is_query.alias("asks"),
    ).filter("v is not null and id is not null")
    queries = stored(
        _packed(rows.filter("asks").select("id", "v"), QUERY_BLOCK).withColumn(
            "block", F.monotonically_increasing_id()
        )
    )
    # One row per vector length, with the numbers of its blocks of queries.
    numbers = queries.groupBy("dim").agg(F.collect_list("block").alias("blocks"))
    blocks = _packed(rows.select("id", "v"), BLOCK).withColumn(
        "part", (F.monotonically_increasing_id() % SPREAD + F.spark_partition_id()) % SPREAD
    )
    # Each block of rows once for every block of queries of its length.
    meeting = blocks.join(F.broadcast(numbers), "dim").select(
        "dim", "ids", "values", "part", F.explode("blocks").alias("block")
    )
    asked = queries.select(
        "block",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("part"),
        F.col("ids").alias("asking"),
        F.col("values").alias("asked"),
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, ids, values, asking, asked in zip(
                *[batch[name] for name in ("dim", "ids", "values", "asking", "asked")], strict=True
            ):
                found = _best(dim, ids, values, asking, asked, k)
                yield pd.DataFrame(found, columns=["query_id", "id", "score"])

    found = (
        meeting.join(asked, ["block", "part"])
        .select("dim", "ids", "values", "asking", "asked")
        .mapInPandas(search, "query_id long, id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(key), "score")
    )


def _best(dim: int, ids: bytes, values: bytes, asking: bytes, asked: bytes, k: int) -> dict:
    row_ids, query_ids = np.frombuffer(ids, np.int64), np.frombuffer(asking, np.int64)
    columns = np.frombuffer(values, np.int64).reshape(dim, len(row_ids))
    queries = np.frombuffer(asked, np.int64).reshape(dim, len(query_ids))
    largest = [float(np.abs(x).max(initial=0)) for x in (columns, queries)]
    if largest[0] * largest[1] * max(dim, 1) < EXACT:
        columns, queries = columns.astype(np.float64), queries.astype(np.float64)
    mass = np.square(columns.astype(np.float64))
    total = mass.sum(axis=0)
    # Heavy dimensions first, so that little is left early.
    order = np.argsort(-mass.sum(axis=1), kind="stable")
    columns, queries, mass = columns[order], queries[order], mass[order]
    rest = [total]
    for at in range(0, dim, STEP):
        rest.append(np.maximum(rest[-1] - mass[at : at + STEP].sum(axis=0), 0))
    rest = np.sqrt(np.array(rest)) + 1e-6 * np.sqrt(total)
    out: dict = {"query_id": [], "id": [], "score": []}
    for at, query_id in enumerate(query_ids):
        found, scores = best_of_block(
            np.ascontiguousarray(queries[:, at]), query_id, row_ids, columns, rest, k
        )
        out["query_id"].append(np.full(len(found), query_id))
        out["id"].append(found)
        out["score"].append(scores.astype(np.int64))
    return {name: np.concatenate(parts) for name, parts in out.items()}
