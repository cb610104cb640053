"""The steps of near-duplicate search: as many files and tasks as their rows need."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rowsieve.llm import common, neighbours
from rowsieve.llm.minhash import near_duplicates


def near_copies(spark, groups=6, copies=12):
    rng = random.Random(21)
    rows = []
    for group in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for copy in range(copies):
            own = list(base)
            own[rng.randrange(120)] = f"g{group}c{copy}"
            rows.append((len(rows), " ".join(own)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture
def many_partitions(spark):
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    had = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in had.items():
        spark.conf.set(name, value)


def test_few_rows_are_written_as_few_files(spark, monkeypatch, many_partitions):
    files = []

    def written(*args):
        found = common.stored(*args)
        files.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(neighbours, "stored", written)
    found = near_duplicates(near_copies(spark), "doc_id").collect()
    assert {(row["class"], row["size"]) for row in found} == {(12 * group, 12) for group in range(6)}
    # Shuffles have 32 partitions; no step has more than some hundred rows.
    assert len(files) > 10 and max(files) <= 2


def test_as_many_files_as_the_bound_needs(spark):
    rows = spark.range(1000).repartition(20)
    assert len(common.stored(rows, 1000, 300).inputFiles()) == 4
    assert len(common.stored(rows).inputFiles()) == 20
    assert common.stored(rows, 1000, 300).agg(F.sum("id")).first()[0] == 499500


@pytest.mark.parametrize("broadcast_rows", [0, neighbours.BROADCAST_ROWS])
def test_components_against_union_find(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(neighbours, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(3)
    # A chain, a star with a high centre, and random ties; some of them twice.
    edges = [(at, at + 1) for at in range(100, 140)] + [(999, at) for at in range(200, 230)]
    edges += [(rng.randrange(300, 400), rng.randrange(400, 500)) for _ in range(60)] + [(999, 205)]
    root = {node: node for edge in edges for node in edge}

    def top(node):
        while root[node] != node:
            node = root[node]
        return node

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    found = neighbours.components(spark.createDataFrame(edges, "a long, b long").repartition(5))
    assert {row.node: row.component for row in found.collect()} == {node: top(node) for node in root}
    assert found.count() == len(root)


def test_classes_are_the_same_without_broadcasts(spark, monkeypatch):
    df = near_copies(spark, 4, 8)
    expected = sorted(near_duplicates(df, "doc_id").drop("component").collect())
    monkeypatch.setattr(neighbours, "BROADCAST_ROWS", 0)
    assert sorted(near_duplicates(df, "doc_id").drop("component").collect()) == expected
