"""Table checks: rules that see the whole table before they judge a row.

A table check is registered with two functions. ``stats(value, dtype, params)`` names
aggregate Columns; ``fails(value, dtype, params, stats)`` gives the Column that is TRUE
for failing rows, where ``stats`` maps each name to a Column holding that aggregate. The
aggregates cover the whole table, or each group of the columns that the rule's
``params["group_by"]`` names; a row then sees those of its own group.

How it runs:

* **Whole table.** The aggregates of all such rules are one ``agg`` over the table, one
  row that comes to the driver and goes into the checks as literals. From then on the
  rule is a row check like any other: counted in the shared aggregate of ``validate``,
  filtered by ``split`` and ``violations`` without a join.
* **By group.** Rules over the same group columns share one ``groupBy``; the table
  meets it again by a null-safe join on those columns, so that NULL keys form a group of
  their own. The groups are broadcast when their count and key bytes, counted first,
  prove them smaller than ``broadcast_bytes``; else both sides are shuffled by key, where
  the groups have one row a key and adaptive execution splits a hot key's rows.

Where an aggregate is NULL (no rows, or only NULL values) the check sees NULL, and a NULL
verdict fails the row, as for custom checks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsieve.functions.text import named
from rowsieve.rules import BUILTIN_TYPES, RuleError

Params = Mapping[str, Any]
Stats = Callable[[Column, T.DataType, Params], Mapping[str, Column]]
TableFails = Callable[[Column, T.DataType, Params, Mapping[str, Column]], Column]

BROADCAST_BYTES = 32 * 1024 * 1024


@dataclass(frozen=True)
class TableCheck:
    stats: Stats
    fails: TableFails


_TABLE: dict[str, TableCheck] = {}


def register_table_check(type_name: str, stats: Stats, fails: TableFails) -> None:
    """Add a rule type whose rows fail where ``fails(value, dtype, params, stats)`` is TRUE
    (or NULL), ``stats`` being the aggregates of ``stats(value, dtype, params)`` over the
    table or over the row's group of ``params["group_by"]``."""
    name = type_name.lower()
    if name in BUILTIN_TYPES:
        raise RuleError(f"{name!r} is a built-in rule type")
    _TABLE[name] = TableCheck(stats, fails)


def table_checks() -> dict[str, TableCheck]:
    return dict(_TABLE)


def group_columns(params: Params) -> tuple[str, ...]:
    groups = params.get("group_by") or ()
    return (groups,) if isinstance(groups, str) else tuple(groups)


@dataclass(frozen=True)
class Context:
    """Aggregates per group, to be joined by ``keys`` before the checks that name them."""

    keys: tuple[str, ...]
    groups: DataFrame


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, lengthened by underscores in front until no column of ``taken`` has it."""
    taken = set(taken)
    while name in taken:
        name = "_" + name
    return name


@dataclass(frozen=True)
class Pending:
    position: int
    value: Column
    dtype: T.DataType
    params: Params
    check: TableCheck
    keys: tuple[str, ...]
    taken: tuple[str, ...] = ()

    def stat_name(self, name: str) -> str:
        return fresh(f"__stat_{self.position}_{name}", self.taken)

    def aggregates(self) -> list[Column]:
        found = self.check.stats(self.value, self.dtype, self.params)
        return [column.alias(self.stat_name(name)) for name, column in found.items()]

    def names(self) -> list[str]:
        return list(self.check.stats(self.value, self.dtype, self.params))


def bind_stats(df: DataFrame, pending: Sequence[Pending]) -> dict[int, tuple[Column, Context | None]]:
    """The failing Column of each table check, and the context it needs joined, if any."""
    out: dict[int, tuple[Column, Context | None]] = {}
    overall = [item for item in pending if not item.keys]
    if overall:
        row = df.agg(*[column for item in overall for column in item.aggregates()]).first()
        for item in overall:
            stats = {
                name: F.lit(row[item.stat_name(name)]) for name in item.names()
            }
            fails = item.check.fails(item.value, item.dtype, item.params, stats)
            out[item.position] = (F.coalesce(fails, F.lit(True)), None)
    by_keys: dict[tuple[str, ...], list[Pending]] = {}
    for item in pending:
        if item.keys:
            by_keys.setdefault(item.keys, []).append(item)
    for keys, items in by_keys.items():
        groups = df.groupBy(*[named(key).alias(key) for key in keys]).agg(
            *[column for item in items for column in item.aggregates()]
        )
        context = Context(keys, groups)
        for item in items:
            stats = {name: F.col(item.stat_name(name)) for name in item.names()}
            fails = item.check.fails(item.value, item.dtype, item.params, stats)
            out[item.position] = (F.coalesce(fails, F.lit(True)), context)
    return out


def with_context(
    df: DataFrame, contexts: Iterable[Context | None], broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The table with the aggregates of every distinct context beside each row."""
    seen: set[int] = set()
    for context in contexts:
        if context is None or id(context) in seen:
            continue
        seen.add(id(context))
        groups = context.groups
        size = groups.agg(
            F.count(F.lit(1)).alias("n"),
            *[
                F.coalesce(F.sum(F.octet_length(named(key).cast("string"))), F.lit(0)).alias(f"k{place}")
                for place, key in enumerate(context.keys)
            ],
        ).first()
        width = size["n"] * (16 + 8 * len(groups.columns)) + sum(
            size[f"k{place}"] for place in range(len(context.keys))
        )
        sides = [fresh(f"__group_{place}", [*df.columns, *groups.columns]) for place in range(len(context.keys))]
        renamed = groups.select(
            *[named(key).alias(side) for key, side in zip(context.keys, sides)],
            *[named(name) for name in groups.columns if name not in context.keys],
        )
        if width <= broadcast_bytes:
            renamed = F.broadcast(renamed)
        on = [named(key).eqNullSafe(renamed[side]) for key, side in zip(context.keys, sides)]
        joined = df.join(renamed, reduce(and_, on))
        df = joined.select(*[df[name] for name in df.columns], *[renamed[name] for name in groups.columns if name not in context.keys])
    return df
