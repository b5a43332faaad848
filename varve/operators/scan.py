"""Ordered scans: ranges, prefixes, seeks, neighbours, and merges of runs. Orders are by key, then newest first."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordering import last_before, neighbours, running
from .visible import live

INTERNAL = (F.asc, "key"), (F.desc, "seq"), (F.desc, "vtype")


def internal_order(df: DataFrame) -> DataFrame:
    """All versions and deletions, by key, newest first."""
    return df.orderBy(*(f(c) for f, c in INTERNAL))


def internal_scan(mut: DataFrame) -> DataFrame:
    """All versions and deletions with their place in the internal order, from 1."""
    placed = running(mut, ["key", -F.col("seq"), -F.col("vtype")], F.lit(1), "before")
    return placed.select("key", "seq", "vtype", "value", (F.col("before") + 1).cast("long").alias("place"))


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """The internal scan over sorted runs: a union and one sort."""
    return internal_scan(reduce(DataFrame.unionByName, runs))


def visible_scan(mut: DataFrame, snapshot: int | None = None, descending: bool = False) -> DataFrame:
    return live(mut, snapshot).orderBy(F.desc("key") if descending else F.asc("key"))


def between(low: object, high: object, order: Callable[[Column], Column] | None = None) -> Column:
    """low <= key < high under an order of keys (a column that sorts like them); either may be None."""
    by = order or (lambda c: c)
    cut: Column = F.lit(True)
    if low is not None:
        cut = cut & (by(F.col("key")) >= by(F.lit(low)))
    if high is not None:
        cut = cut & (by(F.col("key")) < by(F.lit(high)))
    return cut


def range_scan(mut: DataFrame, low: object, high: object, snapshot: int | None = None) -> DataFrame:
    """low <= key < high; either may be None. The filter comes before the aggregate, so it reaches the scan."""
    return visible_scan(mut.where(between(low, high)), snapshot)


def after_prefix(prefix: str) -> str | None:
    """The least string above all that begin with the prefix."""
    for i in range(len(prefix) - 1, -1, -1):
        if ord(prefix[i]) < 0x10FFFF:
            return prefix[:i] + chr(ord(prefix[i]) + 1)
    return None


def prefix_scan(mut: DataFrame, prefix: str, snapshot: int | None = None) -> DataFrame:
    return range_scan(mut, prefix, after_prefix(prefix), snapshot)


def first(mut: DataFrame, snapshot: int | None = None) -> DataFrame:
    return visible_scan(mut, snapshot).limit(1)


def last(mut: DataFrame, snapshot: int | None = None) -> DataFrame:
    return visible_scan(mut, snapshot, descending=True).limit(1)


def ranked(df: DataFrame, key: str, name: str, descending: bool = False) -> DataFrame:
    """df, of different keys, with their rank in key order."""
    up = running(df, [key], F.lit(1), "__before")
    if not descending:
        return up.select(*df.columns, (F.col("__before") + 1).cast("long").alias(name))
    n = df.agg(F.count("*").alias("__n"))
    return up.crossJoin(F.broadcast(n)).select(*df.columns, (F.col("__n") - F.col("__before")).cast("long").alias(name))  # a count is one row


def seek(keys: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (target) with the first key at or after each."""
    return _nearest(keys, targets, True)


def seek_before(keys: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (target) with the last key before each."""
    return _nearest(keys, targets, False)


def _nearest(keys: DataFrame, targets: DataFrame, forward: bool) -> DataFrame:
    """Targets and keys in one order, a target before an equal key: the next or the last key."""
    both = keys.select("key", F.lit(True).alias("is_key")).unionByName(targets.select(F.col("target").alias("key"), F.lit(False).alias("is_key")))
    found = last_before(both, ["key", "is_key"], F.when(F.col("is_key"), F.col("key")), "found", forward=forward)
    return found.where(~F.col("is_key")).select(F.col("key").alias("target"), F.col("found").alias("key"))


def with_neighbours(mut: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The visible keys with the ones before and after."""
    return neighbours(live(mut, snapshot), "key")
