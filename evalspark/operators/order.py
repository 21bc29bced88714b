"""Order over whole tables without one task: rows are cut at quantiles, numbered within blocks, and block counts are added.

Offsets are prefix sums in two levels.  Inside a group they run over its blocks, a few per shuffle partition whatever the group holds; a group
of a third of all rows is therefore numbered by many tasks.  Only :func:`number_rows`, which numbers across groups, also adds up the
groups' totals, one row per group; it is for tables with a few groups, such as data sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks_of(df: DataFrame, order: str, count: int | None = None) -> Column:
    """Number of the block of a row: how many of ``count - 1`` quantiles of ``order`` are at or below it.

    One pass over the column finds the quantiles, a few per shuffle partition by default.  Equal values share a block; nulls are in the first.
    """
    count = count or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if count < 2:
        return F.lit(0)
    found = df.agg(F.percentile_approx(order, [i / count for i in range(1, count)], 100 * count).alias("b")).first()["b"]
    return block_in(F.col(order), sorted(set(found or [])))


def block_in(value: Column, bounds: Sequence) -> Column:
    """How many of the rising ``bounds`` are at or below ``value``: a binary search in one constant array."""
    if not bounds:
        return F.lit(0)
    array = F.lit(list(bounds))
    steps = F.lit([1 << i for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) <= value, at + step).otherwise(at))


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by ``keys`` in which null equals null; the keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    condition = same[0]
    for more in same[1:]:
        condition &= more
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def number_within(
    df: DataFrame, groups: Sequence[str], order: str, name: str, ties: Sequence[str] = (), blocks: int | None = None, total: str | None = None,
) -> DataFrame:
    """Dense 0-based row numbers inside each group, by ``order`` and then ``ties``, which together must be unique within a group for
    the same numbers each time.  ``total``: name of a column for the number of rows of the group."""
    tagged = df.withColumn("_block", blocks_of(df, order, blocks))
    counts = tagged.groupBy(*groups, "_block").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*groups)
    before = F.sum("_n").over(group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*groups, "_block", F.coalesce(before, F.lit(0)).alias("_offset"), *([F.sum("_n").over(group).alias(total)] if total else []))
    inside = Window.partitionBy(*groups, "_block").orderBy(order, *ties)
    numbered = tagged.withColumn("_rank", F.row_number().over(inside) - 1)
    joined = join_groups(numbered, offsets, [*groups, "_block"])
    return joined.withColumn(name, F.col("_offset") + F.col("_rank")).drop("_block", "_rank", "_offset")


def number_rows(df: DataFrame, groups: Sequence[str], order: str, name: str, blocks: int | None = None) -> DataFrame:
    """Dense 0-based row numbers of the whole table by (groups, order); ``order`` must be unique within a group for the same numbers each time."""
    numbered = number_within(df, groups, order, "_within", blocks=blocks)
    totals = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select(*groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return join_groups(numbered, firsts, groups).withColumn(name, F.col("_first") + F.col("_within")).drop("_first", "_within")
