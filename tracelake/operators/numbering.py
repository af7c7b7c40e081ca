"""Numbers and ranks of rows in order, without one task for a group.

Rows are dealt by ranges of group and order, numbered inside their range, and moved up by the counts of the
ranges before: only counts, a row for each group and range, meet in one place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.sources.shared import cut

_INDEX_BITS = 33


def _ranged(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """The rows in ranges of group and order, sorted inside, with ``__at`` (their place) and ``__part`` (the range), written down."""
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"__o{i}") for i, c in enumerate(order)]
    sort = [*by, *[f"__o{i}" for i in range(len(keys))]]
    ranged = df.select("*", *keys).repartitionByRange(*sort).sortWithinPartitions(*sort)
    ranged = cut(ranged.withColumn("__at", F.monotonically_increasing_id()).drop(*sort[len(by) :]))
    return ranged.withColumn("__part", F.shiftright("__at", _INDEX_BITS))


def _met(rows: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """Rows beside what is known of their range and group; nulls are a group."""
    same = ["__part", *by]
    named = few.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(same)], *[c for c in few.columns if c not in same])
    met = rows["__part"] == named["__k0"]
    for i, c in enumerate(by, 1):
        met = met & rows[c].eqNullSafe(named[f"__k{i}"])
    return rows.join(named, met)


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str = "number", step: str | None = None) -> DataFrame:
    """The rows with ``name``: 1, 2, ... within equal ``by``, in ``order``. Nulls come first and are a group of their own.

    Rows that the order doesn't tell apart are numbered in any way, and stand in one range. ``step`` names a
    column of whole numbers to add up instead of ones: the number is then the sum up to and with the row.
    """
    inside, same = _ranged(df, by, order), ["__part", *by]
    if step is None:
        counts = inside.groupBy(*same).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
        value = F.col("__at") - F.col("__first") + 1
    else:
        counts = inside.groupBy(*same).agg(F.sum(step).alias("__n"))
        inside = inside.withColumn("__sum", F.sum(step).over(Window.partitionBy(*same).orderBy("__at")))
        value = F.col("__sum")
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return _met(inside, counts, by).select(*df.columns, (F.col("__before") + value).alias(name))


def running(df: DataFrame, by: list[str], order: list[str | Column], fold: Callable[[Column], Column], value: str, name: str) -> DataFrame:
    """The rows with ``name``: the fold (max, min, sum) of ``value`` over the rows before, within equal ``by`` and in ``order``; null for the first."""
    inside, same = _ranged(df, by, order), ["__part", *by]
    totals = inside.groupBy(*same).agg(fold(F.col(value)).alias("__total"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = totals.withColumn("__before", fold(F.col("__total")).over(before)).drop("__total")
    own = Window.partitionBy(*same).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("__own", fold(F.col(value)).over(own))
    both = F.array(F.col("__own"), F.col("__before"))
    either = F.coalesce(F.col("__own"), F.col("__before"))
    joined = _met(inside, totals, by)
    folds = {F.max: F.array_max(both), F.min: F.array_min(both), F.sum: F.when(F.col("__own").isNotNull() & F.col("__before").isNotNull(), F.col("__own") + F.col("__before")).otherwise(either)}
    return joined.select(*df.columns, folds[fold].alias(name))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """The rows with ``name``: the mean number, within equal ``by``, of the rows that share their ``value``."""
    sizes = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__size"))
    ends = numbered(sizes, by, [value], "__end", "__size").withColumn("__rank", F.col("__end") - (F.col("__size") - 1) / 2.0)
    named = ends.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate([*by, value])], "__rank")
    met = df[value].eqNullSafe(named[f"__r{len(by)}"])
    for i, c in enumerate(by):
        met = met & df[c].eqNullSafe(named[f"__r{i}"])
    return df.join(named, met).select(*df.columns, F.col("__rank").alias(name))
