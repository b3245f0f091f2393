"""Exact order statistics of value-count multisets by cumulative counts, without a group in one task.

A multiset is a table (group..., value, n) with one row per group and value. Ranks are prefix sums of n. They are taken
in two steps: the table is cut into blocks by range of (group, value), totals of blocks are prefix-summed per group
(one row per block), and ranks inside a block are local to it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace import runtime


def same_keys(left: str, right: str, keys: Sequence[str]):
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def cumulative(multiset: DataFrame, group: Sequence[str], value: str = "value", n: str = "n") -> DataFrame:
    """Adds `upto`, the number of items of the group with a value of at most this row's. Rows with null value or n of 0
    or less are no items and give no row."""
    group = list(group)
    items = multiset.where(F.col(value).isNotNull() & (F.col(n) > 0)).select(*group, value, n)
    blocks = runtime.shuffle_partitions(multiset.sparkSession)
    ranged = items.repartitionByRange(blocks, *group, value).withColumn("_block", F.spark_partition_id())
    ranged = runtime.persist_table(ranged, "multiset-blocks")
    totals = ranged.groupBy(*group, "_block").agg(F.sum(n).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*group, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum(n).over(within))
    on = same_keys("l", "o", [*group, "_block"])
    return local.alias("l").join(offsets.alias("o"), on).select(*[f"l.{c}" for c in (*group, value, n)], (F.col("l._local") + F.col("o._offset")).alias("upto"))


def order_statistics(multiset: DataFrame, group: Sequence[str], value: str = "value", n: str = "n") -> DataFrame:
    """Per group: items, distincts, lowest, highest, total, and the exact median (mean of the middle two)."""
    group = list(group)
    ranks = cumulative(multiset, group, value, n)
    sums = multiset.where(F.col(value).isNotNull() & (F.col(n) > 0)).groupBy(*group).agg(
        F.sum(n).alias("items"), F.count(F.lit(1)).alias("distincts"), F.min(value).alias("lowest"), F.max(value).alias("highest"),
        F.sum(F.col(value) * F.col(n)).alias("total"),
    )
    lower, upper = F.floor((F.col("items") + 1) / 2), F.floor((F.col("items") + 2) / 2)
    holds = lambda r: (F.col("upto") >= r) & (F.col("upto") - F.col(f"r.{n}") < r)
    both = ranks.alias("r").join(sums.alias("s"), same_keys("r", "s", group)).where(holds(lower) | holds(upper))
    middle = both.groupBy(*[F.col(f"s.{g}") for g in group], "items", "distincts", "lowest", "highest", "total").agg(
        ((F.min(F.col(f"r.{value}")) + F.max(F.col(f"r.{value}"))) / F.lit(2.0)).alias("median")
    )
    return middle.select(*group, "items", "distincts", "lowest", "highest", "total", "median")
