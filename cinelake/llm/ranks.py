"""Ranks and running sums within groups of any size: no task sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over the rows of the same group that come before, and group_rows, group_total of the group.

    A group of n rows is dealt to about sqrt(n) buckets by a hash of `order` (which should tell rows apart). Rows are in order within
    their bucket and buckets follow each other, so the order is the same at every run but not that of `order` over the whole group.
    Null is a group like any other.
    """
    key = [F.col(c) for c in group]
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("group_rows"), F.sum(value).alias("group_total"))
    left, right = df.alias("l"), sizes.alias("r")
    same = None
    for c in group:
        part = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        same = part if same is None else same & part
    dealt = left.join(right, same).select("l.*", "r.group_rows", "r.group_total")
    dealt = dealt.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.ceil(F.sqrt("group_rows"))))
    buckets = dealt.groupBy(*key, "__bucket").agg(F.sum(value).alias("__part"))
    before = Window.partitionBy(*key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("__before", F.coalesce(F.sum("__part").over(before), F.lit(0)))
    same = F.col("l.__bucket") == F.col("r.__bucket")
    for c in group:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    placed = dealt.alias("l").join(buckets.alias("r"), same).select("l.*", "r.__before")
    inside = Window.partitionBy(*key, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total: Column = F.col("__before") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return placed.withColumn(name, total).drop("__bucket", "__before")
