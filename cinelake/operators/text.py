"""Ordered text from many rows, in pages, so that no cell or task grows with the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cinelake.operators.skew import row_number_across


def paged_text(
    df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], text: str, separator: str, name: str, page_rows: int = 500
) -> DataFrame:
    """One row per (keys, page): up to `page_rows` texts joined in order. The pages of a key in turn are its whole text."""
    numbered = row_number_across(df, keys, segment, order, "__n")
    paged = numbered.withColumn("page", F.floor((F.col("__n") - 1) / page_rows).cast("bigint"))
    # Within a page the place is unique, so a sorted list of at most `page_rows` entries suffices.
    items = F.array_sort(F.collect_list(F.struct("__n", F.col(text).alias("t"))))
    return paged.groupBy(*keys, "page").agg(items.alias("__items")).select(
        *keys, "page", F.array_join(F.transform("__items", lambda x: x["t"]), separator).alias(name)
    )


def joined_in_order(place: Column, text: Column, separator: str) -> Column:
    """Aggregate for groups known to be small (the classes of a shot, the labels of a cluster)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), text.alias("t")))), lambda x: x["t"]), separator)


def first_seen(df: DataFrame, keys: Sequence[str], value: str, place: Sequence[str]) -> DataFrame:
    """Distinct values per key with the place of their first appearance, as `first_place`."""
    return df.groupBy(*keys, value).agg(F.min(F.struct(*place)).alias("first_place"))
