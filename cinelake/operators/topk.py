"""Ranked selections. A rank filter is pushed below the shuffle, so each task ships at most k rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
    return ranked.withColumn(rank, F.col(rank).cast("bigint"))


def page_of(df: DataFrame, order: Sequence[Column], page: int, per_page: int) -> DataFrame:
    """The given page (from 1) in the given order, without numbering the whole table."""
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


# Columns the catalog may be sorted by.
BROWSE_SORTS = ("file_path", "duration_seconds", "created_at", "resolution_w", "status")


def browse_order(sort: str, order: str, tie: str) -> list[Column]:
    """Unknown sort columns mean created_at; any order but asc means descending. Nulls come first going up."""
    column = F.col(sort if sort in BROWSE_SORTS else "created_at")
    if order.lower() == "asc":
        return [column.asc_nulls_first(), F.col(tie).asc()]
    return [column.desc_nulls_last(), F.col(tie).asc()]


def fixed_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Sort by a position in a fixed list; what is not listed comes last."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.orderBy(F.when(at > 0, at).otherwise(F.lit(999)), column)
