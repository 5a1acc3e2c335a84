"""Interval joins: an equality on (key, time bucket) plus the exact condition.

Long intervals are repeated in every bucket they touch; a pair is kept only in the bucket where its overlap
begins, so it comes out once. The bucket spreads one long recording over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _bucket(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(float(width))).cast("bigint")


def _spread(df: DataFrame, start: str, end: str, width: float, first: str) -> DataFrame:
    lo, hi = _bucket(F.col(start), width), _bucket(F.col(end), width)
    return (
        df.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
        .withColumn(first, lo)
        .withColumn("__bucket", F.explode(F.sequence(lo, hi)))
    )


def overlap_join(
    left: DataFrame, right: DataFrame, key: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float
) -> DataFrame:
    """Pairs whose open intervals meet: left.start < right.end and left.end > right.start. Rows with a null bound drop out."""
    ls, le = left_span
    rs, re = right_span
    a = _spread(left, ls, le, width, "__a")
    b = _spread(right, rs, re, width, "__b")
    pairs = a.join(b, [*key, "__bucket"])
    meet = (F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs))
    return pairs.filter(meet & (F.col("__bucket") == F.greatest("__a", "__b"))).drop("__bucket", "__a", "__b")


def point_join(points: DataFrame, spans: DataFrame, key: Sequence[str], at: str, span: tuple[str, str], width: float) -> DataFrame:
    """Pairs with span.start <= point <= span.end: a point on a shared boundary belongs to both spans."""
    start, end = span
    a = points.filter(F.col(at).isNotNull()).withColumn("__bucket", _bucket(F.col(at), width))
    b = _spread(spans, start, end, width, "__b").drop("__b")
    return a.join(b, [*key, "__bucket"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("__bucket")


def not_contained(spans: DataFrame, covers: DataFrame, key: Sequence[str], span: tuple[str, str], cover: tuple[str, str], width: float) -> DataFrame:
    """Spans that no single cover contains whole."""
    s, e = span
    cs, ce = cover
    slim = covers.select(*key, F.col(cs).alias("__cs"), F.col(ce).alias("__ce"))
    b = _spread(slim, "__cs", "__ce", width, "__b").drop("__b")
    a = spans.withColumn("__bucket", _bucket(F.col(s), width))
    same = [a[k] == b[k] for k in [*key, "__bucket"]]
    inside = (b["__cs"] <= a[s]) & (b["__ce"] >= a[e])
    cond = inside
    for c in same:
        cond = c & cond
    return a.join(b, cond, "left_anti").drop("__bucket")
