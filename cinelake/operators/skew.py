"""Joins and ordered computations that stay parallel when one key holds much of the table.

Ordered computations take a `segment` column: a coarse, monotone function of the order (a time bucket, a
position range, or what `range_segments` adds). Each (key, segment) is worked on by itself; one aggregate row per segment carries what the
segments before (or after) it contribute, so no task ever sees all rows of a hot key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinelake.session import cut_lineage

ROWS_PER_SALT = 1_000_000

_CARRY = "__carry"


def salted_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    row_count: str,
    how: str = "inner",
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Join `facts` with `lookup`, which has one row per key and the number of fact rows of that key.

    Keys with more than `rows_per_salt` facts are split over as many tasks as that takes.
    """
    keys = list(keys)
    n_salts = (F.floor(F.col(row_count) / rows_per_salt) + 1).cast("int")
    hot = lookup.filter(F.col(row_count) > rows_per_salt).select(*keys, n_salts.alias("__salts"))
    spread = (
        facts.join(hot, keys, "left")
        .withColumn(
            "__salt",
            F.when(
                F.col("__salts").isNull(), F.lit(0)
            ).otherwise(F.pmod(F.xxhash64(*facts.columns), F.col("__salts").cast("bigint")).cast("int")),
        )
        .drop("__salts")
    )
    copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), n_salts - 1)))
    return spread.join(copies, [*keys, "__salt"], how).drop("__salt")


def has_hot_key(df: DataFrame, keys: Sequence[str], rows_per_segment: int = ROWS_PER_SALT) -> bool:
    """Whether a key has more than `rows_per_segment` rows; where none has, a plain window over the keys is as good as segments."""
    return (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > rows_per_segment


def range_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "__segment", rows_per_segment: int = ROWS_PER_SALT) -> DataFrame:
    """Add a segment column for orders without a natural bucket.

    While no key has more than `rows_per_segment` rows, one segment does. Otherwise the table is range-partitioned
    by key and order, which cuts a hot key wherever its rows are many, and written once, so that the partition a
    row fell into stays its segment.
    """
    size = df.groupBy(*keys).count().agg(F.max("count").alias("most"), F.sum("count").alias("total")).first()
    if (size["most"] or 0) <= rows_per_segment:
        return df.withColumn(name, F.lit(0))
    n = math.ceil(size["total"] / rows_per_segment) + 1
    return cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn(name, F.spark_partition_id()))


def _edges(df: DataFrame, keys: Sequence[str], segment: str, value: Column) -> DataFrame:
    return df.groupBy(*keys, segment).agg(value.alias("__edge"))


def neighbour_across(
    df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], columns: dict[str, str], ahead: bool = False
) -> DataFrame:
    """Add `columns` (new name -> existing name) holding the previous row's values, or the next row's if `ahead`."""
    keys = list(keys)
    place = F.struct(*order)
    values = F.struct(*[F.col(old).alias(old) for old in dict.fromkeys(columns.values())])
    pick = F.min_by(values, place) if ahead else F.max_by(values, place)
    along = Window.partitionBy(*keys).orderBy(segment)
    target = F.lag(segment).over(along) if ahead else F.lead(segment).over(along)
    carried = (
        _edges(df, keys, segment, pick)
        .withColumn(segment, target)
        .filter(F.col(segment).isNotNull())
        .select(*keys, segment, "__edge.*", F.lit(True).alias(_CARRY))
    )
    both = df.withColumn(_CARRY, F.lit(False)).unionByName(carried, allowMissingColumns=True)
    outer = F.col(_CARRY).asc() if ahead else F.col(_CARRY).desc()
    w = Window.partitionBy(*keys, segment).orderBy(outer, *order)
    step = F.lead if ahead else F.lag
    picked = {new: step(F.col(old)).over(w) for new, old in columns.items()}
    return both.withColumns(picked).filter(~F.col(_CARRY)).drop(_CARRY)


def running_sum_across(
    df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], value: Column, name: str, exclusive: bool = False
) -> DataFrame:
    """Add the running sum of `value` in `order`; `exclusive` leaves the row's own value out."""
    keys = list(keys)
    valued = df.withColumn("__value", value)
    before = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        _edges(valued, keys, segment, F.sum("__value"))
        .withColumn("__value", F.sum("__edge").over(before))
        .filter(F.col("__value").isNotNull())
        .select(*keys, segment, "__value", F.lit(True).alias(_CARRY))
    )
    both = valued.withColumn(_CARRY, F.lit(False)).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*keys, segment).orderBy(F.col(_CARRY).desc(), *order)
    frame = w.rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    total = F.coalesce(F.sum("__value").over(frame), F.lit(0))
    return both.withColumn(name, total).filter(~F.col(_CARRY)).drop(_CARRY, "__value")


def row_number_across(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], name: str) -> DataFrame:
    """Add 1, 2, 3, ... in `order` within each key."""
    numbered = running_sum_across(df, keys, segment, order, F.lit(1).cast("bigint"), name)
    return numbered.withColumn(name, F.col(name).cast("bigint"))


def last_known_across(
    df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Add the latest non-null `value` at or before the row."""
    keys = list(keys)
    valued = df.withColumn("__value", value)
    before = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    edge = F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*order)))
    carried = (
        _edges(valued, keys, segment, edge)
        .withColumn("__value", F.last("__edge", ignorenulls=True).over(before))
        .filter(F.col("__value").isNotNull())
        .select(*keys, segment, "__value", F.lit(True).alias(_CARRY))
    )
    both = valued.withColumn(_CARRY, F.lit(False)).unionByName(carried, allowMissingColumns=True)
    w = (
        Window.partitionBy(*keys, segment)
        .orderBy(F.col(_CARRY).desc(), *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return both.withColumn(name, F.last("__value", ignorenulls=True).over(w)).filter(~F.col(_CARRY)).drop(_CARRY, "__value")


def affine_scan(
    df: DataFrame, keys: Sequence[str], index: str, factor: str, offsets: dict[str, str], width: int = 256
) -> DataFrame:
    """(keys, index, and per entry of `offsets` its scan): s[i] = factor[i] * s[i-1] + offset[i], s = 0 before the first row.

    `offsets` maps new names to offset columns. A run of rows is itself an affine step, so runs of `width`
    indices are folded alone, and the folds, one row per run, are scanned in turn until a key has no more than
    `width` of them. `index` counts from 0 and is unique within a key; no list ever holds more than `width` rows.
    """
    keys = list(keys)
    zero = F.array(*[F.lit(0.0) for _ in offsets])
    item = F.struct(
        F.col(index).cast("bigint").alias("i"), F.col(factor).alias("m"), F.array(*[F.col(c).cast("double") for c in offsets.values()]).alias("b")
    )

    def step(state: Column, x: Column) -> Column:
        return F.zip_with(state, x["b"], lambda s, b: x["m"] * s + b)

    run = F.floor(F.col(index) / width).cast("bigint")
    runs = df.groupBy(*keys, run.alias("__run")).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    folded = cut_lineage(
        runs.select(
            *keys, "__run", F.aggregate("__items", F.lit(1.0), lambda s, x: s * x["m"]).alias("__m"),
            F.aggregate("__items", zero, step).alias("__b"),
        )
    )
    last = folded.agg(F.max("__run")).first()[0]
    if last is None or last < width:
        chain = folded.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("__run").alias("i"), F.col("__m").alias("m"), F.col("__b").alias("b")))).alias("__items"))
        starts = _states(chain.withColumn("__start", zero), keys, step).select(*keys, F.col("i").alias("__run"), F.col("before").alias("__start"))
    else:
        parts = {f"__b{n}": f"__b{n}" for n in range(len(offsets))}
        flat = folded.select(*keys, "__run", "__m", *[F.col("__b")[n].alias(f"__b{n}") for n in range(len(offsets))])
        scanned = cut_lineage(affine_scan(flat, keys, "__run", "__m", parts, width))
        grouped = scanned.select(*keys, "__run", F.floor(F.col("__run") / width).alias("__group"), F.array(*parts).alias("__end"))
        starts = neighbour_across(grouped, keys, "__group", ["__run"], {"__start": "__end"}).select(*keys, "__run", F.coalesce("__start", zero).alias("__start"))
    rows = _states(runs.join(starts, [*keys, "__run"]), keys, step)
    return rows.select(*keys, F.col("i").alias(index), *[F.col("after")[n].alias(name) for n, name in enumerate(offsets)])


def _states(lists: DataFrame, keys: Sequence[str], step: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, i, before, after) for each entry of `__items`, starting from `__start`."""
    empty = F.expr("cast(array() as array<struct<i:bigint,before:array<double>,after:array<double>>>)")

    def push(done: Column, x: Column) -> Column:
        before = F.when(F.size(done) == 0, F.col("__start")).otherwise(F.element_at(done, -1)["after"])
        return F.concat(done, F.array(F.struct(x["i"].alias("i"), before.alias("before"), step(before, x).alias("after"))))

    return lists.select(*keys, F.explode(F.aggregate("__items", empty, push)).alias("__x")).select(*keys, "__x.*")
