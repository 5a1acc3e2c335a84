"""Segmented computations against plain windows, with one key holding most rows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from cinelake.operators import skew
from cinelake.operators.intervals import not_contained, overlap_join, point_join
from cinelake.operators.text import paged_text


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 5)}", i, rng.random() if rng.random() < 0.7 else None) for i in range(600)]
    return spark.createDataFrame(data, "k string, i bigint, v double").withColumn("seg", F.floor(F.col("i") / 37)).cache()


def window():
    return Window.partitionBy("k").orderBy("i")


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("ahead", [False, True])
def test_neighbour(table, ahead):
    plain = (F.lead if ahead else F.lag)("v").over(window())
    got = skew.neighbour_across(table, ["k"], "seg", ["i"], {"n": "v"}, ahead)
    same(got.select("k", "i", "n"), table.select("k", "i", plain.alias("n")))


def test_row_number_and_sums(table):
    got = skew.row_number_across(table, ["k"], "seg", ["i"], "n")
    same(got.select("k", "i", "n"), table.select("k", "i", F.row_number().over(window()).cast("bigint").alias("n")))
    whole = table.withColumn("x", F.col("i") % 7)
    got = skew.running_sum_across(whole, ["k"], "seg", ["i"], F.col("x"), "s", exclusive=True)
    before = F.coalesce(F.sum("x").over(window().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same(got.select("k", "i", "s"), whole.select("k", "i", before.alias("s")))


def test_last_known(table):
    got = skew.last_known_across(table, ["k"], "seg", ["i"], F.col("v"), "l")
    plain = F.last("v", ignorenulls=True).over(window().rowsBetween(Window.unboundedPreceding, 0))
    same(got.select("k", "i", "l"), table.select("k", "i", plain.alias("l")))


@pytest.mark.parametrize("width", [4, 16, 1000])
def test_affine_scan(spark, width):
    rng = random.Random(width)
    data = {k: [(rng.choice([0.0, 0.5, 0.9, 1.0]), rng.random()) for _ in range(n)] for k, n in (("a", 150), ("b", 3), ("c", 17))}
    df = spark.createDataFrame([(k, i, m, b) for k, steps in data.items() for i, (m, b) in enumerate(steps)], "k string, i bigint, m double, b double")
    got = {(r.k, r.i): r.s for r in skew.affine_scan(df, ["k"], "i", "m", {"s": "b"}, width=width).collect()}
    for k, steps in data.items():
        s = 0.0
        for i, (m, b) in enumerate(steps):
            s = m * s + b
            assert got[k, i] == pytest.approx(s)
    assert len(got) == 170


def test_salted_lookup_splits_hot_keys(spark, table):
    lookup = table.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    facts = table.select("k", "i")
    got = skew.salted_lookup(facts, lookup, ["k"], "n", rows_per_salt=20)
    same(got.select("k", "i", "top"), facts.join(lookup, "k").select("k", "i", "top"))


def test_interval_joins_against_brute_force(spark, rows):
    rng = random.Random(3)
    def spans(n):
        return [("m" if rng.random() < 0.7 else "x", i, s, s + rng.choice([0, 1, 5, 40, 200])) for i, s in ((i, rng.randint(-50, 300)) for i in range(n))]
    a, b = spans(80), spans(60)
    left = spark.createDataFrame([(k, i, float(s), float(e)) for k, i, s, e in a], "k string, i int, s double, e double")
    right = spark.createDataFrame([(k, i, float(s), float(e)) for k, i, s, e in b], "k string, j int, s2 double, e2 double")
    got = rows(overlap_join(left, right, ["k"], ("s", "e"), ("s2", "e2"), 10.0), "i", "j")
    assert got == sorted(((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and x[3] > y[2]), key=repr)
    got = rows(point_join(left, right, ["k"], "s", ("s2", "e2"), 10.0), "i", "j")
    assert got == sorted(((x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[2] <= x[2] <= y[3]), key=repr)
    got = rows(not_contained(left, right, ["k"], ("s", "e"), ("s2", "e2"), 10.0), "i")
    assert got == sorted(((x[1],) for x in a if not any(x[0] == y[0] and y[2] <= x[2] and y[3] >= x[3] for y in b)), key=repr)


def test_range_segments_cut_hot_keys(spark, table):
    tied = table.withColumn("same", F.lit(1))
    cut = skew.range_segments(tied, ["k"], ["same", "i"], "r", rows_per_segment=40)
    hot = [r["count"] for r in cut.filter("k = 'hot'").groupBy("r").count().collect()]
    assert len(hot) > 3 and max(hot) < 150
    got = skew.neighbour_across(cut, ["k"], "r", ["same", "i"], {"n": "i"})
    same(got.select("k", "i", "n"), table.select("k", "i", F.lag("i").over(window()).alias("n")))
    assert skew.range_segments(tied, ["k"], ["i"], "r").select("r").distinct().count() == 1


def test_paged_text_is_whole(table):
    texts = table.withColumn("t", F.col("i").cast("string"))
    pages = paged_text(texts, ["k"], "seg", ["i"], "t", ",", "all", page_rows=50)
    got = {}
    for r in pages.orderBy("page").collect():
        assert r["all"].count(",") < 50
        got.setdefault(r.k, []).append(r["all"])
    want = {}
    for r in texts.orderBy("i").collect():
        want.setdefault(r.k, []).append(r.t)
    assert {k: ",".join(v) for k, v in got.items()} == {k: ",".join(v) for k, v in want.items()}
