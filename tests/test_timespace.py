"""Neighbours in time and space when very many rows share a cell and an hour."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cinelake.operators import timespace as tsp

M = 111_194.93  # metres per degree of latitude


def components(rows, time_s, space_m):
    def haversine(p, q):
        a = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(math.sqrt(a))

    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, t, lat, lon) in enumerate(rows):
        for j in range(i):
            if abs(t - rows[j][1]) <= time_s and (lat is None or rows[j][2] is None or haversine((lat, lon), rows[j][2:]) <= space_m):
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted(sorted(g) for g in groups.values())


def cloud(rng, first_id, n, metres, width, t, height=40):
    """n spots in a strip of `width` metres that starts `metres` north of 10 N 20 E."""
    return [(first_id + i, t + rng.random() * 900, 10 + (metres + rng.random() * width) / M, 20 + rng.random() * height / M) for i in range(n)]


def found(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, ts double, lat double, lon double")
    placed, nodes = tsp.time_space_components(df, "id", "ts", "lat", "lon")
    got = {}
    for r in placed.join(nodes.select("node", "component"), "node").collect():
        got.setdefault(r.component, []).append(r.id)
    return sorted(sorted(g) for g in got.values())


@pytest.mark.parametrize("apart", [498.0, 506.0])
def test_two_crowds_about_the_limit_apart(spark, monkeypatch, apart):
    """Small limits make the test divide cells down to single spots."""
    monkeypatch.setattr(tsp.meeting_components, "__defaults__", (6, None))
    rng = random.Random(2)
    rows = cloud(rng, 0, 40, 0, 20, 0.0) + cloud(rng, 100, 40, 20 + apart, 20, 0.0) + cloud(rng, 200, 20, 20 + apart + 490, 30, 1900.0)
    assert found(spark, rows) == components(rows, 1800.0, 500.0)


def test_pairs_looked_at_grow_along_the_limit(spark):
    """A third of the rows in one cell and hour, a third about the limit away: far fewer pairs than their product."""
    work = {}
    for n in (500, 2000):
        rng = random.Random(n)
        rows = cloud(rng, 0, n, 0, 100, 0.0, 100) + cloud(rng, n, n, 600.5, 100, 0.0, 100) + cloud(rng, 2 * n, n, 90_000, 5000, 90_000.0)
        df = spark.createDataFrame(rows, "id bigint, ts double, lat double, lon double")
        gridded = tsp.place_in_grid(df, "ts", "lat", "lon", 1800.0, 500.0)
        nodes = tsp._nodes(gridded, "id", "ts")
        pairs = tsp._cell_pairs(nodes, 1800.0).filter("not sure").select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
        counted = []
        tsp.meeting_components(pairs, tsp._spots(gridded, "ts", "lat", "lon", 500.0), 1800.0, 500.0, 256, counted).count()
        work[n] = sum(counted)
    assert work[2000] < 0.1 * 2000 * 2000
    assert work[2000] < 8 * work[500]
