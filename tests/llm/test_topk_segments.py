import math
import random

import numpy as np
import pytest

from cinelake.llm import topk_segments


def expected(vectors, asked, k):
    usable = [(i, v) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in usable]
    out = []
    for q, x in {i: v for i, v in whole if i in asked}.items():
        scored = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in whole if i != q and len(v) == len(x))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [1, 7, 64])
def test_matches_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(topk_segments, "QUERIES_PER_CELL", 3)
    monkeypatch.setattr(topk_segments, "BLOCK", 16)
    rng = random.Random(size)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(size)]) for i in range(300)] + [(1000 + i, [0.5] * size) for i in range(40)]
    vectors += [(2000, None), (2001, [None] * size), (2002, [math.nan] * size), (2003, [math.inf] * size), (None, [1.0] * size), (2004, []), (2006, []), (2005, [1.0] * (size + 1)), (3, [0.1] * size)]
    asked = {i for i, _ in vectors if i is not None and i % 50 == 0} | {1001, 2004, 2005}
    df = spark.createDataFrame([(i, v, i) for i, v in vectors], "vec_id bigint, embedding array<float>, rank bigint").repartition(5)
    got = topk_segments.exact_top_k(df, df.filter(df.vec_id.isin(*asked)), k=4)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    assert sorted(tuple(r) for r in got.collect()) == expected(exact, asked, 4)


def test_large_components_stay_exact(spark):
    df = spark.createDataFrame([(0, [2.0**24, 3.0]), (1, [2.0**24, 1.0]), (2, [2.0**24, 2.0])], "vec_id bigint, embedding array<double>")
    got = topk_segments.exact_top_k(df, df.filter("vec_id = 0"), k=2)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1)]  # both stop at a long: ties by id


def test_components_beyond_floating_point(spark):
    df = spark.createDataFrame([(0, [2.0**20, 1.0]), (1, [2.0**20, 3.0]), (2, [2.0**20, 2.0])], "vec_id bigint, embedding array<double>")
    got = topk_segments.exact_top_k(df, df.filter("vec_id = 0"), k=2)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 1, 2**56 + 3 * 2**16), (0, 2, 2, 2**56 + 2 * 2**16)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk_segments.exact_top_k(df, df).count() == 0
