"""Sessions of a hot camera, sliding means by panes, best rows per task, top classes."""

import random

import numpy as np
from pyspark.sql import functions as F

from cinelake.operators import ordered, summaries, vector_search


def test_sessions_of_a_camera_with_a_third_of_all_rows(spark):
    rng = random.Random(6)
    clips = [(0, i, float(rng.choice([0, 3600, 3600, 7000]) + rng.randint(0, 900))) for i in range(400)] + [(1 + i % 40, 1000 + i, float(rng.randint(0, 90_000))) for i in range(800)]
    df = spark.createDataFrame(clips, "camera int, id int, ts double").repartition(8)
    got = {r.id: r.session for r in ordered.sessions(df, ["camera"], "ts", 600.0, "id", "session", rows_per_segment=60).collect()}
    want = {}
    for camera in {c[0] for c in clips}:
        before, n = None, 0
        for _, i, ts in sorted((c for c in clips if c[0] == camera), key=lambda c: (c[2], c[1])):
            n += before is not None and ts - before > 600
            want[i], before = n, ts
    assert got == want


def test_sliding_means_by_panes(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(0, 2000), [rng.random() for _ in range(5)]) for _ in range(300)] + [("a", 5, None)]
    df = spark.createDataFrame(rows, "key string, s int, v array<double>").withColumn("at", F.timestamp_seconds("s"))
    for length, slide in (("5 minutes", "1 minute"), ("90 seconds", "60 seconds")):
        out = ordered.sliding_means(df, ["key"], "at", "v", length, slide)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "posexplode" not in plan.lower()
        n, step = {"5 minutes": (300, 60), "90 seconds": (90, 60)}[length]
        want = {}
        for key, s, v in rows:
            start = s // step * step
            while v is not None and start > s - n:
                want.setdefault((key, start), []).append(v)
                start -= step
        got = {(r.key, r.w): r.mean_vector for r in out.select("key", F.unix_seconds("window_start").alias("w"), "mean_vector").collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], np.mean(want[k], axis=0)) for k in want)


def test_best_rows_over_blocks():
    rng = np.random.default_rng(4)
    vectors, queries = rng.integers(-2, 3, (500, 3)).astype(float), rng.integers(-2, 3, (30, 3)).astype(float)
    ids = np.array([f"r{i:03d}" for i in rng.permutation(500)], dtype=object)
    best = vector_search.Best(queries, 7)
    for start in range(0, 500, 33):
        best.add(ids[start : start + 33], vectors[start : start + 33])
        assert len(best.query) <= 7 * len(queries)
    for q in range(30):
        want = sorted(zip(-(vectors @ queries[q]), ids))[:7]
        mine = best.query == q
        assert list(zip(-best.scores[mine], best.ids[mine])) == want


def test_a_task_hands_on_k_rows_per_query(spark):
    rows = [(i, [float(i % 17), float(i % 5)]) for i in range(5000)]
    vectors = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(3)
    queries = spark.createDataFrame([(0, [1.0, 0.5]), (1, [-1.0, 0.1])], "q bigint, qv array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = vector_search.exact_top_k(vectors, "id", "v", queries, "q", "qv", 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q, v in ((0, [1.0, 0.5]), (1, [-1.0, 0.1])):
        unit = np.array(v) / np.linalg.norm(v)
        want = sorted((-round(float(np.dot(x, unit)), 9), i) for i, x in rows)[:4]
        assert [(-round(r.score, 9), r.id) for r in sorted((r for r in got if r.q == q), key=lambda r: r["rank"])] == want


def test_top_classes_and_boxes_per_class(spark, rows):
    boxes = spark.createDataFrame([("m", "a", 2), ("m", "b", 1), ("m", "b", 3), ("m", "a", 4), ("m", "c", 0), ("n", None, 0)], "media_id string, class string, pos int")
    top = summaries.top_classes(boxes.filter("class is not null"), ["media_id"], "class", ["pos"], 2, "top")
    assert rows(top) == [("m", "b (2), a (2)")]
    assert rows(summaries.boxes_per_class(boxes), "media_id", "class", "n") == [("m", "a", 2), ("m", "b", 2), ("m", "c", 1), ("n", "unknown", 1)]


def test_probed_lists_meet_queries_in_blocks(spark, rows, monkeypatch):
    """All lists probed, lists and their queries cut into small blocks: what exact search finds, and no row per pair."""
    from cinelake.plans import search

    monkeypatch.setattr(vector_search, "ROW_BLOCK", 16)
    monkeypatch.setattr(vector_search, "MAX_BROADCAST_QUERIES", 5)
    points = np.random.default_rng(8).normal(size=(300, 6)).round(2)
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, v array<double>")
    queries = vectors.filter("id % 10 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    index = search.build_index(vectors, "v")
    found = search.search(vectors, "id", "v", queries, "q", "qv", 4, index, nprobe=1000)
    assert rows(found, "q", "id", "rank") == rows(vector_search.exact_top_k(vectors, "id", "v", queries, "q", "qv", 4, max_broadcast=4096), "q", "id", "rank")
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().executedPlan().toString()


def test_plain_windows_where_no_key_is_hot(spark, rows):
    """The same next clips and offsets as from segments, without their carried rows."""
    rng = random.Random(2)
    clips = spark.createDataFrame([(rng.randint(0, 3), rng.choice([None, 1.0, 2.0, 5.5]), i, rng.randint(1, 9) / 2) for i in range(200)], "k int, start double, pos int, n double")
    nexts = [ordered.with_next_clip(clips, ["k"], "start", ["pos"], {"next_n": "n"}, rows_per_segment=r) for r in (1000, 7)]
    offsets = [ordered.timeline_offsets(clips, ["k"], "pos", ["start"], F.col("n"), rows_per_segment=r) for r in (1000, 7)]
    for plain, cut in (nexts, offsets):
        assert rows(plain, *sorted(plain.columns)) == rows(cut, *sorted(plain.columns))
        assert "Union" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_copies_in_different_blocks_rank_by_id(monkeypatch):
    """Blocks of any shape, met in any order: equal vectors have equal scores, and the smallest ids of them are kept."""
    rng = np.random.default_rng(5)
    few, queries = rng.normal(size=(9, 64)), rng.normal(size=(40, 64))
    vectors, ids = few[rng.integers(0, 9, 700)], rng.permutation(700)
    monkeypatch.setattr(vector_search, "QUERY_BATCH", 7)
    monkeypatch.setattr(vector_search, "ROW_BATCH", 11)
    best = vector_search.Best(queries, 5)
    for part in np.split(np.arange(700), [1, 3, 90, 91, 400]):
        best.add(ids[part], vectors[part])
    for q in range(40):
        score = np.zeros(700)
        for x, y in zip(vectors.T, queries[q]):
            score += x * y
        assert best.ids[best.query == q].tolist() == ids[np.lexsort((ids, -score))[:5]].tolist()


def test_shelves_hold_lists_that_some_queries_probe(spark, rows, monkeypatch):
    """Some lists probed: only rows of these are found, the best of them, however lists share blocks."""
    from cinelake.plans import search

    monkeypatch.setattr(vector_search, "ROW_BLOCK", 40)
    monkeypatch.setattr(vector_search, "MAX_BROADCAST_QUERIES", 8)
    points = np.random.default_rng(9).normal(size=(300, 6)).round(2)
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, v array<double>")
    queries = vectors.filter("id % 9 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    indexed, centres = search.build_index(vectors, "v")
    found = rows(search.search(vectors, "id", "v", queries, "q", "qv", 4, (indexed, centres), nprobe=3), "q", "id", "rank")
    lists, means = {r["id"]: r["list_id"] for r in indexed.collect()}, {r["list_id"]: np.array(r["centroid"]) for r in centres.collect()}
    want = []
    for q in range(0, 300, 9):
        probed = sorted(means, key=lambda c: -means[c] @ points[q])[:3]
        best = sorted((i for i in lists if lists[i] in probed), key=lambda i: (-points[i] @ points[q], i))[:4]
        want += [(q, i, rank + 1) for rank, i in enumerate(best)]
    assert found == sorted(want, key=repr)


def test_every_vector_asks(spark):
    from workloads import load

    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    for name in ("top04_exact_search", "top05_all_lists"):
        found = load()[0][name](spark, folder)
        assert found.select("q").distinct().count() == n and found.count() == 10 * n
