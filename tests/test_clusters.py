"""Components, activities, faces, merging."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinelake.operators.components import connected_components
from cinelake.operators.cosine import metric_cells
from cinelake.plans import activities, people


def union_find(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return [find(x) for x in range(n)]


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(rng.randint(40, 99), rng.randint(40, 99)) for _ in range(25)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    want = union_find(161, edges)
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: want[x] for x in touched}


CLIPS = "id string, ts_s double, lat double, lon double"


def parts(spark, clips, **kw):
    out = {}
    for r in activities.raw_activities(spark.createDataFrame(clips, CLIPS), **kw).collect():
        out.setdefault(r.activity, set()).add(r.id)
    return sorted(map(sorted, out.values()))


H10 = 1_718_445_600.0  # 2024-06-15 10:00 UTC


@pytest.mark.parametrize(
    "clips, want",
    [
        ([("a", H10, 18.788, 98.985), ("b", H10 + 600, 18.7881, 98.9851), ("c", H10 + 1200, 18.7882, 98.9852)], [["a", "b", "c"]]),
        ([("a", H10, 18.788, 98.985), ("b", H10 + 7200, 18.788, 98.985)], [["a"], ["b"]]),
        ([("a", H10, 18.788, 98.985), ("b", H10 + 300, 18.9, 99.1)], [["a"], ["b"]]),
        ([("a", H10, None, None), ("b", H10 + 600, None, None), ("c", H10 + 14400, None, None)], [["a", "b"], ["c"]]),
        ([("a", H10, 18.788, None)], [["a"]]),
        ([("a", H10, None, None), ("b", H10 + 1800, None, None)], [["a", "b"]]),
        ([("a", H10, 10.0, 180.0), ("b", H10, 10.0, -180.0)], [["a", "b"]]),
        ([("a", H10, 90.0, 10.0), ("b", H10, 89.9999, -170.0)], [["a", "b"]]),
    ],
)
def test_activities_small_cases(spark, clips, want):
    assert parts(spark, clips) == want


def haversine(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    x = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


@pytest.mark.parametrize("seed, lat", [(1, 0.0), (2, 47.0), (3, 78.0)])
def test_activities_against_brute_force(spark, seed, lat):
    rng = random.Random(seed)
    clips = []
    for i in range(90):
        gps = rng.random() < 0.8
        # About 3 km across: chains of cells, near misses and gaps.
        clips.append((f"{i:03d}", H10 + rng.randint(0, 30_000), lat + rng.uniform(0, 0.03) if gps else None, 98 + rng.uniform(0, 0.03) / math.cos(math.radians(lat)) if gps else None))
    edges = []
    for i, a in enumerate(clips):
        for j, b in enumerate(clips[:i]):
            near = True if a[2] is None or b[2] is None else haversine(a[2:], b[2:]) <= 500
            if near and abs(a[1] - b[1]) <= 1800:
                edges.append((i, j))
    want = {}
    for i, root in enumerate(union_find(len(clips), edges)):
        want.setdefault(root, []).append(clips[i][0])
    assert parts(spark, clips) == sorted(map(sorted, want.values()))


def test_no_clips(spark):
    assert parts(spark, []) == []


def test_semantic_split(spark, rows):
    clips = spark.createDataFrame([("a", H10, None, None), ("b", H10 + 60, None, None), ("c", H10 + 120, None, None), ("d", H10 + 180, None, None), ("e", H10 + 240, None, None)], CLIPS)
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("e", [1.0, 0.0])], "id string, mean_vector array<double>")
    members, clusters = activities.cluster_activities(clips, vectors)
    got = {}
    for r in members.collect():
        got.setdefault(r.cluster_id, []).append(r.id)
    # d has no vector, so e is compared with nothing.
    assert sorted(map(sorted, got.values())) == [["a", "b"], ["c", "d", "e"]]
    assert rows(clusters, "n_clips") == [(2,), (3,)]


def test_faces_three_groups(spark):
    rng = np.random.default_rng(42)
    data = []
    for g in range(3):
        base = np.zeros(512)
        base[g * 10] = 1.0
        for i in range(5):
            data.append((g * 5 + i, f"m{g}", i, (base + rng.normal(0, 0.01, 512)).astype("float32").tolist()))
    data.append((15, "lone", 0, np.eye(512)[400].tolist()))
    faces = spark.createDataFrame(data, "row_id bigint, media_id string, frame_number bigint, embedding array<float>").withColumn("face_index", F.lit(0))
    labelled, clusters = people.cluster_faces(faces, block_rows=4)
    got = {r.row_id: r.cluster_id for r in labelled.collect()}
    assert got == {**{i: i // 5 for i in range(15)}, 15: None}
    for r in clusters.collect():
        assert np.linalg.norm(r.representative_embedding) == pytest.approx(1.0)
        assert r.sample_image_paths == ",".join(f"m{r.cluster_id}:{i}" for i in range(5))


def test_face_copies_count_once_each(spark):
    same, other = [1.0, 0.0], [0.0, 1.0]
    faces = spark.createDataFrame([(i, "m", i, same) for i in range(4)] + [(9, "m", 9, other), (10, "m", 10, other)], "row_id bigint, media_id string, frame_number bigint, embedding array<float>").withColumn("face_index", F.lit(0))
    labelled, _ = people.cluster_faces(faces)
    got = {r.row_id: r.cluster_id for r in labelled.collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: None, 10: None}


def dbscan(points, eps, m):
    u = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = (1 - u @ u.T) <= eps
    np.fill_diagonal(near, True)
    core = near.sum(1) >= m
    labels, n = [-1] * len(points), 0
    for i in range(len(points)):
        if labels[i] != -1 or not core[i]:
            continue
        stack = [i]
        while stack:
            x = stack.pop()
            if labels[x] == -1:
                labels[x] = n
                if core[x]:
                    stack.extend(j for j in np.flatnonzero(near[x]) if labels[j] == -1)
        n += 1
    return labels


@pytest.mark.parametrize("seed", [0, 1])
def test_faces_against_plain_dbscan(spark, seed):
    points = np.random.default_rng(seed).normal(size=(70, 3))
    faces = spark.createDataFrame([(i, "m", i, p.tolist()) for i, p in enumerate(points)], "row_id bigint, media_id string, frame_number bigint, embedding array<double>").withColumn("face_index", F.lit(0))
    labelled, _ = people.cluster_faces(faces, eps=0.02, min_samples=3, block_rows=13)
    got = [-1 if r.cluster_id is None else r.cluster_id for r in labelled.orderBy("row_id").collect()]
    assert got == dbscan(points, 0.02, 3)


def test_merge(spark, rows):
    clusters = spark.createDataFrame([("a", "09:00", "10:00"), ("b", "08:00", "09:30"), ("c", None, None), ("d", "2024-01-01T09:00:00+07:00", ""), ("e", "2024-01-01T03:00:00Z", "2024-01-01T04:00:00Z"), ("f", "soon", None)], "cluster_id string, time_start string, time_end string")
    members = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "y"), ("b", 1, "z")], "cluster_id string, pos int, media_id string")
    requests = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (2, 0, "a"), (3, 0, "a"), (3, 1, "nope"), (4, 0, "e"), (4, 1, "d"), (5, 0, "e"), (5, 1, "f")], "request_id int, pos int, cluster_id string")
    merged, rejects = activities.merge_clusters(clusters, members, requests)
    assert rows(merged) == [(1, "b", "08:00", "10:00"), (4, "e", "2024-01-01T09:00:00+07:00", "2024-01-01T04:00:00Z")]
    assert rows(rejects) == [(2, "at least 2 cluster ids required"), (3, "unknown cluster id"), (5, "unreadable time")]
    placed = activities.merged_members(members, requests, merged).orderBy("place").collect()
    assert [r.media_id for r in placed] == ["y", "z", "x"]


def clumps(rng, n_clumps, each, dim):
    centres = rng.normal(size=(n_clumps, dim))
    points = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), each, axis=0) + rng.normal(0, 0.01, (n_clumps * each, dim))
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def unit_rows(spark, points):
    return spark.createDataFrame([(i, p.tolist(), 1) for i, p in enumerate(points)], "row_id bigint, unit array<double>, copies bigint")


def test_cells_hold_every_neighbour_and_stay_small(spark):
    points = np.concatenate([clumps(np.random.default_rng(7), 20, 12, 6), np.random.default_rng(8).normal(size=(120, 6))])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    cells = {}
    for r in metric_cells(unit_rows(spark, points), 0.05, block_rows=15, n_pivots=5, rows_per_task=40).collect():
        cells.setdefault(r.cell, ([], []))[0 if r.own else 1].append(r.row_id)
    homes = {i: c for c, (own, _) in cells.items() for i in own}
    assert sorted(homes) == list(range(len(points))) and max(len(own) for own, _ in cells.values()) <= 15
    near = 1 - points @ points.T <= 0.05
    for i, c in homes.items():
        assert set(np.flatnonzero(near[i])) <= set(cells[c][0]) | set(cells[c][1])


def test_copies_do_not_grow_with_rows(spark):
    """Six times the rows and cells, the same number of copies of each."""
    copies = []
    for n_clumps in (40, 240):
        points = clumps(np.random.default_rng(3), n_clumps, 10, 24)
        copies.append(metric_cells(unit_rows(spark, points), 0.02, block_rows=20, n_pivots=32).count() / len(points))
    assert copies[1] < 1.5 * copies[0], copies


def test_clusters_of_clumps_against_plain_dbscan(spark):
    points = clumps(np.random.default_rng(11), 25, 8, 5)
    points[50:60] = points[50]
    faces = spark.createDataFrame([(i, "m", i, (p * 3).tolist()) for i, p in enumerate(points)], "row_id bigint, media_id string, frame_number bigint, embedding array<double>").withColumn("face_index", F.lit(0))
    labelled, _ = people.cluster_faces(faces, eps=0.03, min_samples=4, block_rows=9)
    got = [-1 if r.cluster_id is None else r.cluster_id for r in labelled.orderBy("row_id").collect()]
    assert got == dbscan(points, 0.03, 4)


def test_vectors_that_pivots_cannot_tell_apart_are_cut_into_blocks(spark):
    points = np.random.default_rng(5).normal(size=(700, 24))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    cells = metric_cells(unit_rows(spark, points), 0.45, block_rows=40).groupBy("cell").count().collect()
    assert sum(r["count"] for r in cells) <= 18 * len(points) and any("/" in r.cell for r in cells)
    faces = spark.createDataFrame([(i, "m", i, (p * 3).tolist()) for i, p in enumerate(points)], "row_id bigint, media_id string, frame_number bigint, embedding array<double>").withColumn("face_index", F.lit(0))
    labelled, _ = people.cluster_faces(faces, eps=0.45, min_samples=4, block_rows=40)
    got = [-1 if r.cluster_id is None else r.cluster_id for r in labelled.orderBy("row_id").collect()]
    assert got == dbscan(points, 0.45, 4)
