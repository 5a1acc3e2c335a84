"""Sources, catalog tables and their maintenance, selections, search, views."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinelake.functions import documents, timecode
from cinelake.functions.vectors import decode_vectors
from cinelake.operators import filters, maintenance, topk
from cinelake.operators.scoring import score_in_order
from cinelake.operators.vector_search import exact_top_k, recall
from cinelake.plans import ingest, search, views
from cinelake.schemas import KEYS, TABLES
from cinelake.sources import inventory
from cinelake.sources.documents import write_lines, write_reports
from cinelake.sources.index_store import read_index, write_index
from cinelake.sources.tables import CatalogTables


def test_inventory_and_fingerprints(spark, rows, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("a.MP4", b"one"), ("sub/b.jpg", b"two"), ("sub/c.txt", b"three"), ("mp4", b"four")):
        (tmp_path / name).write_bytes(body)
    files = inventory.media_inventory(spark, str(tmp_path))
    assert rows(files.select(F.regexp_extract("path", r"([^/]+)$", 1), "length")) == [("a.MP4", 3), ("b.jpg", 3)]
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    hashed = inventory.fingerprint_files(files, max_bytes=2)
    assert rows(hashed, "sha256_prefix") == sorted([(hashlib.sha256(b"on").hexdigest(),), (hashlib.sha256(b"tw").hexdigest(),)])
    blob = spark.createDataFrame([(bytearray(b"abcdef"),)], "b binary").select(inventory.fingerprint(F.col("b"), 3)).first()[0]
    assert blob == hashlib.sha256(b"abc").hexdigest()


def test_empty_folder(spark, tmp_path):
    (tmp_path / "x.txt").write_text("no media")
    assert inventory.media_inventory(spark, str(tmp_path)).count() == 0


def test_parse_probe(spark):
    data = [
        ('{"streams": [{"codec_type": "audio", "codec_name": "aac", "channels": 2}, {"codec_type": "video", "codec_name": "h264", "width": 10, "height": 5, "r_frame_rate": "30000/1001"}], "format": {"duration": "1.5"}}', '[{"CreateDate": "2024:01:02 03:04:05", "GPSLatitude": 1.5, "GPSLongitude": "x"}]'),
        ('{"streams": [{"codec_type": "video", "r_frame_rate": "30/0"}]}', "[]"),
        ("broken", "broken"),
    ]
    got = inventory.parse_probe(spark.createDataFrame(data, "probe_json string, exif_json string")).collect()
    a, b, c = got
    assert (a.codec, a.resolution_w, a.audio_channels, a.duration_seconds, a.created_at, a.gps_lat, a.gps_lon) == ("h264", 10, 2, 1.5, "2024-01-02T03:04:05", 1.5, None)
    assert a.fps == pytest.approx(29.97, abs=0.01) and b.fps is None and b.metadata_json is not None
    assert c.codec is None and c.metadata_json is None


@pytest.mark.parametrize(
    "ids, want",
    [
        ([("m1", "abc", 1), ("m2", "abc", 2), ("m3", "def", 3)], [("m1", "m2")]),
        ([("m1", None, 1), ("m2", None, 2)], []),
        ([("a", "x", 1), ("b", "x", 2), ("c", "x", 3)], [("a", "b"), ("a", "c")]),
        ([("z_third", "x", 1), ("m_second", "x", 2), ("a_first", "x", 3)], [("z_third", "a_first"), ("z_third", "m_second")]),
        ([("a,b", "x", 1), ("c", "x", 2)], [("a,b", "c")]),
    ],
)
def test_duplicates(spark, rows, ids, want):
    media = spark.createDataFrame(ids, "id string, sha256_prefix string, ingest_seq int")
    assert rows(ingest.duplicate_pairs(media)) == want
    marked = ingest.dedup_media(media.withColumn("status", F.lit("ingested")))
    assert rows(marked.filter("status = 'duplicate'"), "id") == sorted((d,) for _, d in want)


def test_catalog_tables(spark, rows, tmp_path):
    catalog = CatalogTables(spark, str(tmp_path / "cat"))
    assert len(TABLES) == len(KEYS) == 19
    assert catalog.read("narratives").count() == 0
    n = lambda *r: spark.createDataFrame(list(r), "narrative_id string, title string, status string")
    catalog.append("narratives", n(("a", "A", None), ("b", "B", "approved")))
    catalog.append("narratives", n())
    with pytest.raises(maintenance.KeyConflict):
        catalog.append("narratives", n(("a", "again", None)))
    with pytest.raises(maintenance.KeyConflict):
        catalog.append("narratives", n(("z", "1", None), ("z", "2", None)))
    assert rows(catalog.read("narratives"), "narrative_id", "status") == [("a", "proposed"), ("b", "approved")]
    before = {p: p.read_bytes() for p in (tmp_path / "cat" / "narratives").rglob("*.parquet")}
    catalog.append("narratives", n(("c", "C", None)))
    assert catalog.versions("narratives") == {1: True} and all(p.read_bytes() == old for p, old in before.items())
    catalog.upsert("narratives", n(("a", "A2", "rejected")))
    assert catalog.versions("narratives") == {1: True, 2: True}
    catalog.merge("narratives", n(("b", None, "scripted"), ("d", "D", "proposed")))
    catalog.insert_if_absent("narratives", n(("a", "never", "never"), ("e", "E", None)))
    assert rows(catalog.read("narratives"), "narrative_id", "title", "status") == [("a", "A2", "rejected"), ("b", "B", "scripted"), ("c", "C", "proposed"), ("d", "D", "proposed"), ("e", "E", "proposed")]
    patch = spark.createDataFrame([("a", None), ("zz", "x")], "narrative_id string, title string")
    assert catalog.update("narratives", patch) == 1
    with pytest.raises(ValueError, match="Disallowed"):
        catalog.update("narratives", patch.withColumnRenamed("title", "narrative_title"))
    catalog.delete("narratives", spark.createDataFrame([("b",), ("c",)], "narrative_id string"))
    assert rows(catalog.read("narratives"), "narrative_id", "title") == [("a", None), ("d", "D"), ("e", "E")]
    catalog.append("uploads", spark.createDataFrame([("a",), ("gone",)], "narrative_id string"))
    assert rows(catalog.rejects("uploads"), "narrative_id", "privacy_status", "reject_reason") == [("gone", "unlisted", "narrative_id not in narratives")]


def test_worklists(spark, rows):
    t = lambda cols, *r: spark.createDataFrame(list(r), cols)
    narratives = t("narrative_id string, status string", ("a", "approved"), ("b", "approved"), ("c", "proposed"))
    plans = t("narrative_id string, edl_json string, render_path string", ("a", "", "r"), ("b", "{}", None))
    tables = {"narratives": narratives, "edit_plans": plans, "narrative_scripts": t("narrative_id string", ("a",)), "uploads": t("narrative_id string"), "sourced": t("narrative_id string", ("b",))}
    todo = lambda stage, **k: rows(ingest.worklist(stage, tables, **k), "narrative_id")
    assert todo("script") == [("b",)] and todo("script", force=True) == [("a",), ("b",)]
    assert todo("edl") == [("a",)] and todo("render") == [("b",)] and todo("upload") == [("a",)] and todo("source") == [("a",)]
    files = {"files": t("media_id string", ("x",), ("y",)), "media": t("media_id string, status string", ("x", "ingested"), ("d", "duplicate"))}
    assert rows(ingest.worklist("ingest", files)) == [("y",)]
    analysed = {"media": files["media"], "transcripts": t("media_id string", ("x",)), "faces": t("media_id string")}
    assert rows(ingest.worklist("analyze", analysed)) == [("x", "faces")]


def test_browse(spark, rows):
    media = spark.createDataFrame([(i, f"/Trip/{'beach' if i % 2 else 'forest'}_{i}.mp4", "ingested" if i % 2 else "analyzed", None if i == 5 else f"2024-01-0{i}") for i in range(1, 6)], "media_id int, file_path string, status string, created_at string")
    page = lambda **k: [r.media_id for r in views.media_browser(media, {}, **k)[0].collect()]
    assert page() == [4, 3, 2, 1, 5] and page(order="asc") == [5, 1, 2, 3, 4] and page(sort="nope", order="sideways") == [4, 3, 2, 1, 5]
    assert page(q="BEACH", order="asc", sort="file_path") == [1, 3, 5] and page(q="b%_3") == [3]
    assert page(page=2, per_page=2) == [2, 1] and page(date_from="2024-01-02", date_to="2024-01-03") == [3, 2]
    assert views.media_browser(media, {}, status="analyzed")[1].first().total == 2


def test_fixed_fraction(spark):
    df = spark.range(1000)
    one = {r.id for r in filters.fixed_fraction(df, 0.1, ["id"]).collect()}
    assert len(one) == 100 and one == {r.id for r in filters.fixed_fraction(df.repartition(7), 0.1, ["id"]).collect()}
    assert filters.fixed_fraction(df, 0.00001, ["id"]).count() == 1 and filters.fixed_fraction(df, 1.0, ["id"]).count() == 1000


def test_small_expressions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(timecode.timecode_seconds(lit("01:02:03.500"))) == 3723.5
    for bad in ("1:2", "a:b:c", "", "1:2:3:4", "1.5:0:0"):
        assert one(timecode.timecode_seconds(lit(bad))) is None
    assert one(timecode.srt_stamp(lit(3661.9996))) == "01:01:01,999"
    assert one(timecode.duration_text(lit(None).cast("double"))) == "--:--" and one(timecode.duration_text(lit(3725.9))) == "1:02:05"
    for seconds, text in ((0, "0s"), (59, "59s"), (60, "1m"), (3599, "59m"), (3600, "1h0m"), (7260, "2h1m")):
        assert one(timecode.age_text(lit(float(seconds)))) == text
    assert one(documents.fenced_json(lit("a\n```\n {1} \n```"))) == "{1}" and one(documents.fenced_json(lit(" x "))) == "x"
    event = documents.flat_event_json(lit("t"), lit("s"), lit(None).cast("string"), lit('{"stage": "z", "n": 1}'))
    assert one(event) == '{"event_type":"t","job_id":null,"n":1,"stage":"z"}'
    blob = np.array([1.5, -2.0], dtype="<f4").tobytes()
    got = spark.createDataFrame([(bytearray(blob),), (bytearray(b"abc"),)], "b binary").select(decode_vectors("b").alias("v")).collect()
    assert got[0].v == [1.5, -2.0] and got[1].v is None


def test_search_paths_agree(spark, rows, tmp_path):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    data = []
    for i in range(400):
        v = centres[i % 20] + 0.1 * rng.normal(size=16)
        data.append((i, (v / np.linalg.norm(v)).tolist()))
    vectors = spark.createDataFrame(data, "id bigint, v array<float>")
    queries = vectors.filter("id % 10 = 0").select(F.col("id").alias("q"), F.transform("v", lambda x: x * 3).alias("qv"))
    near = exact_top_k(vectors, "id", "v", queries, "q", "qv", 5).cache()
    blocks = exact_top_k(vectors, "id", "v", queries, "q", "qv", 5, max_broadcast=7)
    assert rows(near, "q", "id", "rank") == rows(blocks, "q", "id", "rank") and near.count() == 200
    assert exact_top_k(vectors.limit(3), "id", "v", queries.limit(1), "q", "qv", 5).count() == 3
    few = search.build_index(vectors.limit(255), "v")
    assert few[0].count() == 255 and few[1].count() == 15  # an index whatever the size
    copies = vectors.filter("id = 5").select(F.explode(F.sequence(F.lit(5000), F.lit(5500))).alias("id"), "v")
    tied = exact_top_k(copies, "id", "v", queries.limit(2), "q", "qv", 4)
    assert rows(tied.groupBy("q").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids")) == [([5000, 5001, 5002, 5003],)] * 2
    assert search.build_index(vectors.limit(0), "v")[0].count() == 0
    indexed, centroids = search.build_index(vectors, "v")
    path = str(tmp_path / "index")
    assert write_index(indexed, centroids, path) and not write_index(indexed.limit(0), centroids, str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none")
    found = search.search(vectors, "id", "v", queries, "q", "qv", 5, read_index(spark, path), nprobe=4)
    assert recall(near, found, "q", "id").first().recall > 0.9


def test_zero_query_vector(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, v array<double>")
    got = exact_top_k(vectors, "id", "v", spark.createDataFrame([(0, [0.0, 0.0])], "q bigint, qv array<double>"), "q", "qv", 2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(1, 0.0), (2, 0.0)]


def test_queue_health(spark, rows):
    queue = spark.createDataFrame([("p", "pending", 10.0), ("p", "odd", 1.0), ("mem0_p", "completed", 1.0), ("q", "dead", 5.0), ("mem0_pp", "retry", 2.0)], "group_id string, status string, created_at double")
    summary, counts, bad = views.queue_health(queue, F.lit(70.0))
    assert summary.first().asDict() == {"total_rows": 5, "completed": 1, "in_flight": 0, "dead": 1, "retry": 1, "pending": 1, "healthy": False, "age_s": 68.0, "oldest_age": "1m"}
    assert rows(bad) == [("mem0_pp", 0, 1, 0), ("q", 1, 0, 0)]
    own, _, none = views.queue_health(queue, F.lit(70.0), "p")
    assert own.first().healthy and own.first().total_rows == 3 and rows(none) == []
    empty, _, _ = views.queue_health(queue.limit(0), F.lit(70.0))
    assert empty.first().healthy and empty.first().age_s is None and empty.first().total_rows == 0


def test_documents_on_disk(spark, tmp_path):
    lines = spark.createDataFrame([("d", i, f"line {i}") for i in range(100)] + [("e", 0, "only")], "doc string, n int, t string").repartition(5)
    write_lines(lines, "doc", ["n"], "t", str(tmp_path / "out"), partitions=3)
    parts = sorted((tmp_path / "out" / "doc=d").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == [f"line {i}" for i in range(100)]
    write_reports(lines.groupBy("doc").count(), "doc", str(tmp_path / "json"))
    assert '{"count":100}' in "".join(p.read_text() for p in (tmp_path / "json" / "doc=d").glob("*.json"))


def test_fixed_order(spark):
    df = spark.createDataFrame([("upload",), ("odd",), ("ingest",)], "stage string")
    assert [r.stage for r in topk.fixed_order(df, "stage", ["ingest", "upload"]).collect()] == ["ingest", "upload", "odd"]


def test_catalog_keeps_keys_clears_nulls_and_publishes_whole(spark, rows, tmp_path):
    tables = CatalogTables(spark, str(tmp_path / "catalog"))
    gate = lambda *r: spark.createDataFrame(list(r), "stage string, mode string, decided_by string")
    tables.append("pipeline_gates", gate(("narrate", "auto", "me"), ("render", "pause", None)))
    first = rows(tables.read("pipeline_gates"), "stage", "decided_by")
    assert first[0] == ("narrate", "me") and first[1][1] is not None  # a new row takes the default
    for change in (tables.upsert, tables.merge, tables.update):
        with pytest.raises(maintenance.KeyConflict):
            change("pipeline_gates", gate(("narrate", "auto", "a"), ("narrate", "auto", "b")))
    assert tables.update("pipeline_gates", gate(("narrate", "auto", "me")).withColumn("decided_by", F.lit(None).cast("string"))) == 1
    assert rows(tables.read("pipeline_gates").filter("stage = 'narrate'"), "decided_by") == [(None,)]
    before = rows(tables.read("pipeline_gates"), "stage", "mode", "decided_by")
    # a writer that died has left files, but no mark that its version is whole
    newest = max(tables.versions("pipeline_gates"))
    gate(("narrate", "x", "y"), ("upload", "x", "y")).write.parquet(str(tmp_path / "catalog" / "pipeline_gates" / f"version-{newest + 1}"))
    (tmp_path / "catalog" / "pipeline_gates" / f"version-{newest + 1}" / "_SUCCESS").unlink()
    assert rows(CatalogTables(spark, str(tmp_path / "catalog")).read("pipeline_gates"), "stage", "mode", "decided_by") == before
    tables.merge("pipeline_gates", gate(("upload", "x", None), ("narrate", None, "z")))
    assert rows(tables.read("pipeline_gates"), "stage", "mode", "decided_by")[0] == ("narrate", "auto", "z") and tables.read("pipeline_gates").count() == 3


def test_an_existing_column_is_left_alone(spark, rows):
    table = spark.createDataFrame([(1, None), (2, "x")], "id int, note string")
    assert rows(maintenance.evolve(table, "note", "string", "none")) == [(1, None), (2, "x")]
    assert rows(maintenance.evolve(table, "seen", "boolean", False), "id", "seen") == [(1, False), (2, False)]


def test_null_keys_reach_the_model(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, n int")
    out = score_in_order(df, "k", "n", lambda: lambda chunks: (c for c in chunks), "k string, n int")
    assert rows(out) == sorted([(None, 1), (None, 2), ("a", 1)], key=repr)
