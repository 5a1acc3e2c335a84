"""Edit plans, timelines, storyboards, prompts, checks."""

import pytest
from pyspark.sql import functions as F

from cinelake.plans import assets, edit_plans, prompts, publishing, render_qa, storyboard, timeline
from cinelake.sources import signals

MEDIA = "clip_id string, duration_seconds string"


def verdict(spark, edl, media=(("c1", "120"), ("c2", "120"))):
    plans = spark.createDataFrame([("n", edl)], "narrative_id string, edl_json string")
    verdicts, issues = edit_plans.validate_edl(plans, spark.createDataFrame(list(media), MEDIA))
    return verdicts.first(), sorted(r.message for r in issues.collect())


def clip(cid, a, b, **more):
    extra = "".join(f', "{k}": {v}' for k, v in more.items())
    return f'{{"clip_id": "{cid}", "in_timecode": "{a}", "out_timecode": "{b}"{extra}}}'


def edl(*clips, target=None, audio=""):
    t = "" if target is None else f', "target_duration_seconds": {target}'
    return '{"clips": [' + ", ".join(clips) + '], "audio_settings": [' + audio + "]" + t + "}"


def test_clean_plan_passes(spark):
    got, issues = verdict(spark, edl(clip("c1", "00:00:00.000", "00:00:10.000", track=1), clip("c2", "00:00:10.000", "00:00:20.000", track=1), target=20))
    assert got.passed and issues == []


def test_overlap_message(spark):
    got, issues = verdict(spark, edl(clip("c1", "00:00:00.000", "00:00:10.000"), clip("c2", "00:00:08.000", "00:00:20.000")))
    assert not got.passed
    assert issues == ["Overlap on track 1: clip ends at 00:00:10.000 but next clip starts at 00:00:08.000"]


def test_other_tracks_do_not_overlap(spark):
    got, _ = verdict(spark, edl(clip("c1", "00:00:00.000", "00:00:10.000", track=1), clip("c2", "00:00:08.000", "00:00:20.000", track=2)))
    assert got.passed


def test_duration_off_target(spark):
    _, issues = verdict(spark, edl(clip("c1", "00:00:00.000", "00:00:10.000"), target=20))
    assert issues == ["Total duration 10.0s is outside ±10% of target 20.0s (allowed: 18.0–22.0s)"]


def test_unknown_clip_once(spark):
    _, issues = verdict(spark, edl(clip("zz", "00:00:00.000", "00:00:01.000"), clip("zz", "00:00:02.000", "00:00:03.000")))
    assert issues == ["Clip not found in catalog: zz"]


def test_bounds(spark):
    _, issues = verdict(spark, edl(clip("c1", "00:02:10.000", "00:02:20.000"), clip("c2", "00:00:05.000", "00:00:05.000")))
    assert issues == [
        "Clip c1: in_timecode (00:02:10.000) exceeds clip duration (120.0s)",
        "Clip c1: out_timecode (00:02:20.000) exceeds clip duration (120.0s)",
        "Clip c2: in_timecode (00:00:05.000) must be before out_timecode (00:00:05.000)",
    ]


def test_unreadable_timecodes(spark):
    _, issues = verdict(spark, edl('{"clip_id": "c1", "in_timecode": "0:10", "out_timecode": "00:00:10.000"}', target=5))
    assert "Clip c1: invalid or missing in_timecode in overlap check" in issues
    assert "Clip c1: invalid or missing timecode in duration check" in issues
    assert "Clip c1: invalid or missing timecode" in issues


def test_non_numeric_duration(spark):
    _, issues = verdict(spark, edl(clip("c1", "00:00:00.000", "00:00:01.000")), media=[("c1", "long")])
    assert issues == ["Clip c1: non-numeric duration_seconds in catalog"]


@pytest.mark.parametrize("level, passed, text", [('"loud"', False, "non-numeric level_db value 'loud'"), ("3", False, "3.0 dB exceeds 0 dB"), ("-30.5", True, "-30.5 dB is below -24 dB"), ("null", True, None), ("0", True, None)])
def test_audio_levels(spark, level, passed, text):
    got, issues = verdict(spark, edl(audio=f'{{"clip_id": "c1", "level_db": {level}}}'))
    assert got.passed is passed
    assert (issues == []) if text is None else (text in issues[0])


def test_feedback_pages_and_attempts(spark):
    issues = spark.createDataFrame([("n", "warning", "audio", "w1"), ("n", "error", "overlap", "e1"), ("n", "error", "bounds", "e2"), ("m", "error", "bounds", "x")], "narrative_id string, severity string, check string, message string")
    subjects = issues.select("narrative_id")
    v = edit_plans.verdicts(subjects, issues)
    attempts = spark.createDataFrame([("n", 1), ("m", 4)], "narrative_id string, attempt int")
    got = edit_plans.edl_feedback(v, issues, attempts).collect()
    assert len(got) == 1
    assert got[0].feedback == "\n\nThe EDL you generated has validation errors. Please fix these issues and regenerate the EDL:\n\n**Errors:**\n- e2\n- e1\n\n**Warnings:**\n- w1"
    paged = edit_plans.edl_feedback(v, issues, attempts, page_rows=2).orderBy("page").collect()
    assert "\n".join(r.feedback for r in paged) == got[0].feedback


def _seed(spark):
    media = spark.createDataFrame([("v1", 30.0, 60.0), ("v2", 30.0, 90.0), ("v3", None, 12.0)], "media_id string, fps double, duration_seconds double")
    boundaries = spark.createDataFrame([("v1", '[{"start_time": 0, "end_time": 30}, {"start_time": 30, "end_time": 60}]', "a"), ("v2", '[{"start_frame": 0, "end_frame": 2699}]', "a"), ("v3", "broken", "a")], "media_id string, boundaries_json string, method string")
    transcripts = spark.createDataFrame([("v1", '[{"start": 5, "end": 8, "text": "hello"}, {"start": 29, "end": 38, "text": "across"}, {"text": "no time"}, 7]', "en"), ("v2", "nope", "en")], "media_id string, segments_json string, language string")
    detections = spark.createDataFrame([("v1", 0, '[{"class": "person", "confidence": 0.9}]'), ("v1", 900, '[{"class": "dog"}, {"class": "person"}, {"noclass": 1}]'), ("v2", 0, "x")], "media_id string, frame_number bigint, detections_json string")
    faces = spark.createDataFrame([("v1", 0, 0, 1), ("v1", 0, 1, None), ("v1", 30, 0, 9)], "media_id string, frame_number bigint, face_index int, cluster_id bigint")
    audio = spark.createDataFrame([("v1", 5.0, '[{"class": "speech", "probability": 0.9}]'), ("v1", 30.0, '[{"class": "music"}]')], "media_id string, timestamp_seconds double, events_json string")
    captions = spark.createDataFrame([("v1", 0.0, 30.0, "a road"), ("v1", 30.0, 60.0, "a hill"), ("v1", None, 9.0, "lost")], "media_id string, start_s double, end_s double, caption string")
    people = spark.createDataFrame([(1, "Alice")], "cluster_id bigint, label string")
    rows = {"segments": signals.transcript_segments(transcripts), "captions": captions, "detections": signals.detection_boxes(detections).filter("class is not null"), "faces": faces, "audio": signals.audio_classes(audio)}
    return media, signals.shots(boundaries, media), rows, people


def test_shots_fall_back(spark, rows):
    _, shots, _, _ = _seed(spark)
    assert rows(shots) == [("v1", 0, 0.0, 30.0), ("v1", 1, 30.0, 60.0), ("v2", 0, 0.0, 90.0), ("v3", 0, 0.0, 12.0)]


def test_storyboard(spark):
    media, shots, tables, people = _seed(spark)
    got = {(r.media_id, r.shot_pos): r for r in storyboard.shot_signals(shots, media, tables, people).collect()}
    first, second = got["v1", 0], got["v1", 1]
    assert (first.transcript, first.visual, first.objects, first.people, first.audio) == ("hello across", "a road", "person, dog", "Alice, Face #9", "speech, music")
    # Frame 900 and second 30 are on the boundary, so they belong to both shots.
    assert (second.transcript, second.visual, second.objects, second.people, second.audio) == ("across", "a hill", "dog, person", None, "music")
    assert got["v2", 0].transcript is None

    clusters = spark.createDataFrame([("c1", "Walk", "A walk"), ("c2", None, None)], "cluster_id string, label string, description string")
    members = spark.createDataFrame([("c1", 0, "v2"), ("c1", 1, "v1")], "cluster_id string, pos int, media_id string")
    narratives = spark.createDataFrame([("n1", ["c1", "gone", "c2"])], "narrative_id string, ids array<string>")
    lines = storyboard.narrative_storyboard(narratives, "ids", clusters, members, storyboard.shot_signals(shots, media, tables, people)).orderBy("cluster_pos", "shot_number", "page").collect()
    assert [(r.cluster_pos, r.shot_number) for r in lines] == [(0, 0), (0, 1), (0, 2), (0, 3), (2, 0)]
    assert lines[0].text == "## Cluster: c1 — Walk\nDescription: A walk"
    assert lines[2].text == "### Shot 2 (Clip: v1)\n- Duration: 30.0s\n- Source: v1 [0.0s – 30.0s]\n- Transcript: hello across\n- Visual: a road\n- Objects: person, dog\n- People: Alice, Face #9\n- Audio: speech, music"
    assert lines[4].text == "## Cluster: c2 — Unlabeled"


def test_parse_responses(spark, rows):
    responses = spark.createDataFrame([("a", '```json\n{"label": "L", "description": "D"}\n```'), ("b", '{"label": "L"}'), ("c", "no json"), ("d", "[1]")], "target_id string, response string")
    good, bad = prompts.parse_labels(responses)
    assert rows(good, "cluster_id", "label", "description", "split_recommended") == [("a", "L", "D", False)]
    assert rows(bad, "target_id", "error") == [("b", "missing description"), ("c", "not JSON"), ("d", "wrong shape")]

    entry = '{"title": "T", "activity_cluster_ids": ["c"], "proposed_duration_seconds": 60, "arc": {"beginning": "B"}, "reasoning": "R"}'
    good, bad = prompts.parse_narratives(spark.createDataFrame([("a", f"[{entry}, {entry}]"), ("b", f'[{entry}, {{"title": 1}}]'), ("c", "[7]"), ("d", "[]"), ("e", "{}")], "target_id string, response string"))
    assert rows(good, "title", "proposed_duration_seconds", "description", "status") == [("T", 60.0, "R", "proposed")] * 2
    assert rows(bad, "target_id", "error") == [("b", "missing activity_cluster_ids, proposed_duration_seconds"), ("c", "entry is no object"), ("e", "wrong shape")]
    text = prompts.review_text(good.limit(1).withColumn("number", F.lit(1))).first().text
    assert text == "--- Narrative 1 ---\n  Title: T\n  Duration: 60s (1.0 min)\n  Clusters: c\n  Arc:\n    Beginning: B\n  Reasoning: R"

    good, bad = prompts.parse_scripts(spark.createDataFrame([("a", '{"scenes": []}'), ("b", "{}")], "target_id string, response string"))
    assert rows(good) == [("a", '{"scenes": []}')] and rows(bad, "target_id", "error") == [("b", "missing scenes")]


def test_render_qa(spark, rows):
    renders = spark.createDataFrame(
        [("ok", 60.0, 60.5, 1920, 1080, "h264", 10 * 1048576), ("bad", 60.0, 70.0, 1280, 720, "hevc", 20 * 1048576)],
        "render_id string, duration_seconds double, target_s double, width bigint, height bigint, codec string, size_bytes bigint",
    )
    logs = spark.createDataFrame(
        [("ok", '{"input_i" : "-14.5"}', "", "silence_start: 1\nx silence_end: 4 | silence_duration: 3"), ("bad", "nothing", "black_start:1 black_end:2 black_duration:1", "silence_start: 1\nsilence_end: 4.5 | silence_duration: 3.5")],
        "render_id string, loudness_log string, black_log string, silence_log string",
    )
    intended = spark.createDataFrame([("ok", 0.0, 5.0), ("bad", 2.0, 9.0)], "render_id string, start double, end double")
    verdicts, issues = render_qa.render_qa(renders, logs, intended)
    assert rows(verdicts, "render_id", "passed", "n_errors", "n_warnings", "lufs", "file_size_mb") == [("bad", False, 4, 3, None, 20.0), ("ok", True, 0, 0, -14.5, 10.0)]
    messages = {r.message for r in issues.collect()}
    assert "Silence detected: 1.0s–4.5s (duration: 3.5s)" in messages
    assert "Black frame detected: 1s–2s (duration: 1s)" in messages
    assert "File size 20.0 MB (20.0 MB/min) exceeds expected maximum of 15 MB/min" in messages


def test_subtitles_and_timeline(spark, rows):
    clips = spark.createDataFrame([("n", 0, "a", 10.0, 15.0), ("n", 1, "b", 0.0, None), ("n", 2, "a", 0.0, 2.0)], "narrative_id string, pos bigint, clip_id string, in_s double, out_s double")
    segments = spark.createDataFrame([("a", 0, 1.0, 2.5, "hi")], "clip_id string, pos bigint, start_s double, end_s double, text string")
    got = timeline.subtitles(clips, segments).orderBy("cue").collect()
    assert [r.srt for r in got] == ["1\n00:00:01,000 --> 00:00:02,500\nhi\n", "2\n00:00:06,000 --> 00:00:07,500\nhi\n"]

    full = clips.withColumns({"track": F.lit(1).cast("bigint"), "out_s": F.coalesce("out_s", F.lit(1.0))})
    media = spark.createDataFrame([("a", "a.mp4", 25.0)], "clip_id string, file_path string, fps double")
    marks = spark.createDataFrame([("n", "dissolve", "0", None, None, 0), ("n", "cut", "1", 2.0, None, 1), ("n", "wipe", "9", 1.0, None, 2), ("n", None, "1", 1.0, None, 3), ("n", "fade_in", "2", 4.0, None, 4)], "narrative_id string, type string, position string, duration double, track bigint, pos bigint")
    placed, transitions = timeline.timeline_rows(full, media, marks)
    assert rows(placed, "place", "clip_id", "target", "fps") == [(0, "b", "b", 30.0), (1, "a", "a.mp4", 25.0), (2, "a", "a.mp4", 25.0)]
    assert rows(transitions, "place", "type", "transition_type", "in_offset_s") == [(0, "dissolve", "SMPTE_Dissolve", 0.25), (1, "", "SMPTE_Dissolve", 0.5), (2, "fade_in", "SMPTE_Dissolve", 2.0)]
    assert [r.place for r in transitions.filter("approximation is not null").collect()] == [2]
    silent = timeline.subtitles(clips, segments.withColumn("text", F.lit(None).cast("string")))
    assert [r.srt for r in silent.orderBy("cue").collect()][0] == "1\n00:00:01,000 --> 00:00:02,500\n\n"

    same = timeline.timeline_diff(full.filter("clip_id = 'b'"), full.filter("clip_id = 'b'"))
    assert rows(same) == []
    moved = full.filter("clip_id = 'b'").withColumns({"in_s": F.lit(0.04), "out_s": F.lit(2.0)})
    assert rows(timeline.timeline_diff(full.filter("clip_id = 'b'"), moved), "change") == [("duration",)]
    assert rows(timeline.timeline_diff(full, moved), "change", "clip_id", "planned", "actual") == sorted(
        [("missing", "a", 10.0, None), ("missing", "a", 0.0, None), ("duration", "b", 1.0, 1.96), ("clip_count", None, 3.0, 1.0)], key=repr
    )
    a, b = timeline.plan_hashes(full).first().edl_hash, timeline.plan_hashes(full.withColumn("in_s", F.col("in_s") + 1)).first().edl_hash
    assert a != b and a == timeline.plan_hashes(full.repartition(3)).first().edl_hash


def test_fetch_list(spark):
    plans = spark.createDataFrame([("n", '{"music": [{"mood": "calm", "duration": 31}], "voiceovers": [{"text": "hi"}], "broll_requests": [{"description": "sea", "duration": 3}]}')], "narrative_id string, edl_json string")
    lines = [r.line for r in assets.fetch_list_lines(assets.asset_requests(plans)).orderBy("kind_pos", "pos").collect()]
    assert lines[:2] == ["# Unresolved Asset Fetch List", ""] and len(lines) == 7
    assert lines[4:] == [
        "| Music | calm | 00:00:00.000 | 31.0s | Freesound, MusicGen, AudioJungle | High |",
        "| Voiceover | hi | 00:00:00.000 | 0.0s | Kokoro TTS, ElevenLabs, manual recording | High |",
        "| B-Roll | sea | 00:00:00.000 | 3.0s | Pexels, Pixabay, Artgrid | Medium |",
    ]


def test_upload_metadata(spark):
    narratives = spark.createDataFrame([("n", "T", "D", ["c2", "c1", "zz"]), ("m", None, None, [])], "narrative_id string, title string, description string, ids array<string>")
    scripts = spark.createDataFrame([("n", '{"scenes": [{"narration": "one"}, {"x": 1}, {"narration": "two"}]}')], "narrative_id string, script_json string")
    clusters = spark.createDataFrame([("c1", "Walk"), ("c2", "Swim"), ("c3", "No")], "cluster_id string, label string")
    classes = publishing.catalog_classes(spark.createDataFrame([("person",), ("dog",), ("dog",), (None,)], "class string"))
    got = {r.narrative_id: r for r in publishing.upload_metadata(narratives, "ids", scripts, clusters, classes).collect()}
    assert (got["n"].title, got["n"].description, got["n"].tags) == ("T", "D\n\none two", "Swim,Walk,dog,person")
    assert (got["m"].title, got["m"].description, got["m"].tags) == ("m", "", "dog,person")


def test_sums_of_confidences_and_durations_do_not_depend_on_row_order(spark, rows):
    from cinelake.operators.summaries import confidence_notes, footage_duration

    values = [0.1] * 10 + [0.7] * 3 + [1e-7, 2.3, 0.05] * 7
    table = spark.createDataFrame([(k, v) for k, vs in (("up", sorted(values)), ("down", sorted(values)[::-1]), ("none", [None])) for v in vs], "k string, v double").coalesce(1)
    mean = {r.k: r.avg_conf for r in confidence_notes(table, ["k"], F.col("v")).collect()}
    assert mean["up"] == mean["down"] == (1.0 + 2.1 + 7e-7 + 16.1 + 0.35) / 34 and mean["none"] is None
    # 5,000,000 tenths and a half: the sum sits on a tie that any error moves.
    tenths = spark.range(0, 50_000, 1, 1).select(F.lit("a").alias("k"), F.lit(0.1).alias("v")).unionByName(spark.createDataFrame([("a", 0.5)], "k string, v double"))
    assert rows(footage_duration(tenths, ["k"], F.col("v")), "total_s", "duration_text") == [(5000.5, "5000s (83.3 min)")]
    odd = spark.createDataFrame([("a", 1e25), ("a", 1.0), ("b", float("nan")), ("b", 1.0)], "k string, v double")
    assert [r.total_s for r in footage_duration(odd, ["k"], F.col("v")).orderBy("k").collect()][0] == 1e25


def test_half_a_byte_decides_on_the_size_rule_as_its_sql_says(spark, tmp_path):
    """A size of 2097151.5 bytes is 2097151: below 8 MB a minute over 15 s, which 2097152 is not."""
    import duckdb

    from workloads import load

    queries, oracles = load()
    orders = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    spark.createDataFrame([(1, 5, "O", 41943.03, "1-URGENT"), (2, 5, "O", 41943.04, "1-URGENT")], orders).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    for name in ("job14_render_qa", "agg21_render_issue_counts"):
        df = queries[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(df.columns)} from ({oracles[name]}) where {'n > 0' if 'n' in df.columns else 'true'}").fetchall()
        assert sorted(tuple(r) for r in df.collect()) == sorted(want), name


def test_narrative_responses_are_judged_without_a_join(spark, rows):
    responses = spark.createDataFrame([("a", "[7]"), ("b", '[{"title": "t", "activity_cluster_ids": [], "proposed_duration_seconds": 2}]')], "target_id string, response string")
    good, bad = prompts.parse_narratives(responses)
    assert rows(good, "target_id", "title") == [("b", "t")] and rows(bad, "target_id", "error") == [("a", "entry is no object")]
    for df in (good, bad):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan


def test_sections_of_clusters_are_those_of_every_narrative(spark, rows):
    media, shots, tables, people = _seed(spark)
    clusters = spark.createDataFrame([("c1", "Walk", "A walk"), ("c2", None, None)], "cluster_id string, label string, description string")
    members = spark.createDataFrame([("c1", 0, "v2"), ("c1", 1, "v1"), ("gone", 0, "v1")], "cluster_id string, pos int, media_id string")
    narratives = spark.createDataFrame([("n1", ["c1", "gone", "c2"]), ("n2", ["c1", "c1"])], "narrative_id string, ids array<string>")
    shot_rows = storyboard.shot_signals(shots, media, tables, people)
    whole = storyboard.narrative_storyboard(narratives, "ids", clusters, members, shot_rows)
    counts = whole.groupBy("narrative_id", "cluster_pos", "cluster_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    once = storyboard.cluster_storyboards(clusters, members, shot_rows)
    assert once.count() == 5
    sections = once.groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    assert rows(storyboard.listed_sections(narratives, "ids", sections)) == rows(counts) and counts.count() == 4


def test_found_assets_are_merged_not_broadcast(spark):
    wanted = spark.createDataFrame([(1, "Music", 0), (2, "Music", 0)], "narrative_id bigint, kind string, pos bigint")
    found = spark.createDataFrame([(1, "Music", 0, "m.wav")], "narrative_id bigint, kind string, pos bigint, path string")
    out = assets.resolve_assets(wanted, found)
    assert sorted((r.narrative_id, r.resolved_path) for r in out.collect()) == [(1, "m.wav"), (2, None)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
