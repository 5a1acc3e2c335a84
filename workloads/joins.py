"""Joins: titles, flags, worklists, signals on shots, references that do not resolve, tags, differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinelake.operators import relations
from cinelake.operators.intervals import not_contained
from cinelake.operators.tracks import gap_tracks, keyframe_gaps
from cinelake.functions.documents import json_strings
from cinelake.plans import edit_plans, ingest, publishing, storyboard, timeline, views
from workloads.registry import query
from workloads.views import Catalog


@query("join01_titles", """select u.narrative_id, n.title, s.script_json is not null as has_script from uploaded u left join narratives n using (narrative_id)
    left join scripts s using (narrative_id)""")
def titles(c: Catalog):
    titled = relations.with_titles(c.uploaded, c.narratives)
    return titled.join(relations.scripted_narratives(c.narratives, c.scripts).select("narrative_id", F.lit(True).alias("s")), "narrative_id", "left").select(
        "narrative_id", "title", F.coalesce("s", F.lit(False)).alias("has_script")
    )


@query("join02_signal_flags", """select media_id, media_id in (select media_id from segments) as has_transcript, media_id in (select media_id from detections) as has_detections,
    media_id in (select media_id from faces) as has_faces, media_id in (select media_id from vectors) as has_embeddings,
    media_id in (select media_id from audio_events) as has_audio_events, media_id in (select media_id from captions) as has_captions from media""")
def flags(c: Catalog):
    signals = {
        "has_transcript": c.segments, "has_detections": c.detections, "has_faces": c.faces,
        "has_embeddings": c.vectors.withColumn("media_id", F.col("media_id").cast("bigint")), "has_audio_events": c.audio_events, "has_captions": c.captions,
    }
    return relations.with_flags(c.media.select("media_id"), signals, "media_id")


@query("join03_pending_work", """select narrative_id from narratives where status = 'approved' and narrative_id in (select narrative_id from scripts)
    and narrative_id not in (select narrative_id from edit_plans where edl_json <> '')""")
def pending(c: Catalog):
    tables = {"narratives": c.narratives, "narrative_scripts": c.scripts, "edit_plans": c.edit_plans}
    return ingest.worklist("edl", tables).select("narrative_id")


@query("join04_media_detail", """with ids as (select doc_id as media_id from labels where toxic = 1), m as (select media_id from media where media_id in (select media_id from ids))
    select media_id, 'media' as part, 1::bigint as n from m
    union all select media_id, 'transcripts', count(*) from segments where media_id in (select media_id from m) group by media_id
    union all select media_id, 'faces', count(*) from faces where media_id in (select media_id from m) group by media_id
    union all select media_id, 'audio_events', count(*) from audio_events where media_id in (select media_id from m) group by media_id
    union all select media_id, 'face_clusters', count(distinct cluster_id) from faces join face_clusters using (cluster_id) where media_id in (select media_id from m) group by media_id""")
def detail(c: Catalog):
    ids = c.labels.filter("toxic = 1").select(F.col("doc_id").alias("media_id"))
    signals = {"transcripts": c.segments, "faces": c.faces, "audio_events": c.audio_events}
    rows = views.media_detail(c.media, signals, c.face_clusters, ids)
    return rows.groupBy("media_id", "part").agg(F.count("*").alias("n"))


@query("join05_members_signals", """select cluster_id, pos as clip_pos, media_id, ts_s, class from members join (select media_id, ts_s, class from audio_events) using (media_id)""")
def members_signals(c: Catalog):
    return storyboard.per_cluster(c.audio_events.select("media_id", "ts_s", "class"), c.members).select("cluster_id", "clip_pos", "media_id", "ts_s", "class")


@query("join06_segments_in_shots", """select s.media_id, shot_pos, pos from segments s join shots h on s.media_id = h.media_id and s.start_s < h.end_s and s.end_s > h.start_s""")
def segments_in_shots(c: Catalog):
    return storyboard.shot_transcripts(c.segments, c.shots).select("media_id", "shot_pos", "pos")


@query("join07_captions_in_shots", """select s.media_id, shot_pos, s.start_s as caption_start from captions s join shots h on s.media_id = h.media_id and s.start_s < h.end_s and s.end_s > h.start_s""")
def captions_in_shots(c: Catalog):
    return storyboard.shot_captions(c.captions, c.shots).select("media_id", "shot_pos", F.col("start_s").alias("caption_start"))


@query("join08_classes_in_shots", """select d.media_id, shot_pos, class, min(frame_number) as first_frame from detections d join shots h
    on d.media_id = h.media_id and frame_number between cast(floor(h.start_s*30) as bigint) and cast(floor(h.end_s*30) as bigint) group by all""")
def classes_in_shots(c: Catalog):
    pairs = storyboard.in_frames(c.detections, c.shots, c.media)
    return pairs.groupBy("media_id", "shot_pos", "class").agg(F.min("frame_number").alias("first_frame"))


@query("join09_people_in_shots", """select distinct f.media_id, shot_pos, coalesce(case when label <> '' then label end, 'Face #' || cast(f.cluster_id as varchar)) as person
    from faces f join shots h on f.media_id = h.media_id and frame_number between cast(floor(h.start_s*30) as bigint) and cast(floor(h.end_s*30) as bigint)
    left join face_clusters k on f.cluster_id = k.cluster_id where f.cluster_id is not null""")
def people_in_shots(c: Catalog):
    seen = storyboard.in_frames(c.faces, c.shots, c.media).filter("cluster_id is not null").select("media_id", "shot_pos", "cluster_id").distinct()
    return relations.with_face_labels(seen, c.face_clusters).select("media_id", "shot_pos", "person").distinct()


@query("join10_audio_in_shots", """select a.media_id, shot_pos, pos, class from audio_events a join shots h on a.media_id = h.media_id and ts_s between h.start_s and h.end_s""")
def audio_in_shots(c: Catalog):
    return storyboard.in_seconds(c.audio_events, c.shots).select("media_id", "shot_pos", "pos", "class")


@query("join11_listed_clusters", """with l as (select narrative_id, from_json(cluster_ids_json, '["VARCHAR"]') as ids from plans_of where json_valid(cluster_ids_json)),
    e as (select narrative_id, unnest(ids) as cluster_id, generate_subscripts(ids, 1) - 1 as pos from l)
    select narrative_id, cast(pos as bigint) as pos, cluster_id, description from e join clusters using (cluster_id)""")
def listed_clusters(c: Catalog):
    plans = c.plans_of.withColumn("ids", json_strings(F.col("cluster_ids_json")))
    out = relations.in_listed_order(plans, "narrative_id", "ids", c.clusters, "cluster_id")
    return out.select("narrative_id", F.col("pos").cast("bigint").alias("pos"), "cluster_id", "description")


@query("join12_face_labels", """select media_id, frame_number, face_index, coalesce(case when label <> '' then label end, 'Face #' || cast(f.cluster_id as varchar)) as person
    from faces f left join face_clusters k on f.cluster_id = k.cluster_id where f.cluster_id is not null""")
def face_labels(c: Catalog):
    return relations.with_face_labels(c.faces.filter("cluster_id is not null"), c.face_clusters).select("media_id", "frame_number", "face_index", "person")


GAPS = """k as (select distinct media_id, frame_number from detections), g as (select media_id, frame_number as f0, lead(frame_number) over (partition by media_id order by frame_number) as f1 from k),
    b as (select media_id, frame_number, track_id, arg_max(class, pos) as class, arg_max(cx, pos) as cx, arg_max(confidence, pos) as confidence from detections group by all)"""


@query("join13_tracks_at_gap_ends", f"""with {GAPS}, p as (select g.media_id, g.f0, b.track_id, b.cx as cx0, b.class as c0, cast(null as double) as cx1, cast(null as varchar) as c1 from g join b on g.media_id = b.media_id and g.f0 = b.frame_number where f1 - f0 > 1
    union all select g.media_id, g.f0, b.track_id, null, null, b.cx, b.class from g join b on g.media_id = b.media_id and g.f1 = b.frame_number where f1 - f0 > 1)
    select media_id, f0 as gap, coalesce(cast(track_id as varchar), '-') as track, coalesce(max(cx0), -1) as cx0, coalesce(max(cx1), -1) as cx1, coalesce(max(c0), max(c1)) as class from p group by all""")
def gap_ends(c: Catalog):
    size = c.detections.groupBy("media_id").agg((F.max("frame_number") + 1).alias("total_frames")).withColumn("step", F.lit(3).cast("bigint"))
    pairs = gap_tracks(c.boxes, keyframe_gaps(c.detections, size))
    x = lambda side: F.coalesce(F.col(f"{side}.bbox_xywh")[0], F.lit(-1.0))
    return pairs.select(
        "media_id", "gap", F.coalesce(F.col("track_id").cast("string"), F.lit("-")).alias("track"), x("before").alias("cx0"), x("after").alias("cx1"),
        F.coalesce("before.class", "after.class").alias("class"),
    )


@query("join14_keyframe_before_after", f"""with {GAPS}, r as (select media_id, f0, coalesce(f1, f0 + 4) as f1 from g)
    select media_id, f0, coalesce(f1, -1) as f1, unnest(generate_series(f0 + 1, f1 - 1)) as frame_number from g where f1 is not null""")
def before_after(c: Catalog):
    size = c.detections.groupBy("media_id").agg((F.max("frame_number") + 1).alias("total_frames")).withColumn("step", F.lit(1_000_000).cast("bigint"))
    gaps = keyframe_gaps(c.detections, size).filter("kind = 'between'")
    return gaps.withColumn("frame_number", F.explode(F.sequence("frame_from", "frame_to"))).select("media_id", "f0", "f1", "frame_number")


@query("join15_missing_clips", "select distinct narrative_id, clip_id from plan_clips where clip_id not in (select clip_id from clip_media)")
def missing_clips(c: Catalog):
    return relations.unresolved(c.plan_clips.select("narrative_id", "clip_id").distinct(), c.clip_media, ["clip_id"]).join(
        c.plan_clips.select("narrative_id", "clip_id").distinct(), "clip_id"
    ).select("narrative_id", "clip_id")


@query("join16_clip_bounds", """select narrative_id, 'Clip ' || cast(clip_id as varchar) || ': out_timecode (' || printf('%.3f', out_s) || ') exceeds clip duration (' || printf('%.1f', duration_seconds) || 's)' as message
    from plan_clips join clip_media using (clip_id) where in_s < out_s and out_s > duration_seconds
    union all select narrative_id, 'Clip ' || cast(clip_id as varchar) || ': in_timecode (' || printf('%.3f', in_s) || ') exceeds clip duration (' || printf('%.1f', duration_seconds) || 's)' as message
    from plan_clips join clip_media using (clip_id) where in_s < out_s and in_s > duration_seconds""")
def bounds(c: Catalog):
    clips = c.plan_clips.withColumns({"in_timecode": F.format_string("%.3f", "in_s"), "out_timecode": F.format_string("%.3f", "out_s")})
    return edit_plans.clip_issues(clips, c.clip_media).select("narrative_id", "message")


@query("join17_uncovered_gaps", """select s.media_id, pos from segments s where not exists (select 1 from shots h where h.media_id = s.media_id and h.start_s <= s.start_s and h.end_s >= s.end_s)""")
def uncovered(c: Catalog):
    return not_contained(c.segments, c.shots, ["media_id"], ("start_s", "end_s"), ("start_s", "end_s"), 60.0).select("media_id", "pos")


@query("join18_rendered_not_uploaded", "select narrative_id from edit_plans where render_path <> '' and narrative_id not in (select narrative_id from uploaded)")
def not_uploaded(c: Catalog):
    return relations.not_uploaded(c.edit_plans, c.uploaded).select("narrative_id")


CROPS = """modes as (select l_orderkey as narrative_id, l_partkey as clip_id, arg_max(case l_returnflag when 'A' then 'auto_subject' when 'R' then 'center' else 'manual_offset' end, l_suppkey * 10 + l_linenumber) as mode from lineitem group by all)"""


@query("join21_render_inputs", f"""with {CROPS}, j as (select p.narrative_id, p.pos, p.clip_id, coalesce(m.mode, 'center') as mode, k.clip_id is not null as known, k.duration_seconds > 25 as has_crop
    from plan_clips p left join modes m on p.narrative_id = m.narrative_id and p.clip_id = m.clip_id left join clip_media k on p.clip_id = k.clip_id)
    select narrative_id, pos, clip_id, case when mode = 'auto_subject' then 'slow' else 'fast' end as route,
    coalesce(case when not known then 'no media record' when mode = 'auto_subject' and not has_crop then 'no crop path for slow clip' end, '') as reason from j""")
def render_inputs(c: Catalog):
    modes = c.lineitem.select(
        F.col("l_orderkey").alias("narrative_id"), F.col("l_partkey").alias("clip_id"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.when(F.col("l_returnflag") == "A", "auto_subject").when(F.col("l_returnflag") == "R", "center").otherwise("manual_offset").alias("mode"),
        F.lit(None).cast("bigint").alias("subject_track_id"),
    )
    clips = c.plan_clips.withColumns({"source_path": F.lit(None).cast("string"), "overlay": F.lit(None).cast("string")})
    media = c.clip_media.withColumn("file_path", F.concat(F.lit("f"), F.col("clip_id").cast("string")))
    tracks = c.clip_media.filter("duration_seconds > 25").select("clip_id", F.lit(0).cast("bigint").alias("subject_track_id"))
    good, bad = timeline.render_inputs(clips, media, modes, tracks)
    route = F.when(F.col("reason") == "no crop path for slow clip", "slow")
    rejected = bad.join(modes.groupBy("narrative_id", "clip_id").agg(F.max_by("mode", "pos").alias("mode")), ["narrative_id", "clip_id"], "left").select(
        "narrative_id", "pos", "clip_id", F.coalesce(route, F.when(F.col("mode") == "auto_subject", "slow").otherwise("fast")).alias("route"), "reason"
    )
    return good.select("narrative_id", "pos", "clip_id", "route", F.lit("").alias("reason")).unionByName(rejected)


@query("join22_upload_tags", """with l as (select narrative_id, from_json(cluster_ids_json, '["VARCHAR"]') as ids from plans_of where json_valid(cluster_ids_json)),
    e as (select narrative_id, unnest(ids) as cluster_id, generate_subscripts(ids, 1) - 1 as pos from l),
    t as (select narrative_id, string_agg(label, ',' order by pos) as tags from e join clusters using (cluster_id) where coalesce(label, '') <> '' group by narrative_id)
    select o.narrative_id, concat_ws(',', tags, (select string_agg(class, ',' order by class) from (select distinct class from detections))) as tags from plans_of o left join t using (narrative_id)""")
def tags(c: Catalog):
    narratives = c.plans_of.withColumns({"ids": json_strings(F.col("cluster_ids_json")), "title": F.lit("t"), "description": F.lit("")})
    return publishing.upload_metadata(narratives, "ids", c.scripts, c.clusters, publishing.catalog_classes(c.detections)).select("narrative_id", "tags")


@query("join23_timeline_diff", """with p as (select narrative_id, track, clip_id, in_s, out_s from plan_clips),
    a as (select narrative_id, clip_id, arg_max(in_s, k) as in_s, arg_max(out_s, k) as out_s from (select narrative_id, clip_id, in_s + case when pos % 3 = 0 then 0.5 else 0 end as in_s, out_s,
        pos * 1000000 + in_s * 1000 + level_db + out_s / 1000 as k, pos from plan_clips where level_db > -25) group by all),
    pn as (select narrative_id, count(*) as n, count(distinct track) as t from plan_clips group by 1), an as (select narrative_id, count(*) as n, count(distinct track) as t from plan_clips where level_db > -25 group by 1)
    select narrative_id, clip_id, 'missing' as change, round(in_s, 3) as planned, -1.0::double as actual from p where not exists (select 1 from a where a.narrative_id = p.narrative_id and a.clip_id = p.clip_id)
    union all select p.narrative_id, p.clip_id, 'start', round(p.in_s, 3), round(a.in_s, 3) from p join a on a.narrative_id = p.narrative_id and a.clip_id = p.clip_id where abs(a.in_s - p.in_s) > 0.05
    union all select p.narrative_id, p.clip_id, 'duration', round(p.out_s - p.in_s, 3), round(a.out_s - a.in_s, 3) from p join a on a.narrative_id = p.narrative_id and a.clip_id = p.clip_id where abs((a.out_s - a.in_s) - (p.out_s - p.in_s)) > 0.05
    union all select narrative_id, null, kind, planned, actual from (select narrative_id, 'clip_count' as kind, pn.n::double as planned, coalesce(an.n, 0)::double as actual from pn left join an using (narrative_id)
        union all select narrative_id, 'track_count', pn.t, coalesce(an.t, 0) from pn left join an using (narrative_id)) where planned <> actual""")
def diff(c: Catalog):
    planned = c.plan_clips.select("narrative_id", "track", "clip_id", "pos", "in_s", "out_s")
    place = F.col("pos") * 1000000 + F.col("in_s") * 1000 + F.col("level_db") + F.col("out_s") / 1000
    moved = c.plan_clips.filter("level_db > -25").withColumns({"__k": place, "new_in": F.col("in_s") + F.when(F.col("pos") % 3 == 0, 0.5).otherwise(0.0)})
    actual = moved.select("narrative_id", "track", "clip_id", F.col("__k").alias("pos"), F.col("new_in").alias("in_s"), "out_s")
    out = timeline.timeline_diff(planned, actual)
    return out.select("narrative_id", "clip_id", "change", F.round("planned", 3).alias("planned"), F.round(F.coalesce("actual", F.lit(-1.0)), 3).alias("actual"))
