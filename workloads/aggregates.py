"""Aggregates over signals, jobs, queues and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinelake.operators import summaries
from cinelake.plans import activities, edit_plans, storyboard, views
from workloads.registry import query
from workloads.views import Catalog


def signals(c: Catalog) -> dict:
    return {"segments": c.segments, "captions": c.captions, "detections": c.detections, "faces": c.faces, "audio": c.audio_events}


@query("agg01_duplicate_groups", """select sha256(text) as digest, min(doc_id) as kept_id, count(*) as n_copies from documents group by 1 having count(*) > 1""")
def duplicate_groups(c: Catalog):
    hashed = c.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    return summaries.duplicate_groups(hashed, "digest", "doc_id", "doc_id")


TOP = """select cluster_id, string_agg(class || ' (' || cast(n as varchar) || ')', ', ' order by n desc, first_pos, class) as top from (
    select cluster_id, class, count(*) as n, min([m.pos, {place}, d.pos]) as first_pos, row_number() over (partition by cluster_id order by count(*) desc, min([m.pos, {place}, d.pos]), class) as rn
    from members m join {table} d using (media_id) group by cluster_id, class) where rn <= {n} group by cluster_id"""


@query("agg02_top_classes", TOP.format(place="frame_number", table="detections", n=3))
def top_classes(c: Catalog):
    rows = storyboard.per_cluster(c.detections, c.members)
    return summaries.top_classes(rows, ["cluster_id"], "class", ["clip_pos", "frame_number", "pos"], 3, "top")


@query("agg03_cluster_transcripts", """with r as (select cluster_id, text, row_number() over (partition by cluster_id order by m.pos, s.pos) as n from members m join segments s using (media_id))
    select cluster_id, cast((n - 1) // 8 as bigint) as page, string_agg(text, ' ' order by n) as transcripts from r group by all""")
def transcripts(c: Catalog):
    return storyboard.cluster_transcripts(c.segments, c.members, page_rows=8)


@query("agg03_highlights", """with r as (select cluster_id, text, row_number() over (partition by cluster_id order by m.pos, s.pos) as n, count(*) over (partition by cluster_id) as n_segments from members m join segments s using (media_id))
    select cluster_id, string_agg(text, ' | ' order by n) as highlights, max(n_segments) as n_segments from r where n <= 5 group by cluster_id""")
def highlights(c: Catalog):
    from cinelake.operators.text import joined_in_order
    from cinelake.operators.topk import top_k

    rows = storyboard.per_cluster(c.segments, c.members)
    five = top_k(rows, ["cluster_id"], [F.col("clip_pos"), F.col("pos")], 5)
    counted = rows.groupBy("cluster_id").agg(F.count("*").alias("n_segments"))
    return five.groupBy("cluster_id").agg(joined_in_order(F.col("rank"), F.col("text"), " | ").alias("highlights")).join(counted, "cluster_id")


@query("agg04_confidence_notes", """select media_id, round(ac::decimal(28,14), 6)::double as avg_conf, mc as min_conf,
    'Avg detection confidence: ' || printf('%.2f', ac) || case when mc < 0.5 then '; Some low-confidence frames (min: ' || printf('%.2f', mc) || ') - possible motion blur or poor framing' else '' end
    || case when ac >= 0.8 then '; Overall good visual quality' when ac >= 0.6 then '; Moderate visual quality' else '; Low visual quality - many unclear frames' end as visual_quality_notes
    from (select media_id, sum((confidence/100)::decimal(28,9))::double / count(confidence) as ac, min(confidence/100) as mc from detections group by media_id)""")
def notes(c: Catalog):
    out = summaries.confidence_notes(c.detections, ["media_id"], F.col("confidence") / 100)
    return out.withColumn("avg_conf", F.round(F.col("avg_conf").cast("decimal(28,14)"), 6).cast("double"))


@query("agg05_footage_duration", """select cluster_id, round(s, 4) as total_s, printf('%.0f', s) || 's (' || printf('%.1f', s / 60) || ' min)' as duration_text
    from (select cluster_id, sum(duration_seconds::decimal(25,6))::double as s from members join media using (media_id) group by cluster_id)""")
def footage(c: Catalog):
    rows = c.members.join(c.media.select("media_id", "duration_seconds"), "media_id")
    return summaries.footage_duration(rows, ["cluster_id"], F.col("duration_seconds")).withColumn("total_s", F.round("total_s", 4))


@query("agg06_people", """select cl as cluster_id, string_agg(person, ', ' order by fc) as people from (select distinct m.cluster_id as cl, f.cluster_id as fc,
    coalesce(case when label <> '' then label end, 'Face #' || cast(f.cluster_id as varchar)) as person from members m join faces f using (media_id) left join face_clusters k on k.cluster_id = f.cluster_id
    where f.cluster_id is not null) group by cl""")
def people_present(c: Catalog):
    from cinelake.operators.relations import with_face_labels
    from cinelake.operators.text import joined_in_order

    faces = storyboard.per_cluster(c.faces.withColumnRenamed("cluster_id", "fc"), c.members).filter("fc is not null")
    met = faces.select(F.col("cluster_id").alias("cl"), F.col("fc").alias("cluster_id")).distinct()
    named = with_face_labels(met, c.face_clusters)
    return named.groupBy(F.col("cl").alias("cluster_id")).agg(joined_in_order(F.col("cluster_id"), F.col("person"), ", ").alias("people"))


@query("agg07_envelopes", """select user_id as activity, epoch(min(ts)) as time_start_s, epoch(max(ts)) as time_end_s, coalesce(round(avg(case when event_type <> 'error' then 18.0 + (user_id % 5)*0.01 end), 6), -1) as gps_center_lat,
    count(*) as n_clips, min(event_id) as first_id from events group by user_id""")
def envelopes(c: Catalog):
    rows = c.activities.join(c.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("activity")), "id")
    timed = rows.withColumn("ts_s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return activities.envelopes(timed).select("activity", "time_start_s", "time_end_s", F.coalesce(F.round("gps_center_lat", 6), F.lit(-1.0)).alias("gps_center_lat"), "n_clips", "first_id")


@query("agg08_mean_vectors", """select media_id, d as dim, round(avg(x), 5) as value from (select label as media_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as d from embeddings) group by all""")
def mean_vectors(c: Catalog):
    means = summaries.mean_vectors(c.vectors, ["media_id"], "embedding")
    return means.select("media_id", F.posexplode("mean_vector").alias("dim", "value")).select("media_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 5).alias("value"))


@query("agg10_subject_track", """select media_id, arg_max(track_id, [area, -first_pos]) as track_id, round(max(area), 4) as area from (select media_id, track_id, sum(w*h) as area, min(pos) as first_pos from detections where track_id is not null group by all) group by media_id""")
def subject(c: Catalog):
    return summaries.subject_track(c.boxes, ["media_id"], ["pos"]).withColumn("area", F.round("area", 4))


@query("agg11_detection_summary", """with f as (select media_id, count(distinct frame_number) as frame_count from detections group by media_id)
    select media_id, frame_count, sum(n)::bigint as total_detections, count(*) as n_classes, arg_max(class, [lpad(cast(n as varchar), 12, '0'), class]) as top_class from f join (select media_id, class, count(*) as n from detections group by all) using (media_id) group by all""")
def detection_summary(c: Catalog):
    return summaries.detection_summary(c.detections.select("media_id", "frame_number").distinct(), c.detections)


@query("agg11_class_counts", "select media_id, coalesce(class, 'unknown') as class, count(*) as n from detections group by all")
def class_counts(c: Catalog):
    return summaries.boxes_per_class(c.detections)


@query("agg12_faces_per_cluster", "select media_id, coalesce(cluster_id, -1) as cluster_id, count(*) as n from faces group by all")
def faces(c: Catalog):
    return summaries.faces_per_cluster(c.faces).withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1).cast("bigint")))


@query("agg13_vector_coverage", """with v as (select label::bigint as media_id, count(*) as n from embeddings group by 1)
    select media_id, coalesce(n, 0) as embedding_count, cast(floor(fps*duration_seconds) as bigint) as total_frames, case when floor(fps*duration_seconds) > 0 then round(coalesce(n, 0) / floor(fps*duration_seconds) * 100, 1) else 0.0 end as coverage_pct from media left join v using (media_id)""")
def coverage(c: Catalog):
    return summaries.vector_coverage(c.media, c.vectors.withColumn("media_id", F.col("media_id").cast("bigint")))


STAGE_SQL = """select stage, count(*) as total, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'running') as running, count(*) filter (status = 'done') as done, count(*) filter (status = 'error') as error"""


@query("agg14_jobs_by_status", f"{STAGE_SQL}, run_id from jobs group by stage, run_id")
def by_status(c: Catalog):
    return summaries.jobs_by_status(c.jobs, ["stage", "run_id"])


@query("agg14_stage_state", f"""select s.stage, coalesce(total, 0) as total, coalesce(done, 0) as done, case when coalesce(error, 0) > 0 then 'error' when coalesce(running, 0) > 0 then 'running' when coalesce(total, 0) = 0 then 'idle' when done = total then 'done' else 'waiting' end as state
    from (select distinct user_id % 12 as stage from events) s left join ({STAGE_SQL} from jobs group by stage) using (stage)""")
def stage_state(c: Catalog):
    stages = c.events.select((F.col("user_id") % 12).alias("stage")).distinct()
    return summaries.stage_progress(stages, summaries.jobs_by_status(c.jobs)).select("stage", "total", "done", "state")


@query("agg14_overall_progress", "select count(*) as total_jobs, count(*) filter (status = 'done') as total_done, cast(floor(count(*) filter (status = 'done') / count(*) * 100) as bigint) as progress_pct from jobs")
def overall(c: Catalog):
    return summaries.overall_progress(summaries.jobs_by_status(c.jobs))


@query("agg15_queue_health", """select count(*) as total_rows, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'in_flight') as in_flight, count(*) filter (status = 'dead') as dead,
    count(*) filter (status = 'retry') as retry, count(*) filter (status = 'pending') as pending, count(*) filter (status in ('dead', 'retry')) = 0 as healthy from queue""")
def queue_health(c: Catalog):
    return summaries.queue_summary(summaries.queue_counts(c.queue)).select("total_rows", "completed", "in_flight", "dead", "retry", "pending", "healthy")


@query("agg15_unhealthy_groups", """select group_id, count(*) filter (status = 'dead') as dead, count(*) filter (status = 'retry') as retry, count(*) filter (status = 'pending') as pending from queue group by group_id
    having count(*) filter (status in ('dead', 'retry')) > 0""")
def bad_groups(c: Catalog):
    return summaries.unhealthy_groups(summaries.queue_counts(c.queue))


@query("agg16_oldest_unhealthy", "select 1800000000.0 - epoch(min(created_at)) as age_s from queue where status in ('pending', 'retry', 'dead')")
def oldest(c: Catalog):
    queue = c.queue.withColumn("created_at", F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6)
    return summaries.oldest_unhealthy_age(queue, F.lit(1_800_000_000.0))


@query("agg17_review_counts", """select 'narrate' as stage, count(*) as pending_count, 'proposed narratives' as pending_label from narratives where status = 'proposed'
    union all select 'classify', count(*), 'activity clusters' from clusters where not excluded
    union all select 'render', count(*), 'pending renders' from edit_plans where render_path = ''
    union all select 'upload', count(*), 'pending uploads' from edit_plans where render_path <> '' and narrative_id not in (select narrative_id from uploaded)""")
def review_counts(c: Catalog):
    gates = c.spark.createDataFrame([(s, "waiting") for s in ("narrate", "classify", "render", "upload")], "stage string, status string")
    return views.review_hub(gates, c.narratives, c.clusters, c.edit_plans, c.uploaded)


MERGE = """req as (select o_orderkey as request_id, 0 as pos, 'c' || cast(o_custkey % 25 as varchar) as cluster_id from orders union all select o_orderkey, 1, 'c' || cast(o_orderkey % 30 as varchar) from orders where o_orderstatus <> 'P'),
    sz as (select cluster_id, count(*) as n from members group by cluster_id), j as (select request_id, pos, r.cluster_id, c.cluster_id is not null as known, coalesce(n, 0) as n, time_start, time_end from req r left join clusters c using (cluster_id) left join sz using (cluster_id)),
    g as (select request_id, count(*) as k, count(*) filter (not known) as u, arg_max(cluster_id, [n, -pos]) as survivor_id, min(time_start) as time_start, max(time_end) as time_end from j group by request_id)"""


def _requests(c: Catalog):
    name = lambda e: F.concat(F.lit("c"), e.cast("string"))
    first = c.orders.select(F.col("o_orderkey").alias("request_id"), F.lit(0).alias("pos"), name(F.col("o_custkey") % 25).alias("cluster_id"))
    second = c.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("request_id"), F.lit(1).alias("pos"), name(F.col("o_orderkey") % 30).alias("cluster_id"))
    return first.unionByName(second)


@query("agg18_merge_clusters", f"""with {MERGE} select request_id, case when k >= 2 and u = 0 then survivor_id else '' end as survivor_id, case when k >= 2 and u = 0 then time_start else '' end as time_start,
    case when k >= 2 and u = 0 then time_end else '' end as time_end, case when k < 2 then 'at least 2 cluster ids required' when u > 0 then 'unknown cluster id' else '' end as reason from g""")
def merge(c: Catalog):
    merged, rejects = activities.merge_clusters(c.clusters, c.members, _requests(c))
    e = F.lit("")
    return merged.withColumn("reason", e).unionByName(rejects.select("request_id", e.alias("survivor_id"), e.alias("time_start"), e.alias("time_end"), "reason"))


@query("agg18_merged_members", f"""with {MERGE}, d as (select request_id, pos, cluster_id from req), m as (select distinct on (survivor_id) survivor_id, request_id from g where k >= 2 and u = 0 order by survivor_id, request_id)
    select survivor_id, media_id, min([d.pos, members.pos])[1]::bigint as request_pos, min([d.pos, members.pos])[2]::bigint as clip_pos from m join d using (request_id) join members using (cluster_id) group by all""")
def merge_members(c: Catalog):
    merged, _ = activities.merge_clusters(c.clusters, c.members, _requests(c))
    # One request per survivor: a cluster can be merged once.
    one = merged.groupBy("survivor_id").agg(F.min("request_id").alias("request_id"))
    out = activities.merged_members(c.members, _requests(c), one)
    return out.select("survivor_id", "media_id", F.col("place.request_pos").cast("bigint").alias("request_pos"), F.col("place.pos").alias("clip_pos"))


@query("agg19_duration_vs_target", """select narrative_id, round(coalesce(sum(out_s - in_s) filter (track = 1), 0), 4) as total_s, any_value(target_s) as target_s from narratives left join plan_clips using (narrative_id) where target_s > 0 group by narrative_id
    having coalesce(sum(out_s - in_s) filter (track = 1), 0) < any_value(target_s) * 0.9 or coalesce(sum(out_s - in_s) filter (track = 1), 0) > any_value(target_s) * 1.1""")
def off_target(c: Catalog):
    issues = edit_plans.duration_issues(c.plan_clips, c.narratives.select("narrative_id", "target_s"))
    totals = c.plan_clips.filter("track = 1").groupBy("narrative_id").agg(F.sum(F.col("out_s") - F.col("in_s")).alias("total_s"))
    return issues.select("narrative_id").join(c.narratives.select("narrative_id", "target_s"), "narrative_id").join(totals, "narrative_id", "left").select(
        "narrative_id", F.round(F.coalesce("total_s", F.lit(0.0)), 4).alias("total_s"), "target_s"
    )


@query("agg22_run_outcomes", """select run_id, count(*) as n_stages, count(*) filter (status = 'done') as n_done, count(*) filter (status = 'error' or (status = 'pending' and stage < 4)) as n_errored, round(sum(duration_seconds), 4) as elapsed_seconds,
    case when bool_or(status = 'error' or (status = 'pending' and stage < 4)) then 'failed' else 'completed' end as verdict from jobs group by run_id""")
def outcomes(c: Catalog):
    stages = c.jobs.select("run_id", F.when(F.col("status") == "pending", "skipped").otherwise(F.col("status")).alias("status"), (F.col("stage") < 4).alias("dependency_failed"), F.col("duration_seconds").alias("elapsed_seconds"))
    return summaries.run_outcomes(stages).withColumn("elapsed_seconds", F.round("elapsed_seconds", 4))


@query("agg23_group_centre", "select media_id, frame_number, (min(cx) + max(cx)) / 2 as centre_x, (min(cy) + max(cy)) / 2 as centre_y from detections group by all")
def centre(c: Catalog):
    return summaries.group_centre(c.boxes, ["media_id", "frame_number"], 608.0, 1080.0)


@query("agg24_clip_counts", "select narrative_id, case when json_valid(cluster_ids_json) then 2 else 0 end::bigint as clip_count from plans_of")
def clip_counts(c: Catalog):
    from cinelake.functions.documents import json_items

    return c.plans_of.select("narrative_id", F.size(json_items(F.col("cluster_ids_json"))).cast("bigint").alias("clip_count"))


@query("agg25_catalog_classes", "select distinct class from detections")
def classes(c: Catalog):
    from cinelake.plans.publishing import catalog_classes

    return catalog_classes(c.detections)


@query("agg26_bytes_saved", "select count(*) as n_duplicates, sum(n_chars)::bigint as bytes_saved from (select n_chars, row_number() over (partition by text order by doc_id) as rn from documents) where rn > 1")
def saved(c: Catalog):
    from cinelake.plans.ingest import duplicate_pairs

    hashed = c.documents.select("doc_id", "n_chars", F.sha2("text", 256).alias("digest"))
    pairs = duplicate_pairs(hashed, "digest", "doc_id", "doc_id").select(F.col("duplicate_id").alias("doc_id"))
    return summaries.bytes_saved(hashed.join(pairs, "doc_id", "left_semi"), "n_chars")


@query("agg27_stage_throughput", """select stage, count(*) as total, count(*) filter (status = 'done') as done, round(sum(duration_seconds) filter (status = 'done'), 4) as elapsed_s, round(count(*) filter (status = 'done') / sum(duration_seconds) filter (status = 'done'), 6) as per_second,
    round((count(*) - count(*) filter (status = 'done')) / (count(*) filter (status = 'done') / sum(duration_seconds) filter (status = 'done')), 4) as eta_s from jobs group by stage""")
def throughput(c: Catalog):
    out = summaries.stage_throughput(c.jobs)
    return out.select("stage", "total", "done", F.round("elapsed_s", 4).alias("elapsed_s"), F.round("per_second", 6).alias("per_second"), F.round("eta_s", 4).alias("eta_s"))


@query("agg28_track_summary", """select media_id, coalesce(track_id, -1) as track_id, arg_min(class, [frame_number, pos]) as class, min(frame_number) as first_frame, max(frame_number) as last_frame, count(*) as n_boxes from detections group by media_id, track_id""")
def track_summary(c: Catalog):
    return summaries.track_summary(c.detections).withColumn("track_id", F.coalesce("track_id", F.lit(-1).cast("bigint")))


@query("agg29_dominant_event", """select media_id, cast(floor(ts_s / 10) as bigint) as slot, arg_max(class, [probability, -ts_s, -pos]) as class, max(probability) as probability from audio_events group by all""")
def dominant(c: Catalog):
    return summaries.dominant_event(c.audio_events, 10.0)
