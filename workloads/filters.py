"""Selections, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinelake.operators import filters, topk
from cinelake.operators.relations import unresolved
from cinelake.operators.text import first_seen
from cinelake.plans.assets import best_variant
from cinelake.plans.publishing import rank_thumbnails
from cinelake.plans.views import media_browser
from workloads.registry import query
from workloads.views import Catalog


@query("flt01_lookup_composite", "select media_id, frame_number, pos, class from detections where media_id = 7 and frame_number = 30")
def lookup(c: Catalog):
    return filters.lookup(c.detections, media_id=7, frame_number=30).select("media_id", "frame_number", "pos", "class")


@query("flt02_by_status", "select media_id, file_path from media where status = 'analyzed'")
def by_status(c: Catalog):
    return filters.lookup(c.media, status="analyzed").select("media_id", "file_path")


@query("flt03_frame_range", "select media_id, frame_number, pos from detections where frame_number between 9 and 27")
def frame_range(c: Catalog):
    return filters.between(c.detections, "frame_number", 9, 27).select("media_id", "frame_number", "pos")


@query("flt04_with_vector", "select vec_id from embeddings where embedding is not null")
def with_vector(c: Catalog):
    return filters.with_vector(c.embeddings, "embedding", "vec_id").select("vec_id")


@query("flt05_by_ids", "select media_id, file_path from media where media_id in (select doc_id from labels where toxic = 1)")
def by_ids(c: Catalog):
    ids = c.labels.filter("toxic = 1").select(F.col("doc_id").alias("media_id"))
    return filters.by_ids(c.media, ids, "media_id").select("media_id", "file_path")


@query("flt06_optional_filters", "select job_id, stage, status from jobs where status = 'error' and stage = 4")
def optional(c: Catalog):
    return filters.optional_filters(c.jobs, stage=4, status="error", run_id=None).select("job_id", "stage", "status")


@query("flt07_browse_predicate", "select media_id, file_path from media where lower(file_path) like '%_/en/%' and status = 'ingested'")
def browse_filter(c: Catalog):
    return c.media.filter(filters.browse_predicate(q="_/EN/", status="ingested")).select("media_id", "file_path")


@query("flt08_without_binaries", "select vec_id, label from embeddings")
def slim(c: Catalog):
    return filters.without_binaries(c.embeddings)


@query("flt09_project_scope", "select cast(group_id as varchar) as group_id, status from queue where cast(group_id as varchar) in ('7', 'mem0_7')")
def scope(c: Catalog):
    return filters.project_scope(c.queue.withColumn("group_id", F.col("group_id").cast("string")), "7").select("group_id", "status")


@query("flt10_state_filters", """select 'activity' as kind, cluster_id as id from clusters where coalesce(label, '') = ''
    union all select 'face', cast(cluster_id as varchar) from face_clusters where label is null
    union all select 'open', cluster_id from clusters where not coalesce(excluded, false)
    union all select 'media', cast(media_id as varchar) from media where status <> 'duplicate'""")
def states(c: Catalog):
    pick = lambda df, kind, ident: df.select(F.lit(kind).alias("kind"), F.col(ident).cast("string").alias("id"))
    return (
        pick(filters.unlabelled_activities(c.clusters), "activity", "cluster_id")
        .unionByName(pick(filters.unlabelled_faces(c.face_clusters), "face", "cluster_id"))
        .unionByName(pick(filters.not_excluded(c.clusters), "open", "cluster_id"))
        .unionByName(pick(filters.not_duplicate(c.media), "media", "media_id"))
    )


@query("flt11_caption_candidates", "select media_id, 0.0::double as start_time, duration_seconds as end_time from media where duration_seconds > 0")
def caption_candidates(c: Catalog):
    return filters.caption_candidates(c.media, "media_id")


@query("flt12_fixed_fraction", """select media_id, status from (select media_id, status, row_number() over (order by md5(cast(media_id as varchar) || ':3'), media_id) as place, count(*) over () as n from media)
    where place <= greatest(1, floor(n * 0.25))""")
def fraction(c: Catalog):
    return filters.fixed_fraction(c.media.select("media_id", "status"), 0.25, ["media_id"], seed=3)


@query("flt12_sample_size", "select cast(greatest(1, floor(count(*) * 0.1)) as bigint) as n_rows, cast(greatest(1, floor(count(*) * 0.1)) as bigint) as n_distinct from events")
def sample_size(c: Catalog):
    taken = filters.fixed_fraction(c.events.select("event_id"), 0.1, ["event_id"])
    return taken.agg(F.count("*").alias("n_rows"), F.countDistinct("event_id").alias("n_distinct"))


@query("top01_browse_page", """select media_id, status, duration_seconds, media_id in (select media_id from segments) as has_transcript,
    media_id in (select media_id from detections) as has_detections, media_id in (select media_id from audio_events) as has_audio_events
    from media where status = 'ingested' order by duration_seconds desc, media_id limit 50 offset 50""")
def browse(c: Catalog):
    signals = {"transcripts": c.segments, "detections": c.detections, "audio_events": c.audio_events}
    page, _ = media_browser(c.media, signals, status="ingested", sort="duration_seconds", page=2)
    return page.select("media_id", "status", "duration_seconds", "has_transcript", "has_detections", "has_audio_events")


@query("top01_browse_total", "select count(*) as total from media where lower(file_path) like '%/en/%'")
def browse_total(c: Catalog):
    return media_browser(c.media, {}, q="/en/", sort="file_path")[1]


@query("top02_newest_runs", """select run_id, n_jobs, last_job from (select run_id, count(*) as n_jobs, max(job_id) as last_job from jobs group by run_id)
    order by last_job desc limit 1""")
def newest_runs(c: Catalog):
    runs = c.jobs.groupBy("run_id").agg(F.count("*").alias("n_jobs"), F.max("job_id").alias("last_job"))
    return topk.page_of(runs, [F.col("last_job").desc()], 1, 1)


@query("top03_gate_order", "select stage, mode, case stage when 8 then 1 when 0 then 2 when 4 then 3 else 999 end as place from gates")
def gate_order(c: Catalog):
    ordered = topk.fixed_order(c.gates, "stage", [8, 0, 4])
    at = F.array_position(F.array(*[F.lit(x).cast("bigint") for x in (8, 0, 4)]), F.col("stage"))
    return ordered.withColumn("place", F.when(at > 0, at).otherwise(F.lit(999)).cast("int"))


@query("top06_best_frame", """with b as (select media_id, frame_number, greatest(0.0, 1 - least(
        sqrt((cx-20)*(cx-20)+(cy-40)*(cy-40)), sqrt((cx-40)*(cx-40)+(cy-40)*(cy-40)), sqrt((cx-20)*(cx-20)+(cy-80)*(cy-80)),
        sqrt((cx-40)*(cx-40)+(cy-80)*(cy-80))) / sqrt(20.0*20+40.0*40)) as thirds, confidence from detections),
    f as (select media_id, frame_number, 0.3 * least(0.01 * frame_number, 1.0) + 0.3 * max(thirds) + 0.4 * max(confidence) as score
        from b group by media_id, frame_number)
    select media_id as video_id, arg_max(frame_number, [score, -frame_number]) as frame_number, round(max(score), 6) as score from f group by media_id""")
def best_frame(c: Catalog):
    boxes = c.boxes.withColumnRenamed("media_id", "video_id")
    frames = boxes.select("video_id", "frame_number").distinct().withColumns(
        {"sharpness": F.col("frame_number") * 0.01, "width": F.lit(60.0), "height": F.lit(120.0)}
    )
    return rank_thumbnails(frames, boxes).withColumn("score", F.round("score", 6))


@query("top07_best_variant", """select l_orderkey as asset_id, quality, width, pos from (select l_orderkey, case when l_returnflag = 'A' then 'hd' else 'sd' end as quality,
    l_quantity as width, l_partkey * 100000 + l_suppkey * 10 + l_linenumber as pos,
    row_number() over (partition by l_orderkey order by (l_returnflag = 'A') desc, l_quantity desc, l_partkey * 100000 + l_suppkey * 10 + l_linenumber) as rn from lineitem) where rn = 1""")
def variants(c: Catalog):
    files = c.lineitem.select(
        F.col("l_orderkey").alias("asset_id"), F.when(F.col("l_returnflag") == "A", "hd").otherwise("sd").alias("quality"), F.col("l_quantity").alias("width"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    return best_variant(files)


@query("set02_id_difference", "select distinct narrative_id from rendered where narrative_id not in (select narrative_id from uploaded)")
def id_difference(c: Catalog):
    return unresolved(c.rendered, c.uploaded, ["narrative_id"])


@query("set03_ordered_distinct", """select media_id, class, min(pos) as first_pos from detections group by media_id, class""")
def ordered_distinct(c: Catalog):
    return first_seen(c.detections, ["media_id"], "class", ["pos"]).select("media_id", "class", F.col("first_place.pos").alias("first_pos"))
