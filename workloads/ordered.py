"""Ordered computations: keepers, splits, overlaps, gap filling, smoothing, offsets, numbers, tiles, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.operators import ordered
from cinelake.operators.skew import row_number_across
from cinelake.operators.topk import top_k
from cinelake.plans.ingest import duplicate_pairs
from workloads.registry import query
from workloads.views import Catalog


@query("win01_duplicate_pairs", """select first_value(doc_id) over w as kept_id, doc_id as duplicate_id from documents window w as (partition by text order by doc_id) qualify row_number() over w > 1""")
def keepers(c: Catalog):
    return duplicate_pairs(c.documents.select("doc_id", F.sha2("text", 256).alias("digest")), "digest", "doc_id", "doc_id")


@query("win02_vector_breaks", """with d as (select label, vec_id, list_cosine_distance(lag(embedding::double[]) over (partition by label order by vec_id), embedding::double[]) > 1.0 as far from embeddings)
    select label, vec_id, cast(sum(coalesce(far, false)::int) over (partition by label order by vec_id) as bigint) as part from d""")
def breaks(c: Catalog):
    rows = c.embeddings.withColumn("seg", F.floor(F.col("vec_id") / 64))
    return ordered.vector_breaks(rows, ["label"], "seg", ["vec_id"], "embedding", 1.0, "part").select("label", "vec_id", "part")


@query("win03_adjacent_overlaps", """select narrative_id, track, in_s, out_s, next_start from (select *, lead(in_s) over (partition by narrative_id, track order by in_s, pos, clip_id, out_s, level_db) as next_start from plan_clips) where out_s > next_start""")
def overlaps(c: Catalog):
    out = ordered.with_next_clip(c.plan_clips, ["narrative_id", "track"], "in_s", ["pos", "clip_id", "out_s", "level_db"])
    return out.filter("out_s > next_start").select("narrative_id", "track", "in_s", "out_s", "next_start")


PATH = """p as (select media_id, class, frame, x from (select media_id, class, unnest(generate_series(0, n))::bigint as frame from (select distinct media_id, class from detections) join
    (select media_id, max(frame_number) // 3 as n from detections group by media_id) using (media_id)) left join
    (select media_id, class, frame_number // 3 as frame, max(cx) as x from detections group by all) using (media_id, class, frame))"""
FILLED = f"""{PATH}, l as (select *, last_value(case when x is not null then frame end ignore nulls) over w as lf, last_value(x ignore nulls) over w as lx from p window w as (partition by media_id, class order by frame rows unbounded preceding)),
    q as (select *, frame - coalesce(lf, -1) - 1 as into_gap, coalesce(lx, 50.0) as v from l),
    f as (select media_id, class, frame, case when x is not null then x when into_gap < 1 then v when into_gap < 3 then v + (into_gap - 1) / 2.0 * (50.0 - v) else 50.0 end as x from q)"""
TRACK = ["media_id", "class"]


def _path(c: Catalog) -> DataFrame:
    """Every class of a media over all frames of that media."""
    boxes = c.detections.select(*TRACK, F.floor(F.col("frame_number") / 3).cast("bigint").alias("frame"), "cx")
    seen = boxes.groupBy(*TRACK, "frame").agg(F.max("cx").alias("x"))
    last = boxes.groupBy("media_id").agg(F.max("frame").alias("last"))
    frames = boxes.select(*TRACK).distinct().join(last, "media_id").select(*TRACK, F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("frame"))
    return frames.join(seen, [*TRACK, "frame"], "left").withColumn("y", F.col("x"))


def _filled(c: Catalog) -> DataFrame:
    mid = F.lit(50.0)
    return ordered.fill_gaps(_path(c), TRACK, "frame", "x", "y", F.lit(1.0), mid, mid, hold_s=1.0, drift_s=2.0, segment_frames=8)


@query("win04_gap_fill", f"with {FILLED} select media_id, class, frame, round(x, 6) as x from f")
def gap_fill(c: Catalog):
    return _filled(c).select(*TRACK, "frame", F.round("x", 6).alias("x"))


@query("win05_smoothing", f"""with recursive {FILLED}, a as (select 1 - exp(-1.0 / 3.0) as alpha), s as (select media_id, class, frame, x as s from f where frame = 0
    union all select f.media_id, f.class, f.frame, s.s + alpha * (f.x - s.s) from s join f on f.media_id = s.media_id and f.class = s.class and f.frame = s.frame + 1, a)
    select media_id, class, frame, round(s, 6) as s from s""")
def smoothing(c: Catalog):
    alpha = ordered.smoothing_alpha(F.lit(3.0), F.lit(1.0))
    return ordered.smooth(_filled(c), TRACK, "frame", ["x"], alpha).select(*TRACK, "frame", F.round("x", 6).alias("s"))


@query("win06_timeline_offsets", """select narrative_id, pos, clip_id, round(coalesce(sum(out_s - in_s) over (partition by narrative_id order by pos, clip_id, in_s, out_s, level_db, track rows between unbounded preceding and 1 preceding), 0), 4) as offset_s from plan_clips""")
def offsets(c: Catalog):
    tie = ["clip_id", "in_s", "out_s", "level_db", "track"]
    out = ordered.timeline_offsets(c.plan_clips, ["narrative_id"], "pos", tie, F.col("out_s") - F.col("in_s"))
    return out.select("narrative_id", "pos", "clip_id", F.round("offset_s", 4).alias("offset_s"))


@query("win07_shot_numbers", """select cluster_id, media_id, shot_pos, row_number() over (partition by cluster_id order by pos, shot_pos) as shot_number from members join shots using (media_id)""")
def shot_numbers(c: Catalog):
    rows = c.members.join(c.shots, "media_id").withColumn("seg", F.floor(F.col("pos") / 2))
    return row_number_across(rows, ["cluster_id"], "seg", ["pos", "shot_pos"], "shot_number").select("cluster_id", "media_id", "shot_pos", "shot_number")


@query("win08_tiles", """select event_type as media_id, event_id // 250 as tile, count(*) as n_samples, round(sum(value), 4) as total, 250 - count(*) as n_padding from events group by all""")
def tiles(c: Catalog):
    samples = c.events.select(F.col("event_type").alias("media_id"), F.col("event_id").alias("i"), "value")
    return ordered.tiles(samples, "media_id", "i", "value", 250).withColumn("total", F.round("total", 4))


@query("win09_top_classes_per_tile", """select media_id, tile, class, probability, rank from (select media_id, cast(floor(ts_s / 10) as bigint) as tile, class, probability, row_number() over (partition by media_id, floor(ts_s / 10) order by probability desc, pos) as rank from audio_events) where rank <= 3""")
def top_per_tile(c: Catalog):
    rows = c.audio_events.withColumn("tile", F.floor(F.col("ts_s") / 10).cast("bigint"))
    return top_k(rows, ["media_id", "tile"], [F.col("probability").desc(), F.col("pos").asc()], 3).select("media_id", "tile", "class", "probability", "rank")


@query("win10_first_method", "select conv_id as media_id, arg_min(role, turn) as method from conversations group by conv_id")
def first_method(c: Catalog):
    return ordered.first_method(c.conversations.select(F.col("conv_id").alias("media_id"), F.col("role").alias("method"), "turn"), ["media_id"], ["turn"])


SESSION = """select camera, event_id as id, cast(sum(coalesce(gap > {gap}, false)::int) over (partition by camera order by ts, event_id) as bigint) as session from
    (select {camera} as camera, event_id, ts, (epoch_us(ts) - epoch_us(lag(ts) over (partition by {camera} order by ts, event_id))) / 1e6 as gap from events)"""


def _clips(c: Catalog, camera) -> DataFrame:
    return c.events.select(camera.alias("camera"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts_s"))


@query("win11_sessions_per_camera", SESSION.format(gap=1800, camera="user_id % 5"))
def sessions(c: Catalog):
    return ordered.sessions(_clips(c, F.col("user_id") % 5), ["camera"], "ts_s", 1800.0, "id", "session").select("camera", "id", "session")


@query("win11_sessions_all", SESSION.format(gap=120, camera="0"))
def all_sessions(c: Catalog):
    return ordered.sessions(_clips(c, F.lit(0)), ["camera"], "ts_s", 120.0, "id", "session", rows_per_segment=2000).select("camera", "id", "session")


@query("win12_crop_jumps", f"with {FILLED}, j as (select media_id, class, frame, abs(x - lag(x) over (partition by media_id, class order by frame)) as jump from f) select media_id, class, frame, round(jump, 6) as jump from j where jump > 100 * 0.02")
def jumps(c: Catalog):
    out = ordered.crop_jumps(_filled(c), TRACK, "frame", "x", F.lit(100.0), segment_frames=8)
    return out.select(*TRACK, "frame", F.round("jump", 6).alias("jump"))


@query("win12_subject_inside", f"with {FILLED} select media_id, class, round(avg((x between 30 and 70)::int), 6) as inside_share, avg((x between 30 and 70)::int) > 0.9 as meets_target from f group by media_id, class")
def inside(c: Catalog):
    return ordered.subject_inside(_filled(c), TRACK, F.col("x").between(30, 70)).withColumn("inside_share", F.round("inside_share", 6))


@query("win13_sliding_breaks", """with v as (select label, vec_id, (vec_id * 20) // 60 * 60 - 60 * k as w, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as d from embeddings, (select unnest([0, 1, 2, 3, 4]) as k)),
    m as (select label, w, d, avg(x) as x from v group by all), l as (select label, w, list(x order by d) as mean from m group by all)
    select label, w as window_start, coalesce(round(list_cosine_distance(lag(mean) over (partition by label order by w), mean), 5), -1) as distance from l""")
def sliding(c: Catalog):
    timed = c.embeddings.withColumn("at", F.timestamp_seconds(F.col("vec_id") * 20))
    means = ordered.sliding_means(timed, ["label"], "at", "embedding")
    out = ordered.window_breaks(means, ["label"])
    return out.select("label", F.unix_seconds("window_start").alias("window_start"), F.coalesce(F.round("distance", 5), F.lit(-1.0)).alias("distance"))
