"""Whole jobs: deduplication, activities, storyboards, prompts, plans, timelines, tracks, crops, checks, uploads, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinelake.functions.documents import json_strings
from cinelake.functions.timecode import seconds_timecode
from cinelake.operators.tracks import dense_tracks
from cinelake.plans import activities, assets, edit_plans, ingest, prompts, publishing, reframe, render_qa, storyboard, timeline, views
from cinelake.sources import signals as signal_rows
from workloads.aggregates import STAGE_SQL, signals
from workloads.registry import query
from workloads.views import Catalog


@query("job01_dedup_media", """select media_id, case when row_number() over (partition by content order by media_id) > 1 then 'duplicate' else status end as status from media""")
def dedup(c: Catalog):
    media = c.media.select("media_id", "status", F.sha2("content", 256).alias("sha256_prefix"))
    return ingest.dedup_media(media, ident="media_id", place="media_id").select("media_id", "status")


LINKS = """recursive p as (select id, epoch_us(ts) / 1e6 as t, lat from activities), b as (select id, t, lat, cast(floor(t / 120) as bigint) as k from p),
    n as (select a.id as a, b.id as b from b a join (select id, t, lat, k + o as k from b, (select unnest([-1, 0, 1]) as o)) b on a.k = b.k where a.id <> b.id and abs(a.t - b.t) <= 120 and (a.lat is null or b.lat is null or a.lat = b.lat)),
    r as (select id, id as root from p union select n.b, r.root from r join n on n.a = r.id and r.root < n.b), c as (select id, min(root) as activity from r group by id)"""


@query("job02_activities", f"with {LINKS} select id, activity from c")
def raw_activities(c: Catalog):
    clips = c.activities.withColumn("ts_s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return activities.raw_activities(clips, time_s=120.0, space_m=500.0).select("id", "activity")


@query("job02_cluster_envelopes", f"""with {LINKS}, g as (select activity, min(id) as first_id, count(*) as n_clips, min(epoch_us(ts) / 1e6) as time_start_s, max(epoch_us(ts) / 1e6) as time_end_s, avg(lat) as lat from c join activities using (id) group by activity)
    select sha256(cast(first_id as varchar)) as cluster_id, n_clips, time_start_s, time_end_s, coalesce(round(lat, 6), -1) as gps_center_lat from g""")
def activity_envelopes(c: Catalog):
    clips = c.activities.withColumn("ts_s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    _, clusters = activities.cluster_activities(clips, None, time_s=120.0)
    return clusters.select("cluster_id", "n_clips", "time_start_s", "time_end_s", F.coalesce(F.round("gps_center_lat", 6), F.lit(-1.0)).alias("gps_center_lat"))


def _top(place: str, table: str, n: int) -> str:
    return f"""(select cluster_id, string_agg(class || ' (' || cast(n as varchar) || ')', ', ' order by n desc, first_pos, class) as top from (select cluster_id, class, count(*) as n, min([m.pos, {place}, d.pos]) as first_pos,
        row_number() over (partition by cluster_id order by count(*) desc, min([m.pos, {place}, d.pos]), class) as rn from members m join {table} d using (media_id) group by cluster_id, class) where rn <= {n} group by cluster_id)"""


@query("job03_cluster_summary", f"""select cluster_id, time_start || ' to ' || time_end as time_range, coalesce(o.top, '') as detections, coalesce(a.top, '') as audio_events from clusters left join {_top('frame_number', 'detections', 10)} o using (cluster_id) left join {_top('ts_s', 'audio_events', 10)} a using (cluster_id)""")
def cluster_summary(c: Catalog):
    nowhere = c.clusters.withColumns({"gps_center_lat": F.lit(None).cast("double"), "gps_center_lon": F.lit(None).cast("double")})
    return storyboard.cluster_summary(nowhere, c.members, c.media, signals(c)).drop("gps")


@query("job03_master_storyboard", f"""with o as {_top('frame_number', 'detections', 5)}, a as {_top('ts_s', 'audio_events', 5)}, d as (select cluster_id, sum(duration_seconds::decimal(25,6))::double as s from members join media using (media_id) group by cluster_id),
    t as (select cluster_id, string_agg(text, ' | ' order by n) filter (n <= 5) as hl, count(*) as k from (select cluster_id, text, row_number() over (partition by cluster_id order by m.pos, s.pos) as n from members m join segments s using (media_id)) group by cluster_id),
    q as (select cluster_id, sum(confidence::decimal(28,9))::double / count(confidence) as ac, min(confidence) as mc from members join detections using (media_id) group by cluster_id),
    f as (select cl as cluster_id, string_agg(person, ', ' order by fc) as people from (select distinct m.cluster_id as cl, f.cluster_id as fc, coalesce(case when label <> '' then label end, 'Face #' || cast(f.cluster_id as varchar)) as person from members m join faces f using (media_id) left join face_clusters k on k.cluster_id = f.cluster_id where f.cluster_id is not null) group by cl)
    select cluster_id, concat_ws(chr(10), '## Cluster: ' || cluster_id, '- **Label**: ' || coalesce(nullif(label, ''), 'Unlabeled'), '- **Description**: ' || description,
    '- **Duration**: ' || case when s > 0 then printf('%.0f', s) || 's (' || printf('%.1f', s / 60) || ' min)' else 'unknown' end,
    '- **Key moments**: ' || nullif(concat_ws('; ', 'Transcript: ' || hl, 'Detected objects: ' || o.top), ''), '- **People present**: ' || people, '- **Emotional tone**: ' || nullif(concat_ws('; ', 'Audio: ' || a.top, 'Speech detected (' || cast(k as varchar) || ' segments)'), ''),
    '- **Visual quality**: ' || 'Avg detection confidence: ' || printf('%.2f', ac) || case when mc < 0.5 then '; Some low-confidence frames (min: ' || printf('%.2f', mc) || ') - possible motion blur or poor framing' else '' end || case when ac >= 0.8 then '; Overall good visual quality' when ac >= 0.6 then '; Moderate visual quality' else '; Low visual quality - many unclear frames' end) as section
    from clusters left join o using (cluster_id) left join a using (cluster_id) left join d using (cluster_id) left join t using (cluster_id) left join q using (cluster_id) left join f using (cluster_id) where not excluded""")
def master_storyboard(c: Catalog):
    return storyboard.master_storyboard(c.clusters, c.members, c.media, signals(c), c.face_clusters)


SHOT_PARTS = """tr as (select h.media_id, shot_pos, string_agg(text, ' ' order by pos, s.start_s) as transcript from shots h join segments s on s.media_id = h.media_id and s.start_s < h.end_s and s.end_s > h.start_s group by all),
    vi as (select h.media_id, shot_pos, string_agg(caption, '; ' order by s.start_s, s.end_s, caption) as visual from shots h join captions s on s.media_id = h.media_id and s.start_s < h.end_s and s.end_s > h.start_s group by all),
    ob as (select media_id, shot_pos, string_agg(class, ', ' order by k, class) as objects from (select h.media_id, shot_pos, class, min([frame_number, pos]) as k from shots h join detections d on d.media_id = h.media_id and frame_number between floor(h.start_s * 30)::bigint and floor(h.end_s * 30)::bigint group by all) group by all),
    pe as (select media_id, shot_pos, string_agg(person, ', ' order by k, person) as people from (select h.media_id, shot_pos, coalesce(case when label <> '' then label end, 'Face #' || cast(d.cluster_id as varchar)) as person, min([frame_number, face_index]) as k from shots h join faces d on d.media_id = h.media_id and frame_number between floor(h.start_s * 30)::bigint and floor(h.end_s * 30)::bigint left join face_clusters c on c.cluster_id = d.cluster_id where d.cluster_id is not null group by all) group by all),
    au as (select media_id, shot_pos, string_agg(class, ', ' order by k, class) as audio from (select h.media_id, shot_pos, class, min([ts_s, pos]) as k from shots h join audio_events d on d.media_id = h.media_id and ts_s between h.start_s and h.end_s group by all) group by all),
    sh as (select h.media_id, h.shot_pos, h.start_s, h.end_s, transcript, visual, objects, people, audio from shots h left join tr using (media_id, shot_pos) left join vi using (media_id, shot_pos) left join ob using (media_id, shot_pos) left join pe using (media_id, shot_pos) left join au using (media_id, shot_pos))"""


@query("job06_shot_storyboard", f"""with {SHOT_PARTS} select media_id, shot_pos, coalesce(transcript, '') as transcript, coalesce(visual, '') as visual, coalesce(objects, '') as objects, coalesce(people, '') as people, coalesce(audio, '') as audio from sh""")
def shot_storyboard(c: Catalog):
    rows = storyboard.shot_signals(c.shots, c.media, signals(c), c.face_clusters)
    return rows.select("media_id", "shot_pos", *[F.coalesce(n, F.lit("")).alias(n) for n in ("transcript", "visual", "objects", "people", "audio")])


@query("job06_narrative_storyboard", f"""with {SHOT_PARTS}, nb as (select cluster_id, m.pos as clip_pos, sh.*, row_number() over (partition by cluster_id order by m.pos, shot_pos) as n from members m join sh using (media_id)),
    body as (select cluster_id, n as shot_number, concat_ws(chr(10), '### Shot ' || cast(n as varchar) || ' (Clip: ' || cast(media_id as varchar) || ')', '- Duration: ' || printf('%.1f', end_s - start_s) || 's', '- Source: ' || cast(media_id as varchar) || ' [' || printf('%.1f', start_s) || 's – ' || printf('%.1f', end_s) || 's]',
    '- Transcript: ' || transcript, '- Visual: ' || visual, '- Objects: ' || objects, '- People: ' || people, '- Audio: ' || audio) as text from nb union all select cluster_id, 0, concat_ws(chr(10), '## Cluster: ' || cluster_id || ' — ' || coalesce(nullif(label, ''), 'Unlabeled'), 'Description: ' || description) from clusters),
    l as (select narrative_id, from_json(cluster_ids_json, '["VARCHAR"]') as ids from plans_of where json_valid(cluster_ids_json)), e as (select narrative_id, unnest(ids) as cluster_id, generate_subscripts(ids, 1) - 1 as pos from l)
    select narrative_id, cast(e.pos as bigint) as cluster_pos, cluster_id, count(*) as n_rows, sum(length(text))::bigint as n_chars, md5(string_agg(md5(text), '' order by shot_number)) as digest from e join body using (cluster_id) group by all""")
def narrative_storyboard(c: Catalog):
    shots = storyboard.shot_signals(c.shots, c.media, signals(c), c.face_clusters)
    narratives = c.plans_of.withColumn("ids", json_strings(F.col("cluster_ids_json")))
    # Digests of the texts in order, for checking. A cluster's section is the same in every narrative that lists it.
    body = storyboard.cluster_storyboards(c.clusters, c.members, shots).select("cluster_id", "shot_number", "page", F.length("text").alias("n"), F.md5("text").alias("d"))
    digests = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shot_number", "page", "d"))), lambda x: x["d"]), "")
    sections = body.groupBy("cluster_id").agg(F.count("*").alias("n_rows"), F.sum("n").cast("bigint").alias("n_chars"), F.md5(digests).alias("digest"))
    return storyboard.listed_sections(narratives, "ids", sections)


@query("job04_prompt_requests", """select 'script' as kind, narrative_id as target_id, page, 'planner' as model, case when page = 0 then '## Approved Narrative' || chr(10) || chr(10) || '**Title**: ' || title || chr(10) || '**Description**: ' || status || chr(10) || '**Proposed duration**: ' || cast(target_s as varchar) || ' seconds' || chr(10) || '**Arc**: ' || chr(10) || '**Emotional journey**: ' || chr(10) || chr(10) || '## Full L-Storyboard' || chr(10) || chr(10) else '' end || text as prompt
    from narratives join (select conv_id as narrative_id, turn as page, text from conversations) using (narrative_id)""")
def prompt_requests(c: Catalog):
    narratives = c.narratives.select("narrative_id", "title", F.col("status").alias("description"), F.col("target_s").alias("proposed_duration_seconds"), F.lit(None).alias("arc_notes"), F.lit("").alias("emotional_journey"))
    pages = c.conversations.select(F.col("conv_id").alias("narrative_id"), F.col("turn").alias("page"), F.col("text").alias("storyboard"))
    return prompts.script_requests(narratives, pages, "planner")


@query("job04_narrative_requests", """select 'narrative' as kind, conv_id as target_id, turn as page, 'planner' as model, 'Plan for Ana in calm style, 10 minutes, {other}' as system, text as prompt from conversations""")
def narrative_requests(c: Catalog):
    pages = c.conversations.select(F.col("conv_id").alias("target_id"), F.col("turn").alias("page"), F.col("text").alias("storyboard"))
    creator = {"creator_name": "Ana", "channel_style": "calm", "default_video_duration": "10"}
    return prompts.narrative_requests(pages, "planner", "Plan for {creator_name} in {channel_style} style, {default_video_duration} minutes, {other}", creator)


@query("job05_parse_labels", """select conv_id * 1000 + turn as target_id, case when role = 'user' and turn % 4 = 0 then text else '' end as label, case when role <> 'user' then 'not JSON' when turn % 4 = 0 then '' else 'missing description' end as error from conversations""")
def parse_labels(c: Catalog):
    j = F.to_json(F.struct(F.col("text").alias("label"), F.when(F.col("turn") % 4 == 0, "d").alias("description")))
    response = F.when(F.col("role") == "user", F.concat(F.lit("Here:\n```json\n"), j, F.lit("\n```"))).otherwise(F.concat(F.lit("No label: {"), F.col("text")))
    good, bad = prompts.parse_labels(c.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("target_id"), response.alias("response")))
    return good.select(F.col("cluster_id").alias("target_id"), "label", F.lit("").alias("error")).unionByName(bad.select("target_id", F.lit("").alias("label"), "error"))


@query("job05_parse_narratives", """select o_orderkey as target_id, 2::bigint as n, o_totalprice::double + 1 as seconds, '' as error from orders where o_orderstatus = 'F' union all select o_orderkey, 0, 0, case o_orderstatus when 'O' then 'missing proposed_duration_seconds' else 'not JSON' end from orders where o_orderstatus <> 'F'""")
def parse_narratives(c: Catalog):
    one = F.concat(F.lit('{"title": "a", "activity_cluster_ids": ["c1"], "proposed_duration_seconds": '), F.col("o_totalprice").cast("decimal(20,2)").cast("string"), F.lit("}"))
    two = F.when(F.col("o_orderstatus") == "F", F.lit('{"title": "b", "activity_cluster_ids": [], "proposed_duration_seconds": "1.0"}')).otherwise(F.lit('{"title": "b", "activity_cluster_ids": []}'))
    body = F.when(F.col("o_orderstatus") == "P", F.lit("[{")).otherwise(F.concat(F.lit("```\n["), one, F.lit(", "), two, F.lit("]\n```")))
    rows = c.orders.select(F.col("o_orderkey").alias("target_id"), body.alias("response"))
    good, bad = prompts.parse_narratives(rows)
    ident = lambda pos: F.sha2(F.concat_ws(":", F.col("target_id").cast("string"), F.lit(pos)), 256)
    named = good.filter(F.col("narrative_id").isin(ident("0"), ident("1")))
    found = named.groupBy("target_id").agg(F.count("*").alias("n"), F.sum("proposed_duration_seconds").alias("seconds"))
    return found.withColumn("error", F.lit("")).unionByName(bad.select("target_id", F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("seconds"), "error"))


EDL_ISSUES = """ov as (select narrative_id, 'error' as severity, 'overlap' as chk from (select narrative_id, out_s, lead(in_s) over (partition by narrative_id, track order by in_s, n) as nx from ed) where out_s > nx),
    du as (select narrative_id, 'error', 'duration' from narratives left join ed using (narrative_id) group by narrative_id, target_s having coalesce(sum(out_s - in_s) filter (track = 1), 0) < target_s * 0.9 or coalesce(sum(out_s - in_s) filter (track = 1), 0) > target_s * 1.1),
    mi as (select distinct narrative_id, 'error', 'clip_id', clip_id from ed where clip_id not in (select clip_id from clip_media)),
    bo as (select narrative_id, 'error', 'bounds' from ed join clip_media using (clip_id) where in_s < out_s and out_s > duration_seconds union all select narrative_id, 'error', 'bounds' from ed join clip_media using (clip_id) where in_s < out_s and in_s > duration_seconds),
    au as (select narrative_id, case when round(level_db, 6) > 0 then 'error' else 'warning' end, 'audio' from ed where round(level_db, 6) > 0 or round(level_db, 6) < -24),
    al as (select * from ov union all select * from du union all select narrative_id, 'error', 'clip_id' from mi union all select * from bo union all select * from au)"""
ED = "ed as (select narrative_id, track, clip_id, in_s, round(out_s, 3) as out_s, level_db, [pos, clip_id, track, round(out_s * 1000)::bigint] as n from plan_clips)"


def _plan_rows(c: Catalog):
    """Plan clips as an edit plan holds them: timecodes as text, a place that settles ties."""
    millis = F.round(F.col("out_s") * 1000).cast("bigint")
    return c.plan_clips.select(
        "narrative_id", "clip_id", seconds_timecode(F.col("in_s")).alias("in_timecode"), seconds_timecode(F.round("out_s", 3) + 0.0001).alias("out_timecode"),
        "track", F.struct("pos", "clip_id", "track", millis.alias("ms")).alias("pos"), F.round("level_db", 6).cast("string").alias("level_db"),
    )


@query("job07_validate_edl", f"""with {ED}, {EDL_ISSUES} select narrative_id, count(*) filter (severity = 'error') as n_errors, count(*) filter (severity = 'warning') as n_warnings, count(*) filter (severity = 'error') = 0 as passed from (select narrative_id, null as severity from narratives union all select narrative_id, null from plan_clips union all select narrative_id, severity from al) group by narrative_id""")
def validate(c: Catalog):
    rows = _plan_rows(c)
    issues = edit_plans.edl_issues(edit_plans.with_seconds(rows), c.narratives.select("narrative_id", "target_s"), c.clip_media, rows.select("narrative_id", "clip_id", "level_db"))
    subjects = c.narratives.select("narrative_id").unionByName(c.plan_clips.select("narrative_id"))
    return edit_plans.verdicts(subjects, issues)


@query("agg20_issue_counts", f"with {ED}, {EDL_ISSUES} select severity, chk as check_name, count(*) as n, count(distinct narrative_id) as n_plans from al group by all")
def issue_counts(c: Catalog):
    rows = _plan_rows(c)
    issues = edit_plans.edl_issues(edit_plans.with_seconds(rows), c.narratives.select("narrative_id", "target_s"), c.clip_media, rows.select("narrative_id", "clip_id", "level_db"))
    return issues.groupBy("severity", F.col("check").alias("check_name")).agg(F.count("*").alias("n"), F.countDistinct("narrative_id").alias("n_plans"))


@query("job07_explode_edl", """select o_orderkey as narrative_id, pos, case pos when 0 then 'a' else 'b' end as clip_id, case pos when 0 then 1 else 2 end::bigint as track, o_totalprice as target_s from orders, (select unnest([0, 1])::bigint as pos) where o_orderstatus <> 'P'""")
def explode_edl(c: Catalog):
    price = F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    doc = F.concat(F.lit('{"clips": [{"clip_id": "a", "in_timecode": "00:00:01.000", "out_timecode": "00:00:02.500"}, {"clip_id": "b", "track": 2}, 7], "target_duration_seconds": '), price, F.lit("}"))
    plans = c.orders.select(F.col("o_orderkey").alias("narrative_id"), F.when(F.col("o_orderstatus") == "P", F.lit("{broken")).otherwise(doc).alias("edl_json"))
    clips = edit_plans.with_seconds(edit_plans.explode_edl(plans, "clips")).join(edit_plans.plan_targets(plans), "narrative_id")
    return clips.select("narrative_id", "pos", "clip_id", "track", "target_s")


@query("job08_edl_feedback", """with lv as (select narrative_id, round(level_db, 6) as db, clip_id from plan_clips where round(level_db, 6) > 0 or round(level_db, 6) < -24), g as (select narrative_id, count(*) filter (db > 0) as e, count(*) filter (db < -24) as w from lv group by narrative_id)
    select narrative_id, 1 + narrative_id % 5 as attempt, e + w + 1 + (w > 0)::int as n_lines from g where e > 0 and 1 + narrative_id % 5 < 4""")
def feedback(c: Catalog):
    levels = c.plan_clips.select("narrative_id", "clip_id", F.round("level_db", 6).cast("string").alias("level_db"))
    issues = edit_plans.level_issues(levels)
    verdict = edit_plans.verdicts(c.narratives.select("narrative_id").unionByName(issues.select("narrative_id")), issues)
    attempts = verdict.select("narrative_id", (F.col("narrative_id") % 5 + 1).alias("attempt"))
    pages = edit_plans.edl_feedback(verdict, issues, attempts, page_rows=4)
    lines = F.size(F.split("feedback", "\n- ")) - 1 + F.size(F.split("feedback", r"\*\*(Errors|Warnings):\*\*")) - 1
    first = F.when(F.substring("feedback", 1, 2) == "- ", 1).otherwise(0)
    return pages.groupBy("narrative_id", "attempt").agg(F.sum(lines + first).cast("bigint").alias("n_lines"))


@query("job09_fetch_list", """select o_orderkey as narrative_id, '| Music | ' || o_orderpriority || ' | 00:00:00.000 | ' || printf('%.1f', (o_custkey % 60)::double) || 's | Freesound, MusicGen, AudioJungle | ' || case when o_custkey % 60 > 30 then 'High' else 'Medium' end || ' |' as line from orders where o_orderstatus <> 'F'
    union all select o_orderkey, '| B-Roll | sea | 00:01:00.000 | 2.0s | Pexels, Pixabay, Artgrid | Medium |' from orders
    union all select o_orderkey, unnest(['# Unresolved Asset Fetch List', '', '| Type | Description | Start Time | Duration | Suggested Sources | Priority |', '| --- | --- | --- | --- | --- | --- |']) from orders""")
def fetch_list(c: Catalog):
    doc = F.concat(F.lit('{"music": [{"mood": "'), F.col("o_orderpriority"), F.lit('", "duration": '), (F.col("o_custkey") % 60).cast("string"), F.lit('}], "broll_requests": [{"description": "sea", "duration": 2, "start_time": "00:01:00.000"}]}'))
    wanted = assets.asset_requests(c.orders.select(F.col("o_orderkey").alias("narrative_id"), doc.alias("edl_json")))
    found = c.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("narrative_id"), F.lit("Music").alias("kind"), F.lit(0).cast("bigint").alias("pos"), F.lit("m.wav").alias("path"))
    return assets.fetch_list_lines(assets.resolve_assets(wanted, found)).select("narrative_id", "line")


@query("job10_timeline_rows", """select narrative_id, track, row_number() over (partition by narrative_id, track order by in_s, pos, clip_id, out_s) - 1 as place, clip_id, in_s, round(out_s - in_s, 4) as duration_s, coalesce('f' || cast(m.clip_id as varchar), cast(p.clip_id as varchar)) as target from plan_clips p left join (select clip_id from clip_media) m using (clip_id)""")
def timeline_rows(c: Catalog):
    media = c.clip_media.select("clip_id", F.concat(F.lit("f"), F.col("clip_id").cast("string")).alias("file_path"), F.lit(25.0).alias("fps"))
    none = c.spark.createDataFrame([], "narrative_id bigint, type string, position string, duration double, track bigint, pos bigint")
    clips = c.plan_clips.withColumn("pos", F.struct("pos", "clip_id", "out_s"))
    rows, _ = timeline.timeline_rows(clips, media, none)
    return rows.select("narrative_id", "track", "place", "clip_id", "in_s", F.round("duration_s", 4).alias("duration_s"), "target")


@query("job11_subtitles", """with o as (select narrative_id, pos, clip_id, in_s, out_s, coalesce(sum(out_s - in_s) over (partition by narrative_id order by pos, clip_id, in_s, out_s rows between unbounded preceding and 1 preceding), 0) as off from (select narrative_id, pos, clip_id, max(in_s) as in_s, max(out_s) as out_s from plan_clips group by all))
    select narrative_id, row_number() over (partition by narrative_id order by o.pos, o.clip_id, s.pos) as cue, round(start_s + off, 4) as start_s, text from o join segments s on s.media_id = o.clip_id""")
def subtitles(c: Catalog):
    clips = c.plan_clips.groupBy("narrative_id", "pos", "clip_id").agg(F.max("in_s").alias("in_s"), F.max("out_s").alias("out_s"))
    out = timeline.subtitles(clips, c.segments.withColumnRenamed("media_id", "clip_id"))
    return out.select("narrative_id", "cue", F.round("start_s", 4).alias("start_s"), "text")


@query("job12_dense_tracks", """with k as (select distinct media_id, frame_number from detections), z as (select media_id, max(frame_number) + 4 as total from detections group by media_id), g as (select k.*, lead(frame_number) over (partition by media_id order by frame_number) as f1 from k),
    b as (select media_id, frame_number, track_id, arg_max(cx, pos) as cx, arg_max(confidence, pos) as conf from detections group by all),
    e as (select g.media_id, g.frame_number as f0, f1, b.track_id, b.cx as x0, b.conf as c0, null::double as x1, null::double as c1 from g join b using (media_id, frame_number) where f1 is not null union all select g.media_id, g.frame_number, f1, b.track_id, null, null, b.cx, b.conf from g join b on b.media_id = g.media_id and b.frame_number = f1),
    p as (select media_id, f0, f1, track_id, max(x0) as x0, max(c0) as c0, max(x1) as x1, max(c1) as c1 from e group by all), f as (select media_id, f0, f1, unnest(generate_series(f0 + 1, f1 - 1)) as n from (select media_id, frame_number as f0, f1 from g where f1 is not null)),
    mid as (select p.media_id, n as frame_number, track_id, case when x0 is not null and x1 is not null then x0 + (n - f.f0) / (f.f1 - f.f0) * (x1 - x0) else coalesce(x0, x1) end as cx, case when c0 is not null and c1 is not null then c0 + (n - f.f0) / (f.f1 - f.f0) * (c1 - c0) else coalesce(c0, c1) end as conf from p join f on f.media_id = p.media_id and f.f0 = p.f0 where n % 3 <> 0),
    hold as (select d.media_id, n as frame_number, track_id, cx, confidence as conf from (select media_id, frame_number, unnest(generate_series(frame_number + 1, total - 1)) as n from g join z using (media_id) where f1 is null union all select media_id, m, unnest(generate_series(0, m - 1)) from (select media_id, min(frame_number) as m from k group by media_id)) h join detections d using (media_id, frame_number) where n % 3 <> 0)
    select media_id, frame_number, coalesce(track_id, -1) as track_id, sampled, round(cx, 5) as cx, round(conf, 5) as confidence from (select media_id, frame_number, track_id, true as sampled, cx, confidence as conf from detections union all select media_id, frame_number, track_id, false, cx, conf from mid union all select media_id, frame_number, track_id, false, cx, conf from hold)""")
def tracks(c: Catalog):
    size = c.detections.groupBy("media_id").agg((F.max("frame_number") + 4).alias("total_frames")).withColumn("step", F.lit(3).cast("bigint"))
    _, boxes = dense_tracks(c.boxes, c.detections.select("media_id", "frame_number"), size)
    return boxes.select("media_id", "frame_number", F.coalesce("track_id", F.lit(-1).cast("bigint")).alias("track_id"), "sampled", F.round(F.col("bbox_xywh")[0], 5).alias("cx"), F.round("confidence", 5).alias("confidence"))


@query("set01_dense_frames", """with k as (select distinct media_id, frame_number from detections), z as (select media_id, max(frame_number) + 4 as total from detections group by media_id)
    select media_id, n as frame_number, (media_id, n) in (select (media_id, frame_number) from k) as sampled from (select media_id, unnest(generate_series(0, total - 1)) as n from z) where n % 3 <> 0 or (media_id, n) in (select (media_id, frame_number) from k)""")
def dense_frames(c: Catalog):
    size = c.detections.groupBy("media_id").agg((F.max("frame_number") + 4).alias("total_frames")).withColumn("step", F.lit(3).cast("bigint"))
    frames, _ = dense_tracks(c.boxes, c.detections.select("media_id", "frame_number"), size)
    return frames


CROP = """recursive sub as (select media_id, arg_max(track_id, [area, -fp, -pp]) as tid from (select media_id, track_id, sum(w * h) as area, min([frame_number, pos])[1] as fp, min([frame_number, pos])[2] as pp from detections where track_id is not null and frame_number <= 59 group by all) group by media_id),
    fr as (select media_id, tid, f from sub, (select unnest(generate_series(0, 59))::bigint as f)), bx as (select media_id, track_id, frame_number, arg_min([cx, cy, h], pos) as b from detections group by all),
    raw as (select fr.media_id, f, tid, b[1] * 10 - (2.0/3 - 0.5) * 607 as x, b[2] * 5 - b[3] / 3 + 1080 / 6.0 as y from fr left join bx on bx.media_id = fr.media_id and bx.track_id = tid and bx.frame_number = f),
    l as (select *, last_value(case when x is not null then f end ignore nulls) over w as lf, last_value(x ignore nulls) over w as lx, last_value(y ignore nulls) over w as ly from raw window w as (partition by media_id order by f rows unbounded preceding)),
    q as (select *, f - coalesce(lf, -1) - 1 as g, coalesce(lx, 960.0) as hx, coalesce(ly, 540.0) as hy from l),
    fl as (select media_id, f, tid, case when x is not null then x when g < 4 then hx when g < 6 then hx + (g - 4) / 2.0 * (960 - hx) else 960 end as x, case when y is not null then y when g < 4 then hy when g < 6 then hy + (g - 4) / 2.0 * (540 - hy) else 540 end as y from q),
    sm as (select media_id, f, tid, x, y from fl where f = 0 union all select fl.media_id, fl.f, fl.tid, sm.x + (1 - exp(-1.0 / 2)) * (fl.x - sm.x), sm.y + (1 - exp(-1.0 / 2)) * (fl.y - sm.y) from sm join fl on fl.media_id = sm.media_id and fl.f = sm.f + 1)"""


@query("job13_crop_paths", f"""with {CROP} select 'auto' as mode, media_id, f as frame_index, coalesce(tid, -1) as track_id, round(least(greatest(x - 303.5, 0), 1313), 4) as crop_x, round(least(greatest(y - 540, 0), 0), 4) as crop_y from sm
    union all select 'manual', media_id, f, -1, 756.5, 0 from (select distinct media_id from detections), (select unnest(generate_series(0, 59))::bigint as f)""")
def crops(c: Catalog):
    media = c.detections.select("media_id").distinct().withColumns({"fps": F.lit(2.0), "duration_seconds": F.lit(30.0)})
    text = lambda v: F.lit(v).cast("string")
    entry = lambda mode, tag: media.select(
        F.concat(F.lit(tag), F.col("media_id").cast("string")).alias("entry_id"), "media_id", F.lit("9:16").alias("target_aspect"), F.lit(mode).alias("mode"),
        F.lit(None).cast("bigint").alias("subject_track_id"), text(None).alias("in_timecode"), text("00:00:30.000").alias("out_timecode"),
        F.lit(100.0).alias("offset_x"), F.lit(0.0).alias("offset_y"), F.lit(1.0).alias("smoothing_tau"),
    )
    boxes = c.boxes.withColumn("bbox_xywh", F.array(F.col("cx") * 10, F.col("cy") * 5, F.col("w"), F.col("h")))
    paths, _ = reframe.crop_paths(entry("auto_subject", "a").unionByName(entry("manual_offset", "m")), media, boxes, 1920, 1080)
    return paths.select(
        F.when(F.substring("entry_id", 1, 1) == "a", "auto").otherwise("manual").alias("mode"), "media_id", "frame_index", F.coalesce("track_id", F.lit(-1).cast("bigint")).alias("track_id"),
        F.round("crop_x", 4).alias("crop_x"), F.round("crop_y", 4).alias("crop_y"),
    )


def _renders(c: Catalog):
    status = F.col("o_orderstatus")
    return c.orders.select(
        F.col("o_orderkey").alias("render_id"), (F.col("o_custkey") % 100 + 10.0).alias("duration_seconds"), (F.col("o_orderkey") % 90 + 10.0).alias("target_s"), F.lit(1920).cast("bigint").alias("width"),
        F.when(status == "P", 720).otherwise(1080).cast("bigint").alias("height"), F.when(F.col("o_orderpriority") == "5-LOW", "hevc").otherwise("h264").alias("codec"), (F.col("o_totalprice") * 50).cast("bigint").alias("size_bytes"),
        F.when(status == "F", F.lit('x {"input_i" : "-20.5"} y')).when(status == "O", F.lit('{"input_i" : "-14.2"}')).otherwise("none").alias("loudness_log"),
        F.concat(F.lit("black_start:1.5 black_end:2 black_duration:0.5\nblack_start:x black_end:2 black_duration:0.5 "), status).alias("black_log"),
        F.concat(F.lit("[s] silence_start: 3.5\n[s] silence_end: 6.0 | silence_duration: 2.5\nsilence_start: 9 zz\nsilence_end: 12 | silence_duration: 3 "), status).alias("silence_log"),
    )


@query("job14_render_qa", """with r as (select o_orderkey as id, o_custkey % 100 + 10.0 as dur, o_orderkey % 90 + 10.0 as tgt, o_orderstatus as st, o_orderpriority as pr, trunc(o_totalprice * 50)::bigint as sz from orders), m as (select *, sz / 1048576.0 / (dur / 60.0) as rate from r)
    select id as render_id, ((abs(dur - tgt) > 1)::int + (st = 'P')::int + (pr = '5-LOW')::int + (st <> 'O')::int)::bigint as n_errors, ((rate < 8)::int + (rate > 15)::int + 2 + case when st = 'O' then 1 else 2 end)::bigint as n_warnings,
    ((abs(dur - tgt) > 1)::int + (st = 'P')::int + (pr = '5-LOW')::int + (st <> 'O')::int) = 0 as passed, coalesce(case st when 'F' then -20.5 when 'O' then -14.2 end, 0)::double as lufs from m""")
def qa(c: Catalog):
    renders = _renders(c)
    intended = c.orders.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("render_id"), F.lit(3.0).alias("start"), F.lit(6.0).alias("end"))
    verdicts, _ = render_qa.render_qa(renders, renders.select("render_id", "loudness_log", "black_log", "silence_log"), intended)
    return verdicts.select("render_id", "n_errors", "n_warnings", "passed", F.coalesce("lufs", F.lit(0.0)).alias("lufs"))


@query("agg21_render_issue_counts", """with r as (select o_orderkey as id, o_custkey % 100 + 10.0 as dur, o_orderkey % 90 + 10.0 as tgt, o_orderstatus as st, o_orderpriority as pr, trunc(o_totalprice * 50)::bigint as sz from orders), m as (select *, sz / 1048576.0 / (dur / 60.0) as rate from r)
    select 'duration' as check_name, count(*) as n from m where abs(dur - tgt) > 1 union all select 'resolution', count(*) from m where st = 'P' union all select 'codec', count(*) from m where pr = '5-LOW' union all select 'file_size', count(*) from m where rate < 8 or rate > 15
    union all select 'loudness', count(*) from m where st <> 'O' union all select 'black_frames', 2 * count(*) from m union all select 'silence', 2 * count(*) - count(*) filter (st = 'O') from m""")
def render_issue_counts(c: Catalog):
    renders = _renders(c)
    intended = c.orders.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("render_id"), F.lit(3.0).alias("start"), F.lit(6.0).alias("end"))
    _, issues = render_qa.render_qa(renders, renders.select("render_id", "loudness_log", "black_log", "silence_log"), intended)
    return issues.groupBy(F.col("check").alias("check_name")).agg(F.count("*").alias("n"))


@query("exp18_render_issues", """with r as (select o_orderkey as render_id, o_custkey % 100 + 10.0 as dur, o_orderkey % 90 + 10.0 as tgt, o_orderstatus as st, o_orderpriority as pr, trunc(o_totalprice * 50) / 1048576.0 as mb, mb / (dur / 60.0) as rate from orders)
    select render_id, 'Duration ' || printf('%.1f', dur) || 's differs from target ' || printf('%.1f', tgt) || 's by more than 1s' as message from r where abs(dur - tgt) > 1 union all select render_id, 'Resolution 1920x720 does not match expected 1920x1080' from r where st = 'P'
    union all select render_id, 'Codec ''hevc'' does not match expected ''h264''' from r where pr = '5-LOW'
    union all select render_id, 'File size ' || printf('%.1f', mb) || ' MB (' || printf('%.1f', rate) || ' MB/min) ' || case when rate < 8 then 'is below expected minimum of 8 MB/min' else 'exceeds expected maximum of 15 MB/min' end from r where rate < 8 or rate > 15""")
def render_issues(c: Catalog):
    return render_qa.probe_issues(_renders(c)).select("render_id", "message")


@query("exp19_measurement_logs", """select o_orderkey as render_id, pos, case when pos = 1 then -1 else 1.5 end::double as start_s, case when pos = 0 then 0.5 else 0.5 end::double as duration_s from orders, (select unnest([0, 1])::bigint as pos)""")
def logs(c: Catalog):
    out = render_qa.measured_spans(_renders(c), "black_log", render_qa.BLACK)
    return out.select("render_id", F.col("pos").cast("bigint").alias("pos"), F.coalesce("start_s", F.lit(-1.0)).alias("start_s"), "duration_s")


@query("job15_upload_metadata", """select narrative_id, coalesce(title, cast(narrative_id as varchar)) as title, status || case when s.narrative_id is not null then chr(10) || chr(10) || o_orderpriority || ' ' || o_orderstatus else '' end as description, '22' as category_id, 'unlisted' as privacy_status
    from narratives left join scripts s using (narrative_id) join orders on o_orderkey = narrative_id""")
def upload_metadata(c: Catalog):
    rows = c.narratives.select("narrative_id", "title", F.col("status").alias("description")).join(c.plans_of, "narrative_id").withColumn("ids", json_strings(F.col("cluster_ids_json")))
    return publishing.upload_metadata(rows, "ids", c.scripts, c.clusters, publishing.catalog_classes(c.detections)).drop("tags")


@query("job16_candidate_frames", "select doc_id as video_id, unnest(range(0, n_chars, 25))::bigint as frame_number from documents where n_chars > 0")
def candidates(c: Catalog):
    return publishing.candidate_frames(c.documents.select(F.col("doc_id").alias("video_id"), F.col("n_chars").alias("total_frames"), F.lit(25.9).alias("fps")))


@query("job19_analyze_worklist", """select media_id, pass from media, (select unnest(['transcripts', 'detections', 'faces', 'audio_events']) as pass) where not ((pass = 'transcripts' and media_id in (select media_id from segments)) or (pass = 'detections' and media_id in (select media_id from detections))
    or (pass = 'faces' and media_id in (select media_id from faces)) or (pass = 'audio_events' and media_id in (select media_id from audio_events)))""")
def analyze_worklist(c: Catalog):
    tables = {"media": c.media, "transcripts": c.segments, "detections": c.detections, "faces": c.faces, "audio_events": c.audio_events}
    return ingest.worklist("analyze", tables)


@query("job19_upload_worklist", """select narrative_id from narratives where status = 'approved' and narrative_id in (select narrative_id from edit_plans where render_path <> '') and narrative_id not in (select clip_id from clip_media)""")
def upload_worklist(c: Catalog):
    tables = {"narratives": c.narratives, "edit_plans": c.edit_plans, "uploads": c.clip_media.select(F.col("clip_id").alias("narrative_id"))}
    return ingest.worklist("upload", tables).select("narrative_id")


@query("job20_pipeline_status", f"""select s.stage, total, pending, running, done, error, case when error > 0 then 'error' when running > 0 then 'running' when done = total then 'done' else 'waiting' end as state, mode as gate_mode from ({STAGE_SQL} from jobs group by stage) s join gates using (stage)""")
def pipeline_status(c: Catalog):
    stages = c.jobs.select("stage").distinct()
    # A stage has one gate here only where its users agree on the mode.
    return views.pipeline_status(stages, c.jobs, c.gates)


@query("job21_queue_report", """with w as (select max(length(cast(group_id as varchar))) as w from queue)
    select 3 as part, '  ' || rpad(cast(group_id as varchar), any_value(w)::int, ' ') || '  ' || rpad(status, 12, ' ') || '  ' || cast(count(*) as varchar) as line from queue, w group by group_id, status
    union all select 2, unnest(['', 'Per-group breakdown:']) union all select 4, unnest(['', 'Unhealthy groups:'])
    union all select 0, 'HEALTH: UNHEALTHY' union all select 1, 'total_rows=' || count(*) || ' completed=' || count(*) filter (status = 'completed') || ' in_flight=' || count(*) filter (status = 'in_flight') || ' dead=' || count(*) filter (status = 'dead') || ' retry=' || count(*) filter (status = 'retry') || ' pending=' || count(*) filter (status = 'pending') || ' oldest_dead_age='
    || cast(floor((1800000000 - epoch(min(created_at) filter (status in ('pending', 'retry', 'dead')))) / 3600) as bigint) || 'h' || cast(floor((1800000000 - epoch(min(created_at) filter (status in ('pending', 'retry', 'dead')))) % 3600 / 60) as bigint) || 'm' from queue
    union all select 5, '  ' || cast(group_id as varchar) || '  dead=' || count(*) filter (status = 'dead') || '  retry=' || count(*) filter (status = 'retry') || '  pending=' || count(*) filter (status = 'pending') from queue group by group_id having count(*) filter (status in ('dead', 'retry')) > 0""")
def queue_report(c: Catalog):
    queue = c.queue.withColumn("created_at", F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6)
    return views.queue_report(queue, F.lit(1_800_000_000.0)).select("part", "line")


@query("job22_audio_top_events", """select media_id, ts_s, class, probability, rank from (select media_id, ts_s, class, probability, row_number() over (partition by media_id, ts_s order by probability desc, pos) as rank from audio_events) where rank <= 5""")
def audio_top(c: Catalog):
    from cinelake.operators.topk import top_k

    return top_k(c.audio_events, ["media_id", "ts_s"], [F.col("probability").desc(), F.col("pos")], 5).select("media_id", "ts_s", "class", "probability", "rank")


@query("src13_signal_rows", """select user_id as media_id, class, count(*) as n from detections join (select event_id, user_id from events) on event_id = pos group by all""")
def signal_documents(c: Catalog):
    """Detections written as JSON lists per frame, and read back as rows."""
    box = F.struct("track_id", "class", F.col("bbox_xywh"), "confidence")
    lists = c.boxes.groupBy("media_id", "frame_number", "track_id").agg(F.to_json(F.collect_list(box)).alias("detections_json"))
    return signal_rows.detection_boxes(lists).groupBy("media_id", "class").agg(F.count("*").alias("n"))
