"""Column expressions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinelake.functions import checks, documents, framing, geo, records, sampling, timecode, vectors
from cinelake.sources.inventory import fingerprint, parse_probe
from workloads.registry import query
from workloads.views import Catalog


@query("src02_fingerprint", "select doc_id, sha256(text) as digest from documents")
def digests(c: Catalog):
    return c.documents.select("doc_id", fingerprint(F.col("text").cast("binary")).alias("digest"))


@query("src03_parse_probe", """select doc_id, coalesce(case when doc_id % 3 <> 0 then 'h264' when doc_id % 2 = 0 then 'aac' end, '') as codec, coalesce(case when doc_id % 3 <> 0 and doc_id % 5 <> 0 then round(n_chars / (doc_id % 5), 6) end, -1) as fps,
    n_chars / 10.0 as duration_seconds, case when doc_id % 2 = 0 then 2 else -1 end::bigint as audio_channels, '2024-03-' || lpad(cast(doc_id % 28 + 1 as varchar), 2, '0') || 'T10:00:00' as created_at, 18.5::double as gps_lat from documents""")
def probe(c: Catalog):
    s = lambda e: e.cast("string")
    i = F.col("doc_id")
    video = F.when(i % 3 != 0, F.concat(F.lit('{"codec_type": "video", "codec_name": "h264", "width": 64, "height": 36, "r_frame_rate": "'), s(F.col("n_chars")), F.lit("/"), s(i % 5), F.lit('"}')))
    audio = F.when(i % 2 == 0, F.lit('{"codec_type": "audio", "codec_name": "aac", "channels": 2}'))
    probe_json = F.concat(F.lit('{"streams": ['), F.concat_ws(", ", audio, video), F.lit('], "format": {"duration": "'), s(F.col("n_chars") / 10), F.lit('"}}'))
    exif = F.concat(F.lit('[{"DateTimeOriginal": "2024:03:'), F.lpad(s(i % 28 + 1), 2, "0"), F.lit(' 10:00:00", "GPSLatitude": 18.5}]'))
    out = parse_probe(c.documents.select("doc_id", probe_json.alias("probe_json"), exif.alias("exif_json")))
    return out.select("doc_id", F.coalesce("codec", F.lit("")).alias("codec"), F.coalesce(F.round("fps", 6), F.lit(-1.0)).alias("fps"), "duration_seconds", F.coalesce("audio_channels", F.lit(-1).cast("bigint")).alias("audio_channels"), "created_at", "gps_lat")


@query("exp01_haversine", """select c_custkey, round(2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)), 3) as metres from (select c_custkey, power(sin(radians(c_acctbal / 200 - (n_nationkey * 3 - 36)) / 2), 2)
    + cos(radians(n_nationkey * 3 - 36)) * cos(radians(c_acctbal / 200)) * power(sin(radians((c_custkey % 360) - n_nationkey * 10) / 2), 2) as a from customer join nation on n_nationkey = c_nationkey)""")
def haversine(c: Catalog):
    """Each customer's place against its nation's."""
    rows = c.customer.join(c.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    d = geo.haversine_m(F.col("n_nationkey") * 3 - 36, F.col("n_nationkey") * 10, F.col("c_acctbal") / 200, F.col("c_custkey") % 360)
    return rows.select("c_custkey", F.round(d, 3).alias("metres"))


@query("exp02_timecodes", """select event_id, case when event_type = 'error' then -1 else (event_id % 30) * 3600 + (event_id % 60) * 60 + round(value, 3) end as seconds from events""")
def timecodes(c: Catalog):
    text = F.format_string("%02d:%02d:%06.3f", F.col("event_id") % 30, F.col("event_id") % 60, F.col("value"))
    broken = F.when(F.col("event_type") == "error", F.lit("12:3")).otherwise(text)
    return c.events.select("event_id", F.coalesce(timecode.timecode_seconds(broken), F.lit(-1.0)).alias("seconds"))


@query("exp03_srt_stamps", """select media_id, pos, printf('%02d:%02d:%02d,%03d', floor(t / 3600)::int, floor((t % 3600) / 60)::int, floor(t % 60)::int, floor((t - floor(t)) * 1000)::int) as stamp from (select media_id, pos, end_s * 100.25 as t from segments)""")
def stamps(c: Catalog):
    return c.segments.select("media_id", "pos", timecode.srt_stamp(F.col("end_s") * 100.25).alias("stamp"))


@query("exp04_texts", """select doc_id, case when n // 3600 > 0 then printf('%d:%02d:%02d', n // 3600, n % 3600 // 60, n % 60) else printf('%d:%02d', n // 60, n % 60) end as duration_text, printf('%02d:%02d:%02d', n // 3600, n % 3600 // 60, n % 60) as clock_text,
    case when n < 60 then printf('%ds', n) when n < 3600 then printf('%dm', n // 60) else printf('%dh%dm', n // 3600, n % 3600 // 60) end as age_text from (select doc_id, n_chars as n from documents)""")
def texts(c: Catalog):
    n = F.col("n_chars").cast("double")
    return c.documents.select("doc_id", timecode.duration_text(n).alias("duration_text"), timecode.clock_text(n).alias("clock_text"), timecode.age_text(n).alias("age_text"))


@query("exp05_iso_times", """select event_id, case when event_type = 'error' then -1 else epoch_us(date_trunc('second', ts)) / 1e6 end as at_s from events""")
def iso(c: Catalog):
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("event_type") == "error", "yesterday").when(F.col("event_type") == "click", F.concat(stamp, F.lit("Z"))).when(F.col("event_type") == "view", F.concat(stamp, F.lit("+00:00"))).otherwise(stamp)
    return c.events.select("event_id", F.coalesce(timecode.epoch_seconds(timecode.parse_iso(raw)), F.lit(-1.0)).alias("at_s"))


@query("exp06_tolerant_json", """select conv_id, turn, case role when 'user' then 2 else 0 end::bigint as n_items, case role when 'user' then text else '' end as first_text from conversations""")
def tolerant(c: Catalog):
    quoted = F.to_json(F.struct(F.col("text")))
    raw = F.when(F.col("role") == "user", F.concat(F.lit("["), quoted, F.lit(', 5, null, "x", {"text": "second"}]'))).when(F.col("role") == "assistant", quoted).otherwise(F.col("text"))
    items = documents.json_objects(raw, {"text": "string"}, ("text",))
    return c.conversations.select("conv_id", "turn", F.size(items).cast("bigint").alias("n_items"), F.coalesce(F.get(items, F.lit(0))["text"], F.lit("")).alias("first_text"))


@query("exp07_fenced_json", "select conv_id, turn, trim(text, ' ' || chr(10) || chr(9) || chr(13)) as body from conversations")
def fenced(c: Catalog):
    t = F.col("text")
    wrapped = F.when(F.col("role") == "user", F.concat(F.lit("Sure:\n```json\n"), t, F.lit("\n```\nDone\n```x```"))).when(F.col("turn") % 2 == 1, F.concat(F.lit("```\n"), t, F.lit("\n```"))).otherwise(t)
    return c.conversations.select("conv_id", "turn", documents.fenced_json(wrapped).alias("body"))


@query("exp08_canonical_hash", """select o_orderkey, sha256('{"a":"' || o_orderstatus || '","b":' || cast(o_custkey as varchar) || '}') as digest from orders""")
def canonical(c: Catalog):
    return c.orders.select("o_orderkey", documents.canonical_hash(F.struct(F.col("o_orderstatus").alias("a"), F.col("o_custkey").alias("b"))).alias("digest"))


@query("exp09_frame_grid", "select doc_id, unnest(range(0, n_chars, 30))::bigint as frame_number from documents where n_chars > 0")
def grid(c: Catalog):
    step = sampling.step_per_second(F.lit(30.5))
    return c.documents.select("doc_id", F.explode(sampling.frame_grid(F.col("n_chars"), step)).alias("frame_number"))


@query("exp10_even_stamps", "select media_id, shot_pos, i, round(start_s + i * (end_s - start_s) / 4, 6) as at_s, cast(floor((start_s + i * (end_s - start_s) / 4) * 30) as bigint) as frame_number from shots, (select unnest([0, 1, 2, 3, 4])::bigint as i)")
def even(c: Catalog):
    rows = c.shots.select("media_id", "shot_pos", F.posexplode(sampling.even_stamps(F.col("start_s"), F.col("end_s"), 5)).alias("i", "at_s"))
    return rows.select("media_id", "shot_pos", F.col("i").cast("bigint").alias("i"), F.round("at_s", 6).alias("at_s"), F.floor(F.col("at_s") * 30).cast("bigint").alias("frame_number"))


@query("exp11_interpolate", "select pos, round(cx + 0.25 * (w - cx), 6) as x, round(h + 0.25 * (cy - h), 6) as y from detections")
def interpolate(c: Catalog):
    a, b = F.array("cx", "h"), F.array("w", "cy")
    box = framing.lerp_box(a, b, F.lit(0.25))
    return c.detections.select("pos", F.round(box[0], 6).alias("x"), F.round(box[1], 6).alias("y"))


@query("exp12_crop_window", """with a as (select p_partkey, p_size * 40 as sw, 1080 as sh, case when p_partkey % 3 = 0 then 9 else 16 end as aw, case when p_partkey % 3 = 0 then 16 else 9 end as ah from part)
    select p_partkey, (case when sw * ah // aw <= sh then sw else sh * aw // ah end)::bigint as w, (case when sw * ah // aw <= sh then sw * ah // aw else sh end)::bigint as h from a""")
def window(c: Catalog):
    size = framing.crop_window(F.col("p_size") * 40, F.lit(1080), F.when(F.col("p_partkey") % 3 == 0, "9:16").otherwise("16:9"))
    return c.part.select("p_partkey", size.alias("s")).select("p_partkey", "s.w", "s.h")


@query("exp13_thirds_centre", "select pos, round(cx - (2.0/3 - 0.5) * 608, 6) as x, round(cy - h / 3 + 1080 / 6.0, 6) as y from detections")
def thirds(c: Catalog):
    x, y = framing.thirds_centre(F.col("cx"), F.col("cy"), F.col("h"), F.lit(608.0), F.lit(1080.0))
    return c.detections.select("pos", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("exp14_clamp", "select pos, least(greatest(cx * 10 - 304, 0.0), 1312.0) as x from detections")
def clamp(c: Catalog):
    return c.detections.select("pos", framing.corner_clamped(F.col("cx") * 10, F.lit(608.0), F.lit(1920.0)).alias("x"))


@query("exp15_vector_measures", "select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as norm, round(1 - list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]), 6) as distance from embeddings")
def measures(c: Catalog):
    return c.embeddings.select("vec_id", F.round(vectors.l2_norm(F.col("embedding")), 6).alias("norm"), F.round(vectors.cosine_distance(F.col("embedding"), F.reverse("embedding")), 6).alias("distance"))


@query("exp16_frame_scores", """select pos, round(greatest(0.0, 1 - least(sqrt((cx-40)*(cx-40)+(cy-30)*(cy-30)), sqrt((cx-80)*(cx-80)+(cy-30)*(cy-30)), sqrt((cx-40)*(cx-40)+(cy-60)*(cy-60)), sqrt((cx-80)*(cx-80)+(cy-60)*(cy-60))) / 50.0), 6) as thirds,
    round(0.3 * 0.5 + 0.3 * greatest(0.0, 1 - least(sqrt((cx-40)*(cx-40)+(cy-30)*(cy-30)), sqrt((cx-80)*(cx-80)+(cy-30)*(cy-30)), sqrt((cx-40)*(cx-40)+(cy-60)*(cy-60)), sqrt((cx-80)*(cx-80)+(cy-60)*(cy-60))) / 50.0) + 0.4 * confidence, 6) as score from detections""")
def scores(c: Catalog):
    boxes = F.array(F.struct("bbox_xywh", "confidence"))
    t = framing.thirds_score(boxes, F.lit(120.0), F.lit(90.0))
    return c.boxes.select("pos", F.round(t, 6).alias("thirds"), F.round(framing.combined_score(F.lit(0.5), t, framing.confidence_score(boxes)), 6).alias("score"))


@query("exp17_audio_levels", """select case when level_db > 0 then 'error' else 'warning' end as severity, count(*) as n from plan_clips where round(level_db, 6) > 0 or round(level_db, 6) < -24 group by 1""")
def levels(c: Catalog):
    found = checks.audio_level_issue(F.col("clip_id").cast("string"), F.round("level_db", 6).cast("string"))
    return c.plan_clips.select(found.alias("x")).filter("x is not null").groupBy(F.col("x.severity").alias("severity")).agg(F.count("*").alias("n"))


@query("exp20_template", "select conv_id, turn, 'As ' || role || ': ' || text || ' (' || role || ')' as prompt from conversations")
def template(c: Catalog):
    return c.conversations.select("conv_id", "turn", documents.fill_template("As {role}: {text} ({role})", {"role": F.col("role"), "text": F.col("text")}).alias("prompt"))


@query("exp21_asset_priority", """select p_partkey, case p_type when 'ECONOMY' then 'Music' when 'STANDARD' then 'B-Roll' else 'Voiceover' end as kind, case when p_type not in ('ECONOMY', 'STANDARD') or (p_type = 'ECONOMY' and p_size > 30) or (p_type = 'STANDARD' and p_size > 3) then 'High' else 'Medium' end as priority,
    case p_type when 'ECONOMY' then 'Freesound, MusicGen, AudioJungle' when 'STANDARD' then 'Pexels, Pixabay, Artgrid' else 'Kokoro TTS, ElevenLabs, manual recording' end as sources from part""")
def priority(c: Catalog):
    kind = F.when(F.col("p_type") == "ECONOMY", "Music").when(F.col("p_type") == "STANDARD", "B-Roll").otherwise("Voiceover")
    return c.part.select("p_partkey", kind.alias("kind"), checks.asset_priority(kind, F.col("p_size")).alias("priority"), checks.asset_sources(kind).alias("sources"))


@query("exp22_flat_events", """select event_id, case event_type when 'error' then '{"event_type":"error","job_id":"' || cast(user_id as varchar) || '","payload_json":"broken{","stage":null}'
    when 'click' then '{"event_type":"click","job_id":"' || cast(user_id as varchar) || '","stage":null}'
    else '{"event_type":"' || event_type || '","job_id":"' || cast(user_id as varchar) || '","k":' || cast(props->>'$.k' as varchar) || ',"stage":null}' end as data from events""")
def flat(c: Catalog):
    payload = F.when(F.col("event_type") == "error", "broken{").when(F.col("event_type") == "click", "").otherwise(F.col("props"))
    return c.events.select("event_id", documents.flat_event_json(F.col("event_type"), F.lit(None).cast("string"), F.col("user_id").cast("string"), payload).alias("data"))


@query("exp23_render_route", """select l_orderkey, l_linenumber, l_partkey, case when l_returnflag = 'A' or l_linestatus = 'O' then 'slow' else 'fast' end as route from lineitem""")
def route(c: Catalog):
    overlay = F.when(F.col("l_returnflag") == "A", "pip").otherwise("caption")
    mode = F.when(F.col("l_linestatus") == "O", "auto_subject")
    return c.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", checks.render_route(overlay, mode, F.col("l_partkey")).alias("route"))


@query("exp24_normalise_records", """select conv_id, turn, text, 0.0::double as start, turn * 1.0::double as "end", case when role = 'user' then '0' else 'person' end as class, turn * 10 + 8 as end_frame from conversations""")
def normalise(c: Catalog):
    word = F.struct(F.lit("w").alias("word"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(None).cast("double").alias("score"))
    seg = F.array(F.struct(F.lit(None).cast("double").alias("start"), F.col("turn").alias("end"), "text", F.col("role").alias("speaker"), F.array(word).alias("words")))
    det = records.normalise_detection(F.lit(None), F.when(F.col("role") == "user", 0).otherwise(1), F.create_map(F.lit(1), F.lit("person")), F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), F.lit(0.5))
    shot = records.normalise_shot(F.col("turn"), F.col("turn") * 10 + 9, end_exclusive=True)
    out = c.conversations.select("conv_id", "turn", records.normalise_segments(seg)[0].alias("s"), det.alias("d"), shot.alias("b"))
    return out.select("conv_id", "turn", "s.text", "s.start", "s.end", "d.class", "b.end_frame")
