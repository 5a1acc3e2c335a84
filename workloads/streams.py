"""The event log as a stream. Each workload runs a stream over the given files and reads back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from cinelake.session import ensure_checkpoint_dir
from cinelake.sources.tables import CatalogTables
from cinelake.streaming import events as ev
from cinelake.streaming.source import event_stream, events_since, newest, run_to_table, table_glob
from cinelake.streaming.upkeep import ingest_batches
from workloads.registry import query
from workloads.views import Catalog


def stream(c: Catalog, table: str = "events") -> DataFrame:
    rows = event_stream(c.spark, table_glob(c.folder, f"{table}.parquet"), c.table(table).schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


@query("str01_event_stream", "select event_id, event_type, user_id from events")
def event_log(c: Catalog):
    return run_to_table(stream(c).select("event_id", "event_type", "user_id"), "append").drop("batch")


@query("str01_events_since", "select event_id, event_type from events where event_id > (select median(event_id) from events)")
def since(c: Catalog):
    cursor = c.events.agg(F.median("event_id")).first()[0]
    return events_since(c.events, int(cursor)).select("event_id", "event_type")


@query("str02_flatten", """select event_id, '{"event_type":"' || event_type || '","job_id":"' || cast(user_id as varchar) || '","k":' || (props->>'$.k') || ',"stage":"s' || cast(user_id % 9 as varchar) || '"}' as data, false as known from events""")
def flatten(c: Catalog):
    rows = stream(c).select("event_id", "event_type", F.concat(F.lit("s"), (F.col("user_id") % 9).cast("string")).alias("stage"), F.col("user_id").alias("job_id"), F.col("props").alias("payload_json"))
    return run_to_table(ev.flatten(rows), "append").select("event_id", "data", "known")


@query("str03_prune", "select event_id from events where ts >= timestamp '2024-01-31 00:00:00' - interval 240 hours")
def prune(c: Catalog):
    rows = c.events.withColumn("created_at", F.col("ts").cast("timestamp"))
    return ev.prune(rows, 240, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("event_id")


@query("str04_live_stage_status", """select stage, count(*) as total, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'running') as running, count(*) filter (status = 'done') as done, count(*) filter (status = 'error') as error
    from (select arg_max(user_id % 9, event_id) as stage, arg_max(case event_type when 'error' then 'error' when 'click' then 'running' when 'view' then 'pending' else 'done' end, event_id) as status from events group by user_id) group by stage""")
def live_status(c: Catalog):
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "pending").otherwise("done")
    rows = stream(c).select(F.col("user_id").alias("job_id"), "event_id", (F.col("user_id") % 9).alias("stage"), status.alias("status"))
    states = newest(run_to_table(ev.last_status(rows), "update"), ["job_id"])
    return ev.live_stage_status(states)


@query("str04_stage_changes", """select stage, count(*) as total, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'running') as running, count(*) filter (status = 'done') as done, count(*) filter (status = 'error') as error
    from (select arg_max(user_id % 9, event_id) as stage, arg_max(case event_type when 'error' then 'error' when 'click' then 'running' when 'view' then 'pending' else 'done' end, event_id) as status from events group by user_id) group by stage""")
def stage_changes(c: Catalog):
    """The same from changes written while the stream runs, with state that ends."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "pending").otherwise("done")
    rows = stream(c).select(F.col("user_id").alias("job_id"), "event_id", (F.col("user_id") % 9).alias("stage"), status.alias("status"), "ts")
    return ev.stage_status(run_to_table(ev.stage_changes(rows, "ts"), "append"))


@query("str05_job_durations", "select event_id as job_id, event_type as outcome, round(value * 60, 3) as duration_seconds from events where event_type <> 'error'")
def durations(c: Catalog):
    started = stream(c).select(F.col("event_id").alias("job_id"), F.col("ts").alias("started_at"))
    later = F.timestamp_micros(F.unix_micros("ts") + (F.col("value") * 60_000_000).cast("bigint"))
    finished = stream(c).filter("event_type <> 'error'").select(F.col("event_id").alias("job_id"), later.alias("finished_at"), F.col("event_type").alias("outcome"))
    out = run_to_table(ev.job_durations(started, finished, within="240 hours"), "append")
    return out.select("job_id", "outcome", F.round("duration_seconds", 3).alias("duration_seconds"))


@query("str06_gate_decisions", """with recursive e as (select cast(user_id as varchar) as gate, epoch_us(ts) / 1e6 as t, event_type as et, row_number() over (partition by user_id order by ts) as n from events),
    r as (select distinct gate, 0::bigint as n, null::double as since, false as late, '' as decision, '' as who, 0.0::double as waited from e
    union all select gate, n, case when et in ('click', 'view') then case when s1 is not null then s1 when et = 'click' then t end end, late, case when et = 'view' and s1 is null then 'approved' when et not in ('click', 'view') and s1 is not null then case et when 'error' then 'skipped' else 'approved' end else '' end,
    case when et = 'view' then 'system' else 'user' end, case when et = 'view' then 0 else coalesce(t - s1, 0) end from (select e.*, coalesce(t - r.since > 14400, false) as late, case when coalesce(t - r.since > 14400, false) then null else r.since end as s1 from r join e on e.gate = r.gate and e.n = r.n + 1)),
    l as (select gate, arg_max(since, n) as since, max(n) as n from r group by gate having arg_max(coalesce(since, -1), n) >= 0)
    select gate, decision, who as decided_by, round(waited, 3) as waited_s from r where decision <> '' union all select gate, 'approved', 'system', 14400.0 from r where late
    union all select gate, 'approved', 'system', 14400.0 from l where since + 14400 < (select max(epoch_us(ts)) / 1e6 - 600 from events)""")
def gates(c: Catalog):
    kind = F.when(F.col("event_type").isin("click", "view"), "arrive").when(F.col("event_type") == "error", "skip").otherwise("approve")
    rows = stream(c).select(
        F.col("user_id").cast("string").alias("gate"), F.col("ts").alias("at"), kind.alias("kind"), F.when(F.col("event_type") == "view", "notify").otherwise("pause").alias("mode"), F.lit(4.0).alias("timeout_hours"),
    )
    return run_to_table(ev.gate_decisions(rows), "append").select("gate", "decision", "decided_by", F.round("waited_s", 3).alias("waited_s"))


@query("str07_run_budget", "select extract(day from ts)::bigint as run_id, count(*) as n_stages, round(sum(value), 3) as spent_s, round(1000 - sum(value), 3) as budget_remaining_s from events group by 1")
def budget(c: Catalog):
    rows = stream(c).select(F.dayofmonth("ts").cast("bigint").alias("run_id"), F.col("value").alias("elapsed_seconds"))
    out = newest(run_to_table(ev.run_budget(rows, 1000.0), "update"), ["run_id"])
    return out.select("run_id", "n_stages", F.round("spent_s", 3).alias("spent_s"), F.round("budget_remaining_s", 3).alias("budget_remaining_s"))


@query("str07_run_spending", "select extract(day from ts)::bigint as run_id, count(*) as n_stages, round(sum(value), 3) as spent_s, round(1000 - sum(value), 3) as budget_remaining_s from events group by 1")
def spending(c: Catalog):
    rows = stream(c).select(F.dayofmonth("ts").cast("bigint").alias("run_id"), F.col("value").alias("elapsed_seconds"), "ts")
    out = newest(run_to_table(ev.run_spending(rows, "ts", 1000.0), "append"), ["run_id"])
    return out.select("run_id", "n_stages", F.round("spent_s", 3).alias("spent_s"), F.round("budget_remaining_s", 3).alias("budget_remaining_s"))


@query("str08_stalled_jobs", """select cast(user_id as varchar) as job_id, cast(user_id % 9 as varchar) as stage, 7200.0::double as running_s from (select *, lead(ts) over (partition by user_id order by ts) as nx from events) where event_type = 'click'
    and epoch_us(coalesce(nx, (select max(ts) - interval 10 minutes from events))) / 1e6 - epoch_us(ts) / 1e6 > 7200""")
def stalled(c: Catalog):
    kind = F.when(F.col("event_type") == "click", "start").otherwise("finish")
    rows = stream(c).select(F.col("user_id").cast("string").alias("job_id"), (F.col("user_id") % 9).cast("string").alias("stage"), F.col("ts").alias("at"), kind.alias("kind"))
    return run_to_table(ev.stalled_jobs(rows, 7200.0), "append").drop("batch")


@query("str08_gates_near_timeout", """select event_id, round(epoch_us(timestamp '2024-01-20 00:00:00') / 1e6 - epoch_us(ts) / 1e6, 3) as waited_s from events where epoch_us(timestamp '2024-01-20 00:00:00') / 1e6 - epoch_us(ts) / 1e6 > 100 * 3600 * 0.8 and epoch_us(timestamp '2024-01-20 00:00:00') / 1e6 - epoch_us(ts) / 1e6 <= 100 * 3600""")
def near_timeout(c: Catalog):
    waiting = c.events.select("event_id", F.col("ts").cast("timestamp").alias("since"), F.lit(100.0).alias("timeout_hours"))
    out = ev.gates_near_timeout(waiting, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return out.select("event_id", F.round("waited_s", 3).alias("waited_s"))


@query("str09_notifications", "select event_id, 's' as stage, props->>'$.k' as message from events where event_type = 'signup'")
def notifications(c: Catalog):
    kind = F.when(F.col("event_type") == "signup", "notification").otherwise(F.col("event_type"))
    payload = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("message"), F.lit("info").alias("type")))
    rows = stream(c).select("event_id", kind.alias("event_type"), F.lit("s").alias("stage"), payload.alias("payload_json"))
    return run_to_table(ev.notifications(rows), "append").select("event_id", "stage", "message")


@query("str09_unread", "select count(*) as n_unread from events where event_type = 'signup' and event_id > (select min(event_id) from events where event_type = 'purchase')")
def unread(c: Catalog):
    rows = c.events.withColumn("event_type", F.when(F.col("event_type") == "signup", "notification").otherwise(F.col("event_type")))
    read = c.events.filter("event_type = 'purchase'").agg(F.min("event_id")).first()[0]
    return ev.unread(rows, read)


@query("str10_tile_scores", "select user_id % 100 as media_id, epoch(date_trunc('hour', ts))::bigint as tile_s, event_type as class, max(value) as probability from events group by all")
def tile_scores(c: Catalog):
    rows = stream(c).select((F.col("user_id") % 100).alias("media_id"), "ts", F.col("event_type").alias("class"), F.col("value").alias("probability"))
    written = run_to_table(ev.tile_scores(rows, "ts", "1 hour"), "update")
    return newest(written, ["media_id", "tile_start", "class"]).select("media_id", F.unix_seconds("tile_start").alias("tile_s"), "class", "probability")


@query("str11_sliding_sums", """select user_id % 10 as media_id, w * 60 as window_s, dim, round(sum(case dim when 0 then value else value * 2 end), 3) as total, count(*) as n from (select user_id, value, epoch(date_trunc('minute', ts))::bigint // 60 - k as w from events, (select unnest([0, 1, 2, 3, 4]) as k)), (select unnest([0, 1])::bigint as dim) group by all""")
def sliding_sums(c: Catalog):
    rows = stream(c).select((F.col("user_id") % 10).alias("media_id"), "ts", F.array(F.col("value"), F.col("value") * 2).alias("v"))
    written = run_to_table(ev.sliding_sums(rows, "ts", "v"), "update")
    out = newest(written, ["media_id", "window_start", "dim"])
    return out.select("media_id", F.unix_seconds("window_start").alias("window_s"), F.col("dim").cast("bigint").alias("dim"), F.round("total", 3).alias("total"), "n")


@query("str10_tile_top_classes", """with t as (select user_id % 100 as media_id, date_trunc('hour', ts) as tile, event_type as class, max(value) as probability from events group by all)
    select media_id, epoch(tile)::bigint as tile_s, rank::integer as rank, class, probability from (select *, row_number() over (partition by media_id, tile order by probability desc, class) as rank from t) where rank <= 3 and tile + interval 1 hour <= (select date_trunc('milliseconds', max(ts)) - interval 1 hour from events)""")
def tile_top_classes(c: Catalog):
    rows = stream(c).select((F.col("user_id") % 100).alias("media_id"), "ts", F.col("event_type").alias("class"), F.col("value").alias("probability"))
    out = run_to_table(ev.tile_top_classes(rows, "ts", 3, "1 hour", "1 hour"), "append")
    return out.select("media_id", F.unix_seconds("tile_start").alias("tile_s"), "rank", "class", "probability")


@query("str11_sliding_means", """select user_id % 10 as media_id, w * 60 as window_s, round(avg(embedding[1]), 5) as first_value, round(avg(list_sum(embedding::double[])), 5) as total, count(*) as n from (select user_id, embedding, epoch(date_trunc('minute', ts))::bigint // 60 - k as w from events join embeddings on vec_id = event_id, (select unnest([0, 1, 2, 3, 4]) as k)) group by all""")
def sliding_means(c: Catalog):
    rows = stream(c).join(c.embeddings, F.col("vec_id") == F.col("event_id")).select((F.col("user_id") % 10).alias("media_id"), "ts", "embedding")
    out = newest(run_to_table(ev.sliding_means(rows, "ts", "embedding"), "update"), ["media_id", "window_start"])
    total = F.aggregate("mean_vector", F.lit(0.0), lambda a, x: a + x)
    return out.select("media_id", F.unix_seconds("window_start").alias("window_s"), F.round(F.col("mean_vector")[0], 5).alias("first_value"), F.round(total, 5).alias("total"), "n")


@query("str12_session_activities", """select user_id as camera, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as end_us, count(*) as n_clips from (select *, sum(coalesce(gap > interval 30 minutes, false)::int) over (partition by user_id order by ts, event_id) as s from
    (select *, ts - lag(ts) over (partition by user_id order by ts, event_id) as gap from events)) group by user_id, s having max(ts) + interval 30 minutes <= (select date_trunc('milliseconds', max(ts)) - interval 1 hour from events)""")
def sessions(c: Catalog):
    rows = stream(c).select(F.col("user_id").alias("camera"), "ts")
    out = run_to_table(ev.session_activities(rows, "camera", "ts"), "append")
    return out.select("camera", F.unix_micros("time_start").alias("start_us"), F.unix_micros("time_end").alias("end_us"), "n_clips")


@query("str13_incremental_upkeep", """select cast(doc_id as varchar) as id, case when row_number() over (partition by text order by cast(doc_id as varchar)) > 1 then 'duplicate' else 'ingested' end as status from documents""")
def upkeep(c: Catalog):
    base = f"{ensure_checkpoint_dir(c.spark)}/upkeep/{uuid.uuid4().hex}"
    catalog = CatalogTables(c.spark, f"{base}/tables")
    arrivals = stream(c, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("file_path"), F.sha2("text", 256).alias("sha256_prefix"))
    ingest_batches(arrivals, catalog, f"{base}/state")
    # Once more from the start: known ids are passed over.
    ingest_batches(arrivals, catalog, f"{base}/state-again")
    return catalog.read("media_files").select("id", "status")
