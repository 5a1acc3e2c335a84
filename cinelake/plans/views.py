"""The catalog's standing views: browse page, media detail, pipeline status, review hub, queue health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cinelake.functions.timecode import age_text
from cinelake.operators import summaries
from cinelake.operators.filters import browse_predicate, by_ids, project_scope, without_binaries
from cinelake.operators.relations import not_uploaded, with_flags
from cinelake.operators.topk import browse_order, page_of

FLAGS = {"has_transcript": "transcripts", "has_detections": "detections", "has_faces": "faces", "has_embeddings": "clip_embeddings", "has_audio_events": "audio_events", "has_captions": "captions"}


# The report's heads and the width of its state column.
GROUPS_HEAD, UNHEALTHY_HEAD, STATUS_WIDTH = "Per-group breakdown:", "Unhealthy groups:", 12


def media_browser(
    media: DataFrame, signals: dict[str, DataFrame], q: str | None = None, status: str | None = None, date_from: str | None = None,
    date_to: str | None = None, sort: str = "created_at", order: str = "desc", page: int = 1, per_page: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """(page of media with six signal flags, one-row total). The page is cut before the flags are looked up."""
    found = media.filter(browse_predicate(q, status, date_from, date_to))
    rows = page_of(found, browse_order(sort, order, "media_id"), page, per_page)
    flags = {flag: by_ids(signals[name], rows, "media_id") for flag, name in FLAGS.items() if name in signals}
    return with_flags(rows, flags, "media_id"), found.agg(F.count("*").alias("total"))


def media_detail(media: DataFrame, signals: dict[str, DataFrame], face_clusters: DataFrame, ids: DataFrame) -> DataFrame:
    """(media_id, part, payload): the chosen media with all their signals as rows, without vectors.

    A part's rows stay rows, so a clip with millions of detections is no single cell. Vectors are counted only.
    """
    chosen = by_ids(media, ids, "media_id")
    as_json = lambda df: F.to_json(F.struct(*[c for c in without_binaries(df).columns]))
    part = lambda name, df: df.select("media_id", F.lit(name).alias("part"), as_json(df).alias("payload"))
    out = part("media", chosen)
    for name, table in signals.items():
        rows = by_ids(table, chosen, "media_id")
        if name == "clip_embeddings":
            rows = rows.groupBy("media_id").agg(F.count("*").alias("embedding_count"))
        out = out.unionByName(part(name, rows))
    seen = by_ids(signals["faces"], chosen, "media_id").filter("cluster_id is not null").select("media_id", "cluster_id").distinct()
    return out.unionByName(part("face_clusters", seen.join(face_clusters, "cluster_id")))


def pipeline_status(stages: DataFrame, jobs: DataFrame, gates: DataFrame) -> DataFrame:
    """Every stage with job counts, state and gate mode. stages: stage, place."""
    counts = summaries.jobs_by_status(jobs)
    out = summaries.stage_progress(stages, counts).join(gates.select("stage", F.col("mode").alias("gate_mode")), "stage", "left")
    return out.withColumn("gate_mode", F.coalesce("gate_mode", F.lit("auto")))


def review_hub(gates: DataFrame, narratives: DataFrame, clusters: DataFrame, plans: DataFrame, uploads: DataFrame) -> DataFrame:
    """What waits for review at each waiting gate. Counts of stages without a review list are null."""
    one = lambda stage, df, label: df.agg(F.count("*").alias("pending_count")).select(F.lit(stage).alias("stage"), "pending_count", F.lit(label).alias("pending_label"))
    counts = (
        one("narrate", narratives.filter("status = 'proposed'"), "proposed narratives")
        .unionByName(one("classify", clusters.filter(~F.coalesce(F.col("excluded"), F.lit(False))), "activity clusters"))
        .unionByName(one("render", plans.filter(F.coalesce("render_path", F.lit("")) == ""), "pending renders"))
        .unionByName(one("upload", not_uploaded(plans, uploads), "pending uploads"))
    )
    return gates.filter("status = 'waiting'").select("stage").join(counts, "stage", "left")


def queue_health(queue: DataFrame, now: Column, project: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one-row summary, counts per group and state, unhealthy groups). `created_at` and `now` are in seconds."""
    scoped = project_scope(queue, project) if project else queue
    counts = summaries.queue_counts(scoped)
    summary = summaries.queue_summary(counts).withColumn("age_s", now - F.col("oldest_unhealthy_at")).drop("oldest_unhealthy_at")
    return summary.withColumn("oldest_age", age_text(F.col("age_s"))), counts, summaries.unhealthy_groups(counts)


def queue_report(queue: DataFrame, now: Column, project: str | None = None) -> DataFrame:
    """(part, key, line): the health report as ordered lines. Group names are padded to the longest one."""
    summary, counts, bad = queue_health(queue, now, project)
    named = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("total_rows", "completed", "in_flight", "dead", "retry", "pending")])
    head = F.concat(F.lit("HEALTH: "), F.when(F.col("healthy"), "HEALTHY").otherwise("UNHEALTHY"))
    age = F.concat(F.lit(" oldest_dead_age="), F.col("oldest_age"))
    tops = summary.select(F.posexplode(F.array(head, F.concat(named, F.coalesce(age, F.lit(""))))).alias("part", "line")).select("part", F.lit("").alias("key"), "line")
    group = F.coalesce(F.col("group_id").cast("string"), F.lit(""))
    width = counts.agg(F.max(F.length(group))).first()[0]  # one number
    heads = counts.agg(F.count("*").alias("n")).select(F.lit(2).alias("part"), F.lit(GROUPS_HEAD).alias("line"), "n").unionByName(
        bad.agg(F.count("*").alias("n")).select(F.lit(4).alias("part"), F.lit(UNHEALTHY_HEAD).alias("line"), "n")
    ).filter("n > 0").select("part", F.posexplode(F.array(F.lit(""), F.col("line"))).alias("place", "line")).select("part", F.col("place").cast("string").alias("key"), "line")
    padded = lambda c, n: F.rpad(c, F.greatest(F.length(c), F.lit(n)), " ")
    line = F.concat(F.lit("  "), padded(group, width or 0), F.lit("  "), padded(F.col("status"), STATUS_WIDTH), F.lit("  "), F.col("n").cast("string"))
    rows = counts.select(F.lit(3).alias("part"), F.concat_ws("|", group, "status").alias("key"), line.alias("line"))
    worst = bad.select(F.lit(5).alias("part"), group.alias("key"), F.concat(F.lit("  "), F.concat_ws("  ", group, *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("dead", "retry", "pending")])).alias("line"))
    return tops.unionByName(heads).unionByName(rows).unionByName(worst)
