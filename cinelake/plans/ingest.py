"""Taking media in: duplicates and worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.operators.filters import not_duplicate
from cinelake.operators.relations import pending_work
from cinelake.operators.skew import salted_lookup
from cinelake.operators.summaries import duplicate_groups
from cinelake.session import cut_lineage


def duplicate_pairs(media: DataFrame, digest: str = "sha256_prefix", ident: str = "id", place: str = "ingest_seq") -> DataFrame:
    """(kept_id, duplicate_id): the first-ingested member of each group with every other one.

    Ids and digests are written once, so that contents hashed on the way are read once. Groups are found by an aggregate, so a digest shared by a third of the media costs one row per task; the
    lookup back to the media is salted by the group's size.
    """
    keyed = cut_lineage(media.select(*dict.fromkeys((ident, digest, place))).filter(F.col(digest).isNotNull()))
    groups = duplicate_groups(keyed, digest, ident, place)
    members = salted_lookup(keyed.select(ident, digest), groups, [digest], "n_copies")
    return members.filter(F.col(ident) != F.col("kept_id")).select("kept_id", F.col(ident).alias("duplicate_id"))


def dedup_media(media: DataFrame, digest: str = "sha256_prefix", ident: str = "id", place: str = "ingest_seq") -> DataFrame:
    """The media table with the status of every duplicate set."""
    pairs = duplicate_pairs(media, digest, ident, place).select(F.col("duplicate_id").alias(ident)).withColumn("__dup", F.lit(True))
    marked = media.join(pairs, ident, "left")
    return marked.withColumn("status", F.when(F.col("__dup"), "duplicate").otherwise(F.col("status"))).drop("__dup")


def _approved(narratives: DataFrame) -> DataFrame:
    return narratives.filter(F.col("status") == "approved")


def worklist(stage: str, tables: dict[str, DataFrame], force: bool = False) -> DataFrame:
    """What a stage still has to do.

    ingest: scanned files not in the catalog. analyze: (media, pass) without that pass's signal. classify:
    clusters without a label. script, edl, source, render, upload: approved narratives whose prerequisites
    exist and whose result does not.
    """
    if stage == "ingest":
        return pending_work(tables["files"], tables["media"], ["media_id"], force=force)
    if stage == "analyze":
        media = not_duplicate(tables["media"]).select("media_id")
        passes = [n for n in ("transcripts", "shot_boundaries", "detections", "faces", "clip_embeddings", "audio_events") if n in tables]
        wanted = media.withColumn("pass", F.explode(F.array(*[F.lit(p) for p in passes])))
        done = None
        for name in passes:
            part = tables[name].select("media_id").distinct().withColumn("pass", F.lit(name))
            done = part if done is None else done.unionByName(part)
        return pending_work(wanted, done, ["media_id", "pass"], force=force)
    if stage == "classify":
        clusters = tables["activity_clusters"]
        return clusters if force else clusters.filter(F.coalesce("label", F.lit("")) == "")
    approved = _approved(tables["narratives"])
    key = ["narrative_id"]
    plans = tables.get("edit_plans")
    filled = lambda column: plans.filter(F.coalesce(F.col(column), F.lit("")) != "")
    if stage == "script":
        return pending_work(approved, tables["narrative_scripts"], key, force=force)
    if stage == "edl":
        return pending_work(approved, filled("edl_json"), key, [tables["narrative_scripts"]], force)
    if stage == "source":
        return pending_work(approved, tables["sourced"], key, [plans], force)
    if stage == "render":
        return pending_work(approved, filled("render_path"), key, [plans], force)
    if stage == "upload":
        return pending_work(approved, tables["uploads"], key, [filled("render_path")], force)
    raise ValueError(f"unknown stage {stage!r}")
