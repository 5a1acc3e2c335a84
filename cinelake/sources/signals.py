"""JSON columns of the catalog as rows. A broken list yields no rows; a broken element is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.functions.documents import json_is_array, json_objects, json_strings
from cinelake.functions.records import shot_seconds
from cinelake.schemas import DETECTION


def transcript_segments(transcripts: DataFrame) -> DataFrame:
    fields = {"start": "double", "end": "double", "text": "string", "speaker": "string"}
    items = json_objects(F.col("segments_json"), fields, ("text", "start", "end"))
    return transcripts.select("media_id", F.posexplode(items).alias("pos", "s")).select(
        "media_id", "pos", F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), "s.text", "s.speaker"
    )


def detection_boxes(detections: DataFrame) -> DataFrame:
    items = json_objects(F.col("detections_json"), DETECTION)
    return detections.select("media_id", "frame_number", F.posexplode(items).alias("pos", "d")).select("media_id", "frame_number", "pos", "d.*")


def audio_classes(events: DataFrame) -> DataFrame:
    items = json_objects(F.col("events_json"), {"class": "string", "probability": "double"}, ("class",))
    return events.select("media_id", F.col("timestamp_seconds").alias("ts_s"), F.posexplode(items).alias("pos", "e")).select("media_id", "ts_s", "pos", "e.*")


def shots(boundaries: DataFrame, media: DataFrame, place: str | None = None) -> DataFrame:
    """Shots of the first stored method per media, in seconds; one shot over the whole clip where there is none."""
    fields = {"start_time": "double", "end_time": "double", "start_frame": "bigint", "end_frame": "bigint"}
    order = [place, "method"] if place else ["method"]
    first = boundaries.groupBy("media_id").agg(F.min_by("boundaries_json", F.struct(*order)).alias("boundaries_json"))
    one = F.array(F.struct(*[F.lit(None).cast(t).alias(n) for n, t in fields.items()]))
    listed = media.select("media_id", "fps", "duration_seconds").join(first, "media_id", "left").withColumn(
        "items", json_objects(F.col("boundaries_json"), fields)
    )
    filled = listed.select("media_id", "fps", "duration_seconds", F.posexplode(F.when(F.size("items") > 0, F.col("items")).otherwise(one)).alias("shot_pos", "b"))
    start, end = shot_seconds(F.col("b.start_time"), F.col("b.end_time"), F.col("b.start_frame"), F.col("b.end_frame"), F.col("fps"), F.col("duration_seconds"))
    return filled.select("media_id", "shot_pos", start.alias("start_s"), end.alias("end_s"))


def cluster_members(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cluster_id, pos, media_id) of readable member lists, and the clusters whose list is not readable."""
    good = json_is_array(F.col("clip_ids_json"))
    members = clusters.filter(good).select("cluster_id", F.posexplode(json_strings(F.col("clip_ids_json"))).alias("pos", "media_id"))
    return members, clusters.filter(~good).select("cluster_id", F.lit("corrupt clip_ids_json").alias("reason"))
