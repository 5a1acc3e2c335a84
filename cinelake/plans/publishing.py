"""What goes along with an upload: title, description, tags, thumbnail."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.functions.documents import json_items
from cinelake.functions.framing import combined_score, confidence_score, thirds_score
from cinelake.functions.sampling import frame_grid, step_per_second
from cinelake.operators.relations import in_listed_order
from cinelake.operators.text import joined_in_order


def catalog_classes(boxes: DataFrame) -> DataFrame:
    """Distinct object classes of the whole catalog."""
    return boxes.filter(F.coalesce("class", F.lit("")) != "").select("class").distinct()


def upload_tags(narratives: DataFrame, cluster_ids: str, clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """(narrative_id, place, tag): labels of the narrative's clusters in order, then every class of the catalog in order.

    The class part is the same for all narratives, so it is stored once under a null narrative.
    """
    named = clusters.filter(F.coalesce("label", F.lit("")) != "").select("cluster_id", "label")
    own = in_listed_order(narratives, "narrative_id", cluster_ids, named, "cluster_id").select("narrative_id", F.col("pos").cast("bigint").alias("place"), F.col("label").alias("tag"))
    none = F.lit(None).cast(dict(narratives.dtypes)["narrative_id"]).alias("narrative_id")
    return own.unionByName(classes.select(none, F.lit(None).cast("bigint").alias("place"), F.col("class").alias("tag")))


def narration(script_json):
    """The narration texts of a script's scenes, joined by blanks; null when there is none."""
    texts = F.transform(json_items(F.try_variant_get(F.try_parse_json(script_json), "$.scenes", "string")), lambda s: F.try_variant_get(s, "$.narration", "string"))
    said = F.filter(texts, lambda t: t.isNotNull() & (t != ""))
    return F.when(F.size(said) > 0, F.array_join(said, " "))


def upload_metadata(narratives: DataFrame, cluster_ids: str, scripts: DataFrame, clusters: DataFrame, classes: DataFrame, category: str = "22", privacy: str = "unlisted") -> DataFrame:
    """One row per narrative: title, description with narration, cluster tags and class tags as text, category, privacy.

    Classes are names from a detector's fixed label set; their list is one value, computed once for all rows.
    """
    tags = upload_tags(narratives, cluster_ids, clusters, classes)
    own = tags.filter("narrative_id is not null").groupBy("narrative_id").agg(joined_in_order(F.col("place"), F.col("tag"), ",").alias("cluster_tags"))
    shared = classes.agg(F.array_join(F.array_sort(F.collect_set("class")), ",")).scalar()
    said = scripts.select("narrative_id", narration(F.col("script_json")).alias("said"))
    rows = narratives.join(said, "narrative_id", "left").join(own, "narrative_id", "left").withColumn("class_tags", shared)
    text = F.concat(F.coalesce("description", F.lit("")), F.coalesce(F.concat(F.lit("\n\n"), "said"), F.lit("")))
    title = F.coalesce("title", F.col("narrative_id").cast("string"))
    return rows.select("narrative_id", title.alias("title"), text.alias("description"), F.concat_ws(",", F.nullif("cluster_tags", F.lit("")), F.nullif("class_tags", F.lit(""))).alias("tags"), F.lit(category).alias("category_id"), F.lit(privacy).alias("privacy_status"))


def candidate_frames(videos: DataFrame) -> DataFrame:
    """One frame a second. videos: video_id, total_frames, fps."""
    step = step_per_second(F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(30.0)))
    return videos.select("video_id", F.explode(frame_grid(F.col("total_frames"), step)).alias("frame_number"))


def frame_scores(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Score of each frame. frames: video_id, frame_number, sharpness, width, height; boxes per (video_id, frame_number).

    Each box is scored by itself and the best kept, so a crowded frame is never gathered.
    """
    sized = boxes.join(frames.select("video_id", "frame_number", "width", "height"), ["video_id", "frame_number"])
    one = F.array(F.struct("bbox_xywh", "confidence"))
    best = sized.groupBy("video_id", "frame_number").agg(
        F.max(thirds_score(one, F.col("width"), F.col("height"))).alias("thirds"), F.max(confidence_score(one)).alias("confidence")
    )
    scored = frames.join(best, ["video_id", "frame_number"], "left").fillna(0.0, ["thirds", "confidence"])
    return scored.withColumn("score", combined_score(F.least(F.col("sharpness"), F.lit(1.0)), F.col("thirds"), F.col("confidence")))


def rank_thumbnails(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """The best frame per video; the earliest wins ties."""
    scored = frame_scores(frames, boxes)
    place = F.struct(F.col("score"), (-F.col("frame_number")).alias("n"))
    return scored.groupBy("video_id").agg(F.max_by("frame_number", place).alias("frame_number"), F.max("score").alias("score"))
