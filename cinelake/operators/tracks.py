"""Keyframe detections to detections on every frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.functions.framing import lerp, lerp_box
from cinelake.operators.skew import neighbour_across

_KEYS = ["media_id"]


def keyframe_gaps(keyframes: DataFrame, media: DataFrame, segment_frames: int = 4096) -> DataFrame:
    """Frames to fill, in runs (media_id, gap, kind, frame_from, frame_to, f0, f1).

    `gap` is the keyframe the run hangs on. Between two keyframes the kind is `between`; before the first one
    and after the last one it is `hold`. `media` brings total_frames and step, the sampling distance.
    """
    keys = keyframes.select("media_id", "frame_number").distinct()
    cut = keys.withColumn("__segment", F.floor(F.col("frame_number") / segment_frames).cast("bigint"))
    ahead = neighbour_across(cut, _KEYS, "__segment", ["frame_number"], {"f1": "frame_number"}, ahead=True).drop("__segment")
    first = keys.groupBy("media_id").agg(F.min("frame_number").alias("frame_number"))
    sized = media.select("media_id", "total_frames", "step")
    inner = ahead.join(sized, "media_id").select(
        "media_id", F.col("frame_number").alias("gap"), F.when(F.col("f1").isNull(), "hold").otherwise("between").alias("kind"),
        (F.col("frame_number") + 1).alias("frame_from"), (F.coalesce("f1", "total_frames") - 1).alias("frame_to"),
        F.col("frame_number").alias("f0"), "f1", "step",
    )
    lead_in = first.join(sized, "media_id").select(
        "media_id", F.col("frame_number").alias("gap"), F.lit("hold").alias("kind"), F.lit(0).cast("bigint").alias("frame_from"),
        (F.col("frame_number") - 1).alias("frame_to"), F.col("frame_number").alias("f0"),
        F.lit(None).cast("bigint").alias("f1"), "step",
    )
    return inner.unionByName(lead_in).filter(F.col("frame_from") <= F.col("frame_to"))


def filled_frames(gaps: DataFrame) -> DataFrame:
    """The frames of each run. Frames of the sampling grid are never filled, even if they failed to decode."""
    frames = gaps.withColumn("frame_number", F.explode(F.sequence("frame_from", "frame_to")))
    return frames.filter(F.col("frame_number") % F.col("step") != 0)


def gap_tracks(boxes: DataFrame, gaps: DataFrame) -> DataFrame:
    """Boxes of each track at both ends of a run between keyframes. The last box of a repeated track id counts.

    Both ends come together in one grouping, which is a full outer join on a track id that may be null.
    """
    box = F.struct("class", "bbox_xywh", "confidence")
    between = gaps.filter("kind = 'between'")
    spans = between.groupBy("media_id", "gap").agg(F.min("f1").alias("f1"))
    before = boxes.join(spans.select("media_id", F.col("gap").alias("frame_number"), F.col("gap").alias("g")), ["media_id", "frame_number"])
    after = boxes.join(spans.select("media_id", F.col("f1").alias("frame_number"), F.col("gap").alias("g")), ["media_id", "frame_number"])
    side = lambda df, at_start: df.select("media_id", "g", "track_id", "pos", F.lit(at_start).alias("at_start"), box.alias("box"))
    both = side(before, True).unionByName(side(after, False))
    return both.groupBy("media_id", F.col("g").alias("gap"), "track_id").agg(
        F.max_by("box", F.when(F.col("at_start"), F.col("pos"))).alias("before"),
        F.max_by("box", F.when(~F.col("at_start"), F.col("pos"))).alias("after"),
    )


def interpolated_boxes(boxes: DataFrame, gaps: DataFrame) -> DataFrame:
    """Boxes on the filled frames: linear between two keyframes, held where a track has one end only."""
    frames = filled_frames(gaps)
    t = (F.col("frame_number") - F.col("f0")) / (F.col("f1") - F.col("f0"))
    two = F.col("before").isNotNull() & F.col("after").isNotNull()
    one = F.coalesce("before", "after")
    moving = (
        frames.filter("kind = 'between'")
        .join(gap_tracks(boxes, gaps), ["media_id", "gap"])
        .select(
            "media_id", "frame_number", "track_id", one["class"].alias("class"),
            F.when(two, lerp_box(F.col("before.bbox_xywh"), F.col("after.bbox_xywh"), t)).otherwise(one["bbox_xywh"]).alias("bbox_xywh"),
            F.when(two, lerp(F.col("before.confidence"), F.col("after.confidence"), t)).otherwise(one["confidence"]).alias("confidence"),
        )
    )
    held = (
        frames.filter("kind = 'hold'").select("media_id", "frame_number", "gap")
        .join(boxes.withColumnRenamed("frame_number", "gap"), ["media_id", "gap"])
        .select("media_id", "frame_number", "track_id", "class", "bbox_xywh", "confidence")
    )
    return moving.unionByName(held)


def dense_tracks(boxes: DataFrame, keyframes: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All frames with a detection list (it may be empty) and all boxes, each marked sampled or not.

    boxes: media_id, frame_number, pos, track_id, class, bbox_xywh, confidence; keyframes: media_id,
    frame_number; media: media_id, total_frames, step.
    """
    gaps = keyframe_gaps(keyframes, media)
    sampled = keyframes.select("media_id", "frame_number").distinct().withColumn("sampled", F.lit(True))
    frames = sampled.unionByName(filled_frames(gaps).select("media_id", "frame_number", F.lit(False).alias("sampled")))
    kept = boxes.select("media_id", "frame_number", "track_id", "class", "bbox_xywh", "confidence", F.lit(True).alias("sampled"))
    return frames, kept.unionByName(interpolated_boxes(boxes, gaps).withColumn("sampled", F.lit(False)))
