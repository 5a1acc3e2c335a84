"""Crop paths: where the crop window lies on every frame of a clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.functions.framing import corner_clamped, crop_window, thirds_centre
from cinelake.functions.timecode import timecode_seconds
from cinelake.operators.intervals import point_join
from cinelake.operators.ordered import fill_gaps, smooth, smoothing_alpha
from cinelake.operators.summaries import subject_track
from cinelake.session import cut_lineage

ENTRY = ["entry_id"]
MODES = ("center", "manual_offset", "stabilize_only", "auto_subject")


def crop_entries(entries: DataFrame, media: DataFrame, source_w: int, source_h: int, default_tau: float) -> tuple[DataFrame, DataFrame]:
    """(entries with window, frame range and rate; rejects).

    entries: entry_id, media_id, target_aspect, mode, subject_track_id, in_timecode, out_timecode, offset_x,
    offset_y, smoothing_tau. media: media_id, fps, duration_seconds.
    """
    sized = entries.join(media.select("media_id", "fps", "duration_seconds", F.lit(True).alias("__known")), "media_id", "left")
    rate = F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(30.0))
    start = timecode_seconds(F.coalesce("in_timecode", F.lit("00:00:00.000")))
    end = F.when(F.coalesce("out_timecode", F.lit("")) != "", timecode_seconds(F.col("out_timecode"))).otherwise(F.coalesce("duration_seconds", F.lit(0.0)))
    window = crop_window(F.lit(source_w), F.lit(source_h), F.col("target_aspect"))
    ready = sized.withColumns({"mode": F.coalesce("mode", F.lit("center")), "rate": rate, "start_s": start, "end_s": end, "crop": window, "tau": F.coalesce("smoothing_tau", F.lit(default_tau))})
    ready = ready.withColumns({
        "n_frames": F.greatest(F.lit(1), F.ceil((F.col("end_s") - F.col("start_s")) * F.col("rate"))).cast("bigint"),
        "frame_start": F.floor(F.col("start_s") * F.col("rate")).cast("bigint"),
    })
    reason = (
        F.when(F.col("crop").isNull(), "bad aspect ratio")
        .when(F.col("__known").isNull(), "media not found")
        .when(F.col("start_s").isNull() | F.col("end_s").isNull(), "bad timecode")
        .when(~F.col("mode").isin(*MODES), "unknown crop mode")
        .when((F.col("mode") == "auto_subject") & (F.col("tau") <= 0), "smoothing_tau must be positive")
    )
    judged = ready.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason", "__known"), judged.filter("reason is not null").select(*ENTRY, "reason")


def _frames(entries: DataFrame) -> DataFrame:
    return entries.withColumn("frame_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_frames") - 1)))


def crop_paths(entries: DataFrame, media: DataFrame, boxes: DataFrame, source_w: int, source_h: int, default_tau: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(entry_id, media_id, target_aspect, track_id, frame_index, crop_x, crop_y) and rejects (entry_id, reason)."""
    good, rejects = crop_entries(entries, media, source_w, source_h, default_tau)
    sw, sh = F.lit(float(source_w)), F.lit(float(source_h))
    cw, ch = F.col("crop.w").cast("double"), F.col("crop.h").cast("double")
    keep = [*ENTRY, "media_id", "target_aspect", "track_id", "frame_index", "crop_x", "crop_y"]

    shift = lambda c: F.when(F.col("mode") == "manual_offset", F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    still = _frames(good.filter("mode <> 'auto_subject'")).withColumns({
        "track_id": F.lit(None).cast("bigint"),
        "crop_x": corner_clamped(sw / 2 + shift("offset_x"), cw, sw), "crop_y": corner_clamped(sh / 2 + shift("offset_y"), ch, sh),
    }).select(*keep)

    tracked = good.filter("mode = 'auto_subject'").withColumn("frame_end", F.col("frame_start") + F.col("n_frames") - 1)
    spans = tracked.select(*ENTRY, "media_id", "frame_start", "frame_end")
    # The detections of the tracked clips are looked up once and used three times.
    seen = cut_lineage(point_join(boxes, spans, ["media_id"], "frame_number", ("frame_start", "frame_end"), 1800.0))
    chosen = subject_track(seen, ENTRY, ["frame_number", "pos"]).select(*ENTRY, F.col("track_id").alias("__auto"))
    subjects = tracked.join(chosen, ENTRY, "left").withColumn("track_id", F.coalesce("subject_track_id", "__auto").cast("bigint"))
    lost = subjects.filter("track_id is null").select(*ENTRY, F.lit("no tracked detections").alias("reason"))
    followed = subjects.filter("track_id is not null")

    own = seen.join(followed.select(*ENTRY, "track_id", "frame_start", "crop"), [*ENTRY, "track_id", "frame_start"])
    first = own.groupBy(*ENTRY, (F.col("frame_number") - F.col("frame_start")).alias("frame_index"), "crop").agg(F.min_by("bbox_xywh", "pos").alias("box"))
    # A box of fewer than four numbers cannot be framed; its entry fails as a whole.
    broken = first.filter(F.size("box") < 4).select(*ENTRY).distinct()
    cx, cy = thirds_centre(F.col("box")[0], F.col("box")[1], F.col("box")[3], F.col("crop.w").cast("double"), F.col("crop.h").cast("double"))
    points = first.filter(F.size("box") >= 4).select(*ENTRY, "frame_index", cx.alias("x"), cy.alias("y"))
    usable = followed.join(broken, ENTRY, "left_anti")
    raw = cut_lineage(_frames(usable).join(points, [*ENTRY, "frame_index"], "left"))
    filled = fill_gaps(raw, ENTRY, "frame_index", "x", "y", F.col("rate"), sw / 2, sh / 2)
    smoothed = smooth(filled, ENTRY, "frame_index", ["x", "y"], smoothing_alpha(F.col("tau"), F.col("rate")))
    moving = smoothed.withColumns({"crop_x": corner_clamped(F.col("x"), cw, sw), "crop_y": corner_clamped(F.col("y"), ch, sh)}).select(*keep)
    bad = rejects.unionByName(lost).unionByName(broken.withColumn("reason", F.lit("malformed box")))
    return still.unionByName(moving), bad
