"""Timelines: resolved render inputs, timeline rows, subtitles and the difference to an edited timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.functions.checks import render_route
from cinelake.functions.documents import canonical_hash
from cinelake.operators.ordered import timeline_offsets
from cinelake.operators.skew import range_segments, row_number_across
from cinelake.sources.documents import srt_cue

PLAN = ["narrative_id"]

# How far a clip may move unnoticed, and the length of a transition that gives none.
TOLERANCE_S = 0.05
DEFAULT_TRANSITION_S = 0.5
# What a timeline calls the transitions of a plan, and the note on those that only stand in for a fade.
TIMELINE_TRANSITIONS = {"crossfade": "SMPTE_Dissolve", "dissolve": "SMPTE_Dissolve", "fade_in": "SMPTE_Dissolve", "fade_out": "SMPTE_Dissolve"}
OTHER_TRANSITION = "SMPTE_Dissolve"
FADES = ("fade_in", "fade_out")
FADE_NOTE = "Rendered as SMPTE_Dissolve (cross-dissolve between adjacent clips). True fade-to/from-black requires an opacity-based Effect on the clip."


def render_inputs(clips: DataFrame, media: DataFrame, crop_modes: DataFrame, crop_tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inputs, rejects) for rendering. media: clip_id, file_path; crop_tracks: clip_id, subject_track_id of stored paths.

    A clip's own source path wins over the catalog's. A slow clip needs an id and a stored crop path.
    """
    modes = crop_modes.groupBy(*PLAN, "clip_id").agg(F.max_by(F.struct("mode", "subject_track_id"), "pos").alias("__m"))
    joined = (
        clips.join(media.select("clip_id", "file_path"), "clip_id", "left")
        .join(modes, [*PLAN, "clip_id"], "left")
        .withColumns({"mode": F.coalesce("__m.mode", F.lit("center")), "subject_track_id": F.coalesce("__m.subject_track_id", F.lit(0)).cast("bigint")})
        .join(crop_tracks.select("clip_id", "subject_track_id", F.lit(True).alias("__path")).distinct(), ["clip_id", "subject_track_id"], "left")
        .withColumns({"source": F.coalesce("source_path", "file_path"), "route": render_route(F.col("overlay"), F.col("mode"), F.col("clip_id"))})
    )
    slow = F.col("route") == "slow"
    reason = (
        F.when(F.col("clip_id").isNull() & F.col("source_path").isNull(), "no clip id and no source path")
        .when(F.col("source").isNull(), "no media record")
        .when(slow & F.col("clip_id").isNull(), "slow clip without id")
        .when(slow & F.col("__path").isNull(), "no crop path for slow clip")
    )
    judged = joined.withColumn("reason", reason).withColumn("has_crop", F.coalesce("__path", F.lit(False)))
    columns = [*PLAN, "pos", "clip_id", "source", "mode", "subject_track_id", "route", "has_crop"]
    return judged.filter("reason is null").select(*columns), judged.filter("reason is not null").select(*PLAN, "pos", "clip_id", "reason")


def timeline_rows(clips: DataFrame, media: DataFrame, transitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clip rows, transition rows). Clips of a track are in order of their in point, numbered from 0.

    A transition sits after the clip at its position; cuts are implicit, and half its length goes to each side. A type that is null or
    unknown falls back to a dissolve under its own name; fades carry a note that they are approximated.
    """
    placed = clips.join(media.select("clip_id", "file_path", "fps"), "clip_id", "left")
    cut = range_segments(placed, [*PLAN, "track"], ["in_s", "pos"])
    numbered = row_number_across(cut, [*PLAN, "track"], "__segment", ["in_s", "pos"], "__n")
    rows = numbered.select(
        *PLAN, "track", (F.col("__n") - 1).alias("place"), "clip_id", F.coalesce("file_path", F.col("clip_id").cast("string")).alias("target"),
        "in_s", (F.col("out_s") - F.col("in_s")).alias("duration_s"), F.coalesce("fps", F.lit(30.0)).alias("fps"),
    )
    kept = transitions.withColumn("type", F.coalesce("type", F.lit(""))).filter("type <> 'cut'").withColumns({
        "track": F.coalesce("track", F.lit(1)).cast("bigint"), "place": F.coalesce(F.col("position").try_cast("bigint"), F.lit(0)).cast("bigint"),
        "__half": F.coalesce(F.nullif("duration", F.lit(0.0)), F.lit(DEFAULT_TRANSITION_S)) / F.lit(2.0),
    })
    last = kept.groupBy(*PLAN, "track", "place").agg(F.max_by(F.struct("type", "__half"), "pos").alias("t"))
    marks = last.join(rows.select(*PLAN, "track", "place"), [*PLAN, "track", "place"], "left_semi")
    named = F.coalesce(*(F.when(F.col("t.type") == ours, theirs) for ours, theirs in TIMELINE_TRANSITIONS.items()), F.lit(OTHER_TRANSITION))
    note = F.when(F.col("t.type").isin(*FADES), F.lit(FADE_NOTE))
    return rows, marks.select(*PLAN, "track", "place", F.col("t.type").alias("type"), named.alias("transition_type"), note.alias("approximation"), F.col("t.__half").alias("in_offset_s"), F.col("t.__half").alias("out_offset_s"))


def plan_hashes(clips: DataFrame) -> DataFrame:
    """A hash of each clip's content per plan, combined over the plan, to tell whether a plan changed.

    Rows are hashed where they are and the hashes summed, so plans of any length cost one row per task.
    """
    row = canonical_hash(F.struct(*sorted(c for c in clips.columns if c not in PLAN)))
    digest = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return clips.groupBy(*PLAN).agg(F.sha2(F.concat_ws(":", F.sum(digest).cast("string"), F.count("*").cast("string")), 256).alias("edl_hash"))


def timeline_diff(planned: DataFrame, actual: DataFrame, tolerance: float = TOLERANCE_S) -> DataFrame:
    """(narrative_id, change, clip_id, planned, actual): what an edited timeline changed.

    Both sides: narrative_id, track, clip_id, pos, in_s, out_s. An id used twice is compared with its last use.
    """
    last = actual.groupBy(*PLAN, "clip_id").agg(F.max_by(F.struct("in_s", "out_s"), "pos").alias("a"))
    both = planned.join(last, [*PLAN, "clip_id"], "left")
    span = lambda a, b: F.col(b) - F.col(a)
    length, got = span("in_s", "out_s"), span("a.in_s", "a.out_s")
    item = lambda change, p, a: F.struct(F.lit(change).alias("change"), p.cast("double").alias("planned"), a.cast("double").alias("actual"))
    per_clip = F.when(F.col("a").isNull(), F.array(item("missing", F.col("in_s"), F.lit(None)))).otherwise(F.array(
        F.when(F.abs(F.col("a.in_s") - F.col("in_s")) > tolerance, item("start", F.col("in_s"), F.col("a.in_s"))),
        F.when(F.abs(got - length) > tolerance, item("duration", length, got)),
    ))
    clip_rows = both.select(*PLAN, "clip_id", F.explode(F.filter(per_clip, lambda x: x.isNotNull())).alias("c")).select(*PLAN, "c.change", "clip_id", "c.planned", "c.actual")
    size = lambda df, p: df.groupBy(*PLAN, "track").agg(F.count("*").alias("n")).groupBy(*PLAN).agg(F.sum("n").alias(p + "_clips"), F.count("*").alias(p + "_tracks"))
    sizes = size(planned, "p").join(size(actual, "a"), PLAN, "left").fillna(0)
    counts = F.array(
        F.when(F.col("p_clips") != F.col("a_clips"), item("clip_count", F.col("p_clips"), F.col("a_clips"))),
        F.when(F.col("p_tracks") != F.col("a_tracks"), item("track_count", F.col("p_tracks"), F.col("a_tracks"))),
    )
    count_rows = sizes.select(*PLAN, F.explode(F.filter(counts, lambda x: x.isNotNull())).alias("c")).select(
        *PLAN, "c.change", F.lit(None).cast(dict(planned.dtypes)["clip_id"]).alias("clip_id"), "c.planned", "c.actual"
    )
    return clip_rows.unionByName(count_rows)


def subtitles(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """(narrative_id, cue, start_s, end_s, text, srt): speech of the plan's clips shifted to the timeline.

    clips: narrative_id, pos, clip_id, in_s, out_s; a clip without an out point has no length.
    segments: clip_id, pos, start_s, end_s, text.
    """
    length = F.coalesce("out_s", "in_s") - F.col("in_s")
    placed = timeline_offsets(clips, PLAN, "pos", ["clip_id"], length)
    spoken = placed.select(*PLAN, F.col("pos").alias("clip_pos"), "clip_id", "offset_s").join(
        segments.select("clip_id", F.col("pos").alias("seg_pos"), "start_s", "end_s", "text"), "clip_id"
    )
    shifted = spoken.withColumns({"start_s": F.coalesce("start_s", F.lit(0.0)) + F.col("offset_s"), "end_s": F.coalesce("end_s", F.lit(0.0)) + F.col("offset_s")})
    cut = shifted.withColumn("__segment", F.struct("clip_pos", "clip_id", F.floor(F.col("seg_pos") / 1000)))
    numbered = row_number_across(cut, PLAN, "__segment", ["clip_pos", "clip_id", "seg_pos"], "cue")
    return numbered.select(*PLAN, "cue", "start_s", "end_s", "text", srt_cue(F.col("cue"), F.col("start_s"), F.col("end_s"), F.coalesce("text", F.lit(""))).alias("srt"))
