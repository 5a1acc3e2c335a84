"""Edit plans: exploded to rows, validated, and the feedback for another attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cinelake.functions.checks import audio_level_issue, issue, message
from cinelake.functions.documents import json_field, json_objects
from cinelake.functions.text import fixed
from cinelake.functions.timecode import timecode_seconds
from cinelake.operators.ordered import with_next_clip
from cinelake.operators.skew import range_segments
from cinelake.operators.text import paged_text
from cinelake.schemas import EDL_LISTS
from cinelake.session import cut_lineage

MAX_ATTEMPTS = 4

# What a planner is told after a failed attempt.
FEEDBACK_LEAD = "\n\nThe EDL you generated has validation errors. Please fix these issues and regenerate the EDL:\n\n"
FEEDBACK_ERRORS = "**Errors:**"
FEEDBACK_WARNINGS = "\n**Warnings:**"

PLAN = ["narrative_id"]


def explode_edl(plans: DataFrame, part: str, raw: str = "edl_json") -> DataFrame:
    """Items of one of the eight lists of each plan, with their place as `pos`."""
    doc = F.try_parse_json(F.col(raw))
    listed = F.try_variant_get(doc, f"$.{part}", "string")
    items = json_objects(listed, EDL_LISTS[part], absent={"type": "cut"} if part == "transitions" else None)
    return plans.select(*PLAN, F.posexplode(items).alias("pos", "__i")).select(*PLAN, F.col("pos").cast("bigint").alias("pos"), "__i.*")


def plan_targets(plans: DataFrame, raw: str = "edl_json") -> DataFrame:
    return plans.select(*PLAN, json_field(F.col(raw), "$.target_duration_seconds", "double").alias("target_s"))


def with_seconds(clips: DataFrame) -> DataFrame:
    """Clips with their timecodes in seconds (null where unreadable) and the default track 1."""
    return clips.withColumns({
        "in_s": timecode_seconds(F.col("in_timecode")), "out_s": timecode_seconds(F.col("out_timecode")),
        "track": F.coalesce("track", F.lit(1)).cast("bigint"),
    })


def _error(check: str, name: str, *values: Column) -> Column:
    return issue("error", check, message(name, *values))


def _issues(df: DataFrame, column: Column) -> DataFrame:
    return df.withColumn("__x", column).filter("__x is not null").select(*PLAN, "__x.*")


def _listed(df: DataFrame, columns: list[Column]) -> DataFrame:
    found = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return df.select(*PLAN, F.explode(found).alias("__x")).select(*PLAN, "__x.*")


def overlap_issues(clips: DataFrame) -> DataFrame:
    """Neighbouring clips of a track that overlap. A clip without a readable out point is an error if another follows."""
    who = F.coalesce(F.col("clip_id").cast("string"), F.lit("unknown"))
    ahead = with_next_clip(clips, [*PLAN, "track"], "in_s", ["pos"], {"next_in": "in_timecode"})
    meets = _error("overlap", "overlap", F.col("track"), F.col("out_timecode"), F.col("next_in"))
    unread = _error("overlap", "out_unread", who)
    return _issues(ahead, F.when(F.col("out_s").isNull(), unread).when(F.col("out_s") > F.col("next_start"), meets))


def duration_issues(clips: DataFrame, targets: DataFrame) -> DataFrame:
    """Track-1 length outside ±10 % of a positive target; unreadable clips are errors and do not count."""
    wanted = targets.filter("target_s > 0")
    who = F.coalesce(F.col("clip_id").cast("string"), F.lit("unknown"))
    first = clips.filter("track = 1")
    unread = _issues(
        first.filter("in_s is null or out_s is null").join(wanted.select(*PLAN), PLAN, "left_semi"),
        _error("duration", "length_unread", who),
    )
    totals = first.groupBy(*PLAN).agg(F.sum(F.col("out_s") - F.col("in_s")).alias("total_s"))
    judged = wanted.join(totals, PLAN, "left").withColumn("total_s", F.coalesce("total_s", F.lit(0.0)))
    total, target = F.col("total_s"), F.col("target_s")
    low, high = target * 0.9, target * 1.1
    off = _error("duration", "length", *[fixed(x, 1) for x in (total, target, low, high)])
    return unread.unionByName(_issues(judged, F.when((total < low) | (total > high), off)))


def missing_clip_issues(clips: DataFrame, media: DataFrame) -> DataFrame:
    """Each clip id a plan uses that the catalog lacks, once."""
    empty = F.lit("").cast(dict(clips.dtypes)["clip_id"]) if dict(clips.dtypes)["clip_id"] == "string" else F.lit(None)
    used = clips.select(*PLAN, F.coalesce("clip_id", empty).alias("clip_id")).distinct()
    gone = used.join(media.select("clip_id"), "clip_id", "left_anti")
    return _issues(gone, _error("clip_id", "no_clip", F.col("clip_id")))


def clip_issues(clips: DataFrame, media: DataFrame) -> DataFrame:
    """What is wrong with a clip on its own: unreadable timecodes, in and out points against each other and the
    media's length. media: clip_id, duration_seconds (any type)."""
    rows = clips.join(media.select("clip_id", F.col("duration_seconds").alias("__raw"), F.lit(True).alias("__known")), "clip_id", "left")
    length = F.col("__raw").try_cast("double")
    clip, none = F.col("clip_id").cast("string"), F.lit(None)
    who, named = F.coalesce(clip, F.lit("")), F.coalesce(clip, F.lit("unknown"))
    ins, outs = F.col("in_timecode"), F.col("out_timecode")
    readable = F.col("in_s").isNotNull() & F.col("out_s").isNotNull()
    ordered = readable & (F.col("in_s") < F.col("out_s"))
    measured = ordered & F.col("__known").isNotNull()
    return _listed(rows, [
        F.when(F.col("in_s").isNull(), _error("overlap", "in_unread", named)).otherwise(none),
        F.when(~readable, _error("bounds", "unread", who)),
        F.when(readable & ~ordered, _error("bounds", "backwards", who, ins, outs)),
        F.when(measured & length.isNull(), _error("bounds", "no_duration", who)),
        F.when(measured & (F.col("out_s") > length), _error("bounds", "out_beyond", who, outs, fixed(length, 1))),
        F.when(measured & (F.col("in_s") > length), _error("bounds", "in_beyond", who, ins, fixed(length, 1))),
    ])


def level_issues(levels: DataFrame) -> DataFrame:
    return _issues(levels, audio_level_issue(F.col("clip_id").cast("string"), F.col("level_db")))


def edl_issues(clips: DataFrame, targets: DataFrame, media: DataFrame, levels: DataFrame) -> DataFrame:
    """All findings as (narrative_id, severity, check, message). `clips` come from `with_seconds`.

    Parsed clips are written once and read by every check, as parsing costs far more than reading.
    """
    parsed = cut_lineage(clips.select(*PLAN, "pos", "track", "clip_id", "in_timecode", "out_timecode", "in_s", "out_s"))
    return (
        overlap_issues(parsed).unionByName(duration_issues(parsed, targets)).unionByName(missing_clip_issues(parsed, media))
        .unionByName(clip_issues(parsed, media)).unionByName(level_issues(levels))
    )


def verdicts(subjects: DataFrame, issues: DataFrame, keys: list[str] = PLAN) -> DataFrame:
    """Errors and warnings per subject; it passes without errors, warnings do not fail it."""
    counted = issues.groupBy(*keys).agg(
        F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings")
    )
    return subjects.select(*keys).distinct().join(counted, keys, "left").fillna(0, ["n_errors", "n_warnings"]).withColumn("passed", F.col("n_errors") == 0)


def validate_edl(plans: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, issues) of stored plans (narrative_id, edl_json)."""
    clips = with_seconds(explode_edl(plans, "clips"))
    issues = edl_issues(clips, plan_targets(plans), media, explode_edl(plans, "audio_settings"))
    return verdicts(plans, issues), issues


def edl_feedback(verdict_rows: DataFrame, issues: DataFrame, attempts: DataFrame, page_rows: int = 500) -> DataFrame:
    """(narrative_id, attempt, page, feedback) for failed plans with attempts left.

    attempts: narrative_id, attempt (from 1). Errors come first, then warnings; long lists go on in further pages.
    """
    retry = verdict_rows.filter(~F.col("passed")).join(attempts, "narrative_id").filter(F.col("attempt") < MAX_ATTEMPTS)
    order = F.when(F.col("severity") == "error", 0).otherwise(1)
    # The heading of each list goes in front of its first line.
    lines = issues.join(retry.select("narrative_id", "attempt"), "narrative_id").withColumns({"__o": order, "line": F.concat(F.lit("- "), "message")})
    firsts = lines.groupBy("narrative_id", "attempt", "__o").agg(F.lit(1).alias("one")).select(
        "narrative_id", "attempt", "__o", F.lit("").alias("check"), F.lit("").alias("message"),
        F.when(F.col("__o") == 0, FEEDBACK_ERRORS).otherwise(FEEDBACK_WARNINGS).alias("line"),
    )
    # Headings sort before messages: their check is empty.
    rows = lines.select("narrative_id", "attempt", "__o", "check", "message", "line").unionByName(firsts)
    segment = range_segments(rows, ["narrative_id", "attempt"], ["__o", "check", "message"])
    body = paged_text(segment, ["narrative_id", "attempt"], "__segment", ["__o", "check", "message"], "line", "\n", "lines", page_rows)
    return body.select("narrative_id", "attempt", "page", F.concat(F.when(F.col("page") == 0, FEEDBACK_LEAD).otherwise(""), F.col("lines")).alias("feedback"))
