"""Checks of rendered files from their probe data and measurement logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cinelake.functions.checks import issue, message, render_codec_issue, render_duration_issue, render_resolution_issue, render_size_issue
from cinelake.functions.documents import json_field
from cinelake.functions.text import fixed
from cinelake.operators.intervals import not_contained
from cinelake.plans.edit_plans import verdicts

# Patterns of the measurement logs.
LOUDNESS_BLOCK = r"\{[^}]+\}"
BLACK = r"black_start:(\S+)\s+black_end:(\S+)\s+black_duration:(\S+)"
SILENCE = r"(?s)silence_start:\s*(\S+).*?silence_end:\s*(\S+)\s*\|\s*silence_duration:\s*(\S+)"

RENDER = ["render_id"]


def probe_issues(renders: DataFrame, want_w: int = 1920, want_h: int = 1080, want_codec: str = "h264") -> DataFrame:
    """Duration, resolution, codec and size findings. renders: render_id, duration_seconds, target_s, width, height, codec, size_bytes."""
    c = F.col
    found = F.array(
        render_duration_issue(c("duration_seconds"), c("target_s")), render_resolution_issue(c("width"), c("height"), want_w, want_h),
        render_codec_issue(c("codec"), want_codec), render_size_issue(c("size_bytes"), c("duration_seconds"), want_w, want_h, want_codec),
    )
    return renders.select(*RENDER, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(*RENDER, "x.*")


def loudness(logs: DataFrame, log: str = "loudness_log") -> DataFrame:
    """Measured loudness per render, null where the log has none that can be read."""
    block = F.regexp_extract(F.coalesce(F.col(log), F.lit("")), LOUDNESS_BLOCK, 0)
    return logs.select(*RENDER, (block != "").alias("has_block"), json_field(block, "$.input_i", "string").try_cast("double").alias("lufs"))


def loudness_issues(measured: DataFrame, target: float = -14.0) -> DataFrame:
    """Loudness more than 1 LUFS off the target, or not readable."""
    text = message("loudness", fixed(F.col("lufs"), 1), F.lit(str(target)))
    found = (
        F.when(~F.col("has_block"), issue("error", "loudness", message("no_loudness_block")))
        .when(F.col("lufs").isNull(), issue("error", "loudness", message("no_loudness")))
        .when(F.abs(F.col("lufs") - target) > 1.0, issue("error", "loudness", text))
    )
    return measured.withColumn("x", found).filter("x is not null").select(*RENDER, "x.*")


def measured_spans(logs: DataFrame, log: str, pattern: str) -> DataFrame:
    """(render_id, pos, raw texts s, e, d and numbers start_s, end_s, duration_s) of each match in a log."""
    groups = [F.regexp_extract_all(F.coalesce(F.col(log), F.lit("")), F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    starts, ends, lengths = groups
    rows = logs.select(*RENDER, starts.alias("__s"), ends.alias("__e"), lengths.alias("__d"))
    zipped = rows.select(*RENDER, F.posexplode(F.arrays_zip("__s", "__e", "__d")).alias("pos", "m"))
    texts = zipped.select(*RENDER, "pos", F.col("m.__s").alias("s"), F.col("m.__e").alias("e"), F.col("m.__d").alias("d"))
    return texts.withColumns({n: F.col(c).try_cast("double") for n, c in (("start_s", "s"), ("end_s", "e"), ("duration_s", "d"))})


def _readable() -> Column:
    return F.col("start_s").isNotNull() & F.col("end_s").isNotNull() & F.col("duration_s").isNotNull()


def black_issues(logs: DataFrame, log: str = "black_log") -> DataFrame:
    spans = measured_spans(logs, log, BLACK)
    texts = [F.col(c) for c in ("s", "e", "d")]
    raw, text = message("black_unread", *texts), message("black", *texts)
    return spans.select(*RENDER, issue("warning", "black_frames", F.when(_readable(), text).otherwise(raw)).alias("x")).select(*RENDER, "x.*")


def silence_issues(logs: DataFrame, intentional: DataFrame, log: str = "silence_log", width_s: float = 60.0) -> DataFrame:
    """Silences not wholly inside an intentional one. intentional: render_id, start, end."""
    spans = measured_spans(logs, log, SILENCE)
    raw = message("silence_unread", *[F.col(c) for c in ("s", "e", "d")])
    text = message("silence", *[fixed(F.col(c), 1) for c in ("start_s", "end_s", "duration_s")])
    heard = not_contained(spans.filter(_readable()), intentional, RENDER, ("start_s", "end_s"), ("start", "end"), width_s)
    found = heard.withColumn("message", text).unionByName(spans.filter(~_readable()).withColumn("message", raw))
    return found.select(*RENDER, F.lit("warning").alias("severity"), F.lit("silence").alias("check"), "message")


def render_qa(renders: DataFrame, logs: DataFrame, intentional: DataFrame, target_lufs: float = -14.0, want_w: int = 1920, want_h: int = 1080, want_codec: str = "h264") -> tuple[DataFrame, DataFrame]:
    """(verdicts with measurements, issues) of rendered files."""
    volume = loudness(logs)
    issues = (
        probe_issues(renders, want_w, want_h, want_codec).unionByName(loudness_issues(volume, target_lufs))
        .unionByName(black_issues(logs)).unionByName(silence_issues(logs, intentional))
    )
    mb = F.round(F.col("size_bytes") / F.lit(1048576.0), 2).alias("file_size_mb")
    measured = renders.select(*RENDER, "duration_seconds", "width", "height", "codec", mb).join(volume.select(*RENDER, "lufs"), RENDER, "left")
    return verdicts(renders, issues, RENDER).join(measured, RENDER), issues
