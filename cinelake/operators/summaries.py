"""Aggregates over signals, jobs and queues. All combine on the map side before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from cinelake.functions.text import fill, fixed
from cinelake.operators.text import joined_in_order
from cinelake.operators.topk import top_k


def duplicate_groups(media: DataFrame, digest: str, ident: str, place: str) -> DataFrame:
    """Groups of equal digests with their size and first-ingested member; a null digest matches nothing."""
    return (
        media.filter(F.col(digest).isNotNull())
        .groupBy(digest)
        .agg(F.min_by(ident, place).alias("kept_id"), F.count("*").alias("n_copies"))
        .filter("n_copies > 1")
    )


def class_counts(rows: DataFrame, keys: Sequence[str], label: str, place: Sequence[str]) -> DataFrame:
    """Rows per class with the place of the first one, which settles ties."""
    return rows.groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("first_place"))


def top_classes(rows: DataFrame, keys: Sequence[str], label: str, place: Sequence[str], n: int, name: str) -> DataFrame:
    """`class (count), ...` of the n most frequent classes per key; earlier classes win ties."""
    counted = class_counts(rows, keys, label, place)
    best = top_k(counted, keys, [F.col("n").desc(), F.col("first_place").asc(), F.col(label).asc()], n)
    text = F.concat(F.col(label), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return best.groupBy(*keys).agg(joined_in_order(F.col("rank"), text, ", ").alias(name))


# Sentences about picture quality.
QUALITY_MEAN = "Avg detection confidence: {}"
QUALITY_WEAK = "Some low-confidence frames (min: {}) - possible motion blur or poor framing"
QUALITY_GOOD = "Overall good visual quality"
QUALITY_FAIR = "Moderate visual quality"
QUALITY_POOR = "Low visual quality - many unclear frames"


def exact_sum(value: Column, digits: int) -> Column:
    """The sum of doubles taken to `digits` decimals, the same in whatever order rows are added; null if there are none. Values that a decimal cannot hold (1e19 and more, NaN) are added as they are."""
    exact = value.try_cast(f"decimal({19 + digits},{digits})")
    rest = F.sum(F.when(exact.isNull(), value))
    return F.when(F.count(value) > 0, F.coalesce(F.sum(exact).cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0)))


def confidence_notes(rows: DataFrame, keys: Sequence[str], confidence: Column) -> DataFrame:
    """Mean (of values taken to 9 decimals) and least confidence per key with the sentence about picture quality. Values that are no numbers are skipped."""
    value = confidence.try_cast("double")
    agg = rows.groupBy(*keys).agg((exact_sum(value, 9) / F.count(value)).alias("avg_conf"), F.min(value).alias("min_conf"))
    mean, least = F.col("avg_conf"), F.col("min_conf")
    band = F.when(mean >= 0.8, QUALITY_GOOD).when(mean >= 0.6, QUALITY_FAIR).otherwise(QUALITY_POOR)
    weak = F.when(least < 0.5, fill(QUALITY_WEAK, fixed(least, 2)))
    text = F.concat_ws("; ", fill(QUALITY_MEAN, fixed(mean, 2)), weak, band)
    return agg.withColumn("visual_quality_notes", F.when(mean.isNull(), "").otherwise(text))


def footage_duration(rows: DataFrame, keys: Sequence[str], duration: Column) -> DataFrame:
    """Seconds of footage per key, summed in whole microseconds, and their text; no footage is `unknown`."""
    total = F.col("total_s")
    agg = rows.groupBy(*keys).agg(F.coalesce(exact_sum(duration.try_cast("double"), 6), F.lit(0.0)).alias("total_s"))
    text = fill("{}s ({} min)", fixed(total, 0), fixed(total / F.lit(60.0), 1))
    return agg.withColumn("duration_text", F.when(total > 0, text).otherwise("unknown"))


def detection_summary(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Frames, boxes and the number of classes per media, and its top class (`boxes_per_class` has all). Frames without a box still count."""
    totals = boxes_per_class(boxes).groupBy("media_id").agg(
        F.sum("n").alias("total_detections"), F.count("*").alias("n_classes"),
        F.max_by("class", F.struct("n", "class")).alias("top_class"),
    )
    counted = frames.groupBy("media_id").agg(F.count("*").alias("frame_count"))
    return counted.join(totals, "media_id", "left").fillna(0, ["total_detections", "n_classes"])


def boxes_per_class(boxes: DataFrame) -> DataFrame:
    """(media_id, class, n): boxes of every class of a media; a missing class is `unknown`."""
    return boxes.groupBy("media_id", F.coalesce("class", F.lit("unknown")).alias("class")).agg(F.count("*").alias("n"))


def faces_per_cluster(faces: DataFrame) -> DataFrame:
    """Faces per media and cluster; faces without a cluster are a group of their own."""
    return faces.groupBy("media_id", "cluster_id").agg(F.count("*").alias("n"))


def vector_coverage(media: DataFrame, vectors: DataFrame) -> DataFrame:
    """Frames with a vector as a percentage of all frames. Vectors are counted, never read."""
    counted = vectors.groupBy("media_id").agg(F.count("*").alias("embedding_count"))
    total = F.coalesce(F.floor(F.col("fps") * F.col("duration_seconds")), F.lit(0)).cast("bigint")
    n = F.coalesce("embedding_count", F.lit(0))
    pct = F.when(F.col("total_frames") > 0, F.round(n / F.col("total_frames") * 100, 1)).otherwise(0.0)
    return (
        media.select("media_id", total.alias("total_frames"))
        .join(counted, "media_id", "left")
        .select("media_id", n.alias("embedding_count"), "total_frames", pct.alias("coverage_pct"))
    )


JOB_STATES = ("pending", "running", "done", "error")


def jobs_by_status(jobs: DataFrame, keys: Sequence[str] = ("stage",)) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in JOB_STATES]
    return jobs.groupBy(*keys).agg(F.count("*").alias("total"), *counts)


def stage_state() -> Column:
    """State of a stage from its job counts: an error outranks a running job, all done is done, no job is idle."""
    return (
        F.when(F.col("error") > 0, "error")
        .when(F.col("running") > 0, "running")
        .when(F.col("total") == 0, "idle")
        .when(F.col("done") == F.col("total"), "done")
        .otherwise("waiting")
    )


def stage_progress(stages: DataFrame, counts: DataFrame, stage: str = "stage") -> DataFrame:
    """Every stage of the list with its counts and state; a stage without jobs is idle."""
    columns = ["total", *JOB_STATES]
    return stages.join(counts, stage, "left").fillna(0, columns).withColumn("state", stage_state())


def overall_progress(counts: DataFrame) -> DataFrame:
    """One row: jobs, finished jobs and the percentage, cut to a whole number."""
    agg = counts.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total_jobs"), F.coalesce(F.sum("done"), F.lit(0)).alias("total_done"))
    pct = F.when(F.col("total_jobs") > 0, F.floor(F.col("total_done") / F.col("total_jobs") * 100)).otherwise(0)
    return agg.withColumn("progress_pct", pct.cast("bigint"))


def stage_throughput(jobs: DataFrame) -> DataFrame:
    """Per stage: time spent, finished jobs per second, and the time the rest will take at that rate."""
    agg = jobs.groupBy("stage").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"),
        F.coalesce(F.sum(F.when(F.col("status") == "done", F.col("duration_seconds"))), F.lit(0.0)).alias("elapsed_s"),
    )
    rate = F.when(F.col("elapsed_s") > 0, F.col("done") / F.col("elapsed_s"))
    return agg.withColumn("per_second", rate).withColumn("eta_s", (F.col("total") - F.col("done")) / F.col("per_second"))


QUEUE_STATES = ("completed", "in_flight", "dead", "retry", "pending")


def queue_counts(queue: DataFrame) -> DataFrame:
    """Rows per group and state, with the oldest of them where the queue has times."""
    oldest = F.min("created_at") if "created_at" in queue.columns else F.lit(None)
    return queue.groupBy("group_id", "status").agg(F.count("*").alias("n"), oldest.alias("oldest_at"))


UNHEALTHY_STATES = ("pending", "retry", "dead")


def queue_summary(counts: DataFrame) -> DataFrame:
    """One row of totals. Dead or retrying rows make a queue unhealthy; pending ones do not.

    `oldest_unhealthy_at` is the time of the oldest pending, retrying or dead row.
    """
    state = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s)
    oldest = F.min(F.when(F.col("status").isin(*UNHEALTHY_STATES), F.col("oldest_at"))).alias("oldest_unhealthy_at")
    out = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), *[state(s) for s in QUEUE_STATES], oldest)
    return out.withColumn("healthy", (F.col("dead") == 0) & (F.col("retry") == 0))


def unhealthy_groups(counts: DataFrame) -> DataFrame:
    state = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s)
    return counts.groupBy("group_id").agg(*[state(s) for s in ("dead", "retry", "pending")]).filter("dead > 0 or retry > 0")


def oldest_unhealthy_age(queue: DataFrame, now: Column) -> DataFrame:
    """One row: seconds since the oldest pending, retrying or dead row; null when there is none."""
    waiting = queue.filter(F.col("status").isin(*UNHEALTHY_STATES))
    return waiting.agg((now - F.min("created_at")).alias("age_s"))


def run_outcomes(stages: DataFrame) -> DataFrame:
    """Per run: done and errored stages, time and verdict. A stage skipped over a failed one counts as errored."""
    bad = (F.col("status") == "error") | ((F.col("status") == "skipped") & F.col("dependency_failed"))
    return stages.groupBy("run_id").agg(
        F.count("*").alias("n_stages"), F.count_if(F.col("status") == "done").alias("n_done"), F.count_if(bad).alias("n_errored"),
        F.sum("elapsed_seconds").alias("elapsed_seconds"),
        F.when(F.bool_or(F.coalesce(bad, F.lit(False))), "failed").otherwise("completed").alias("verdict"),
    )


def subject_track(boxes: DataFrame, keys: Sequence[str], place: Sequence[str]) -> DataFrame:
    """The track with the largest total box area per key; the track seen first wins ties."""
    usable = boxes.filter(F.col("track_id").isNotNull() & (F.size("bbox_xywh") >= 4))
    areas = usable.groupBy(*keys, "track_id").agg(
        F.sum(F.col("bbox_xywh")[2] * F.col("bbox_xywh")[3]).alias("area"), F.min(F.struct(*place)).alias("first_place")
    )
    return top_k(areas, keys, [F.col("area").desc(), F.col("first_place").asc()], 1).drop("rank", "first_place")


def group_centre(boxes: DataFrame, keys: Sequence[str], crop_w: float, crop_h: float) -> DataFrame:
    """Middle of the box centres per key; the crop's own centre where there are none."""
    x, y = F.col("bbox_xywh")[0], F.col("bbox_xywh")[1]
    mid = lambda c, fallback: F.coalesce((F.min(c) + F.max(c)) / 2, F.lit(fallback / 2.0))
    return boxes.groupBy(*keys).agg(mid(x, crop_w).alias("centre_x"), mid(y, crop_h).alias("centre_y"))


def bytes_saved(duplicates: DataFrame, length: str) -> DataFrame:
    return duplicates.agg(F.count("*").alias("n_duplicates"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes_saved"))


def track_summary(boxes: DataFrame) -> DataFrame:
    """Per track: its first class, first and last frame, and boxes."""
    return boxes.groupBy("media_id", "track_id").agg(
        F.min_by("class", F.struct("frame_number", "pos")).alias("class"), F.min("frame_number").alias("first_frame"),
        F.max("frame_number").alias("last_frame"), F.count("*").alias("n_boxes"),
    )


def dominant_event(events: DataFrame, window_s: float) -> DataFrame:
    """The most probable class per media and time window; the earliest wins ties."""
    slot = F.floor(F.col("ts_s") / F.lit(window_s)).cast("bigint")
    best = F.max_by("class", F.struct("probability", (-F.col("ts_s")).alias("t"), (-F.col("pos")).alias("p")))
    return events.groupBy("media_id", slot.alias("slot")).agg(best.alias("class"), F.max("probability").alias("probability"))


def mean_vectors(vectors: DataFrame, keys: Sequence[str], vector: str, name: str = "mean_vector") -> DataFrame:
    """Element-wise mean per key; null vectors do not count. Vectors are summed whole, and partial sums combine before the shuffle."""
    rows = vectors.filter(F.col(vector).isNotNull()).select(*keys, array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    return rows.groupBy(*keys).agg(Summarizer.mean(F.col("__v")).alias("__m")).select(*keys, vector_to_array("__m").alias(name))
