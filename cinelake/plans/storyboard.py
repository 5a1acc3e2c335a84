"""Summaries of clusters and storyboards of shots, from signals kept as rows.

Signal tables: segments (media_id, pos, start_s, end_s, text), captions (media_id, start_s, end_s, caption),
detections (media_id, frame_number, pos, class, confidence), faces (media_id, frame_number, face_index,
cluster_id), audio (media_id, ts_s, pos, class).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.functions.text import fill, fixed
from cinelake.operators.intervals import overlap_join, point_join
from cinelake.operators.relations import in_listed_order, with_face_labels
from cinelake.operators.skew import row_number_across
from cinelake.operators.summaries import confidence_notes, footage_duration, top_classes
from cinelake.operators.text import first_seen, joined_in_order, paged_text
from cinelake.operators.topk import top_k
from cinelake.session import cut_lineage

# Lines of the storyboards.
CLUSTER_HEAD = "## Cluster: {}"
CLUSTER_TITLE = "## Cluster: {} — {}"
CLUSTER_ABOUT = "Description: {}"
CLUSTER_LINE = "- **{}**: "
SHOT_HEAD = "### Shot {} (Clip: {})"
SHOT_LENGTH = "- Duration: {}s"
SHOT_SOURCE = "- Source: {} [{}s – {}s]"
SPOKEN = "Transcript: {}"
SEEN = "Detected objects: {}"
HEARD = "Audio: {}"
SPEECH = "Speech detected ({} segments)"
UNLABELLED = "Unlabeled"

SHOT_KEY = ["media_id", "shot_pos"]
BUCKET_S = 60.0


def per_cluster(signal: DataFrame, members: DataFrame) -> DataFrame:
    """A signal's rows with the cluster and the clip's place in it as `clip_pos`."""
    return signal.join(members.select("cluster_id", F.col("pos").alias("clip_pos"), "media_id"), "media_id")


def cluster_transcripts(segments: DataFrame, members: DataFrame, page_rows: int = 500) -> DataFrame:
    """All speech of a cluster in clip and segment order, in pages."""
    rows = per_cluster(segments, members).withColumn("__part", F.struct("clip_pos", F.floor(F.col("pos") / 1000)))
    return paged_text(rows, ["cluster_id"], "__part", ["clip_pos", "pos"], "text", " ", "transcripts", page_rows)


def cluster_summary(clusters: DataFrame, members: DataFrame, media: DataFrame, signals: dict[str, DataFrame], top_n: int = 10) -> DataFrame:
    """One row per cluster for labelling: time range, most frequent classes and sounds, position.

    The speech comes from `cluster_transcripts`.
    """
    seen = per_cluster(signals["detections"], members)
    heard = per_cluster(signals["audio"], members)
    objects = top_classes(seen, ["cluster_id"], "class", ["clip_pos", "frame_number", "pos"], top_n, "detections")
    sounds = top_classes(heard, ["cluster_id"], "class", ["clip_pos", "ts_s", "pos"], top_n, "audio_events")
    both = F.col("gps_center_lat").isNotNull() & F.col("gps_center_lon").isNotNull()
    gps = F.when(both, F.concat_ws(", ", F.col("gps_center_lat").cast("string"), F.col("gps_center_lon").cast("string"))).otherwise("")
    return (
        clusters.join(objects, "cluster_id", "left").join(sounds, "cluster_id", "left")
        .select(
            "cluster_id", F.concat(F.coalesce("time_start", F.lit("")), F.lit(" to "), F.coalesce("time_end", F.lit(""))).alias("time_range"),
            F.coalesce("detections", F.lit("")).alias("detections"), F.coalesce("audio_events", F.lit("")).alias("audio_events"), gps.alias("gps"),
        )
    )


def master_storyboard(
    clusters: DataFrame, members: DataFrame, media: DataFrame, signals: dict[str, DataFrame], face_clusters: DataFrame,
    include_excluded: bool = False,
) -> DataFrame:
    """(cluster_id, section): the storyboard's section per cluster. In order of the clusters they are its text."""
    if not include_excluded:
        clusters = clusters.filter(~F.coalesce(F.col("excluded"), F.lit(False)))
    key = ["cluster_id"]
    spoken = per_cluster(signals["segments"], members)
    seen = per_cluster(signals["detections"], members)
    heard = per_cluster(signals["audio"], members)
    faces = per_cluster(signals["faces"].withColumnRenamed("cluster_id", "face_cluster_id"), members)

    length = footage_duration(members.join(media.select("media_id", "duration_seconds"), "media_id", "left"), key, F.col("duration_seconds"))
    lines = top_k(spoken.select("cluster_id", "clip_pos", "pos", "text"), key, [F.col("clip_pos"), F.col("pos")], 5)
    highlights = lines.groupBy(*key).agg(joined_in_order(F.col("rank"), F.col("text"), " | ").alias("highlights"))
    n_spoken = spoken.groupBy(*key).agg(F.count("*").alias("n_segments"))
    objects = top_classes(seen, key, "class", ["clip_pos", "frame_number", "pos"], 5, "objects")
    sounds = top_classes(heard, key, "class", ["clip_pos", "ts_s", "pos"], 5, "sounds")
    quality = confidence_notes(seen, key, F.col("confidence")).select("cluster_id", "visual_quality_notes")
    met = faces.filter("face_cluster_id is not null").select(
        F.col("cluster_id").alias("activity_id"), F.col("face_cluster_id").alias("cluster_id")
    ).distinct()
    people = with_face_labels(met, face_clusters).groupBy(F.col("activity_id").alias("cluster_id")).agg(joined_in_order(F.col("cluster_id"), F.col("person"), ", ").alias("people"))

    out = clusters
    for part in (length, highlights, n_spoken, objects, sounds, quality, people):
        out = out.join(part, "cluster_id", "left")
    moments = F.concat_ws("; ", fill(SPOKEN, F.col("highlights")), fill(SEEN, F.col("objects")))
    tone = F.concat_ws("; ", fill(HEARD, F.col("sounds")), fill(SPEECH, F.col("n_segments")))
    line = lambda title, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(CLUSTER_LINE.format(title)), value))
    section = F.concat_ws(
        "\n",
        fill(CLUSTER_HEAD, F.col("cluster_id")),
        line("Label", F.coalesce(F.nullif("label", F.lit("")), F.lit(UNLABELLED))),
        line("Description", F.col("description")),
        line("Duration", F.coalesce("duration_text", F.lit("unknown"))),
        line("Key moments", moments), line("People present", F.col("people")), line("Emotional tone", tone),
        line("Visual quality", F.col("visual_quality_notes")),
    )
    return out.select("cluster_id", section.alias("section"))


def shot_transcripts(segments: DataFrame, shots: DataFrame, width_s: float = BUCKET_S) -> DataFrame:
    """(shot, segment) pairs whose open intervals meet, with the shot's and the segment's own columns."""
    spans = shots.select("media_id", "shot_pos", F.col("start_s").alias("shot_start"), F.col("end_s").alias("shot_end"))
    return overlap_join(segments, spans, ["media_id"], ("start_s", "end_s"), ("shot_start", "shot_end"), width_s)


def shot_captions(captions: DataFrame, shots: DataFrame, width_s: float = BUCKET_S) -> DataFrame:
    spans = shots.select("media_id", "shot_pos", F.col("start_s").alias("shot_start"), F.col("end_s").alias("shot_end"))
    return overlap_join(captions, spans, ["media_id"], ("start_s", "end_s"), ("shot_start", "shot_end"), width_s)


def frame_spans(shots: DataFrame, media: DataFrame) -> DataFrame:
    """Shots as closed ranges of frames; 30 frames a second where the rate is unknown."""
    fps = F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(30.0))
    return shots.join(media.select("media_id", "fps"), "media_id", "left").select(
        "media_id", "shot_pos", F.floor(F.col("start_s") * fps).cast("bigint").alias("frame_from"),
        F.floor(F.col("end_s") * fps).cast("bigint").alias("frame_to"),
    )


def in_frames(signal: DataFrame, shots: DataFrame, media: DataFrame, width: float = 1800.0) -> DataFrame:
    return point_join(signal, frame_spans(shots, media), ["media_id"], "frame_number", ("frame_from", "frame_to"), width)


def in_seconds(audio: DataFrame, shots: DataFrame, width_s: float = BUCKET_S) -> DataFrame:
    spans = shots.select("media_id", "shot_pos", F.col("start_s").alias("shot_start"), F.col("end_s").alias("shot_end"))
    return point_join(audio, spans, ["media_id"], "ts_s", ("shot_start", "shot_end"), width_s)


def _distinct_text(pairs: DataFrame, value: str, place: list[str], name: str) -> DataFrame:
    """Distinct values per shot in the order of their first appearance."""
    return first_seen(pairs, SHOT_KEY, value, place).groupBy(*SHOT_KEY).agg(joined_in_order(F.struct("first_place", value), F.col(value), ", ").alias(name))


def shot_signals(shots: DataFrame, media: DataFrame, signals: dict[str, DataFrame], face_clusters: DataFrame | None = None, page_rows: int = 500) -> DataFrame:
    """Every shot with its transcript, captions, objects, people and sounds; null where a shot has none.

    Transcript and captions longer than `page_rows` entries go on in further rows of the shot (`page` 1, 2, ...).
    """
    parts = shot_transcripts(signals["segments"], shots).withColumn("__part", F.floor(F.col("pos") / 1000).cast("bigint"))
    spoken = paged_text(parts, SHOT_KEY, "__part", ["pos", "start_s"], "text", " ", "transcript", page_rows)
    pages = spoken
    if "captions" in signals:
        cut = shot_captions(signals["captions"], shots).withColumn("__minute", F.floor(F.col("start_s") / 60).cast("bigint"))
        shown = paged_text(cut, SHOT_KEY, "__minute", ["start_s", "end_s", "caption"], "caption", "; ", "visual", page_rows)
        pages = spoken.join(shown, [*SHOT_KEY, "page"], "full_outer")
    parts = []
    if "detections" in signals:
        parts.append(_distinct_text(in_frames(signals["detections"], shots, media), "class", ["frame_number", "pos"], "objects"))
    if "faces" in signals:
        faces = with_face_labels(in_frames(signals["faces"], shots, media).filter("cluster_id is not null"), face_clusters)
        parts.append(_distinct_text(faces, "person", ["frame_number", "face_index"], "people"))
    if "audio" in signals:
        parts.append(_distinct_text(in_seconds(signals["audio"], shots), "class", ["ts_s", "pos"], "audio"))
    out = shots
    for part in parts:
        out = out.join(part, SHOT_KEY, "left")
    out = out.join(pages, SHOT_KEY, "left").withColumn("page", F.coalesce("page", F.lit(0)).cast("bigint"))
    return out if "captions" in signals else out.withColumn("visual", F.lit(None).cast("string"))


def shot_text(number: str = "shot_number"):
    """The storyboard lines of a shot."""
    line = lambda title, c: F.concat(F.lit(f"- {title}: "), F.col(c))
    head = [
        fill(SHOT_HEAD, F.col(number), F.col("media_id")),
        fill(SHOT_LENGTH, fixed(F.col("end_s") - F.col("start_s"), 1)),
        fill(SHOT_SOURCE, F.col("media_id"), fixed(F.col("start_s"), 1), fixed(F.col("end_s"), 1)),
    ]
    whole = F.concat_ws("\n", *head, line("Transcript", "transcript"), line("Visual", "visual"), line("Objects", "objects"), line("People", "people"), line("Audio", "audio"))
    more = F.concat_ws("\n", line("Transcript", "transcript"), line("Visual", "visual"))
    return F.when(F.col("page") == 0, whole).otherwise(more)


def cluster_storyboards(clusters: DataFrame, members: DataFrame, shot_rows: DataFrame) -> DataFrame:
    """(cluster_id, shot_number, page, text): every cluster's section, once. Shots are numbered over its clips; row 0 is its heading."""
    # Assembling the shots is the costly part; they are numbered and then read again.
    shot_rows = cut_lineage(shot_rows)
    placed = per_cluster(shot_rows.filter("page = 0").select(*SHOT_KEY), members)
    numbered = row_number_across(
        placed.withColumn("__part", F.struct("clip_pos", F.floor(F.col("shot_pos") / 1000))),
        ["cluster_id"], "__part", ["clip_pos", "shot_pos"], "shot_number",
    ).select("cluster_id", "clip_pos", *SHOT_KEY, "shot_number")
    body = shot_rows.join(numbered, SHOT_KEY).select("cluster_id", "shot_number", "page", shot_text().alias("text"))
    label = F.coalesce(F.nullif("label", F.lit("")), F.lit(UNLABELLED))
    title = fill(CLUSTER_TITLE, F.col("cluster_id"), label)
    about = F.when(F.coalesce("description", F.lit("")) != "", fill(CLUSTER_ABOUT, F.col("description")))
    heads = clusters.select("cluster_id", F.lit(0).cast("bigint").alias("shot_number"), F.lit(0).cast("bigint").alias("page"), F.concat_ws("\n", title, about).alias("text"))
    return heads.unionByName(body.join(clusters.select("cluster_id"), "cluster_id", "left_semi"))


def listed_sections(narratives: DataFrame, cluster_ids: str, sections: DataFrame) -> DataFrame:
    """(narrative_id, cluster_pos, cluster_id and what `sections` holds of the cluster) for the clusters a narrative lists; unknown ones drop out."""
    listed = in_listed_order(narratives, "narrative_id", cluster_ids, sections, "cluster_id")
    rest = [c for c in sections.columns if c != "cluster_id"]
    return listed.select("narrative_id", F.col("pos").cast("bigint").alias("cluster_pos"), "cluster_id", *rest)


def narrative_storyboard(narratives: DataFrame, cluster_ids: str, clusters: DataFrame, members: DataFrame, shot_rows: DataFrame) -> DataFrame:
    """(narrative_id, cluster_pos, cluster_id, shot_number, page, text), the storyboard of each narrative as rows.

    Clusters a narrative names but the catalog lacks drop out. Texts in row order, joined by blank lines, are the storyboard.
    It repeats a cluster's section in every narrative; what depends on the section alone is had from `cluster_storyboards`.
    """
    return listed_sections(narratives, cluster_ids, cluster_storyboards(clusters, members, shot_rows))
