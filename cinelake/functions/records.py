"""Raw analyser records brought to the catalog's shape."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normalise_segments(segments: Column) -> Column:
    """Speech segments with nested words: numbers default to 0.0, texts to ''; a word may lack its times."""

    def word(w: Column) -> Column:
        return F.struct(
            F.coalesce(w["word"], F.lit("")).alias("word"),
            w["start"].cast("double").alias("start"),
            w["end"].cast("double").alias("end"),
            F.coalesce(w["score"].cast("double"), F.lit(0.0)).alias("score"),
        )

    empty = F.expr("cast(array() as array<struct<word:string,start:double,end:double,score:double>>)")
    return F.transform(
        segments,
        lambda s: F.struct(
            F.coalesce(s["start"].cast("double"), F.lit(0.0)).alias("start"),
            F.coalesce(s["end"].cast("double"), F.lit(0.0)).alias("end"),
            F.coalesce(s["text"], F.lit("")).alias("text"),
            s["speaker"].alias("speaker"),
            F.coalesce(F.transform(s["words"], word), empty).alias("words"),
        ),
    )


def normalise_detection(track_id: Column, class_index: Column, names: Column, box: Column, confidence: Column) -> Column:
    """One detection; a class without a name is called by its number."""
    return F.struct(
        track_id.cast("bigint").alias("track_id"),
        F.coalesce(F.try_element_at(names, class_index), class_index.cast("string")).alias("class"),
        F.transform(box, lambda x: x.cast("double")).alias("bbox_xywh"),
        confidence.cast("double").alias("confidence"),
    )


def normalise_shot(start_frame: Column, end_frame: Column, end_exclusive: bool) -> Column:
    """A shot with an inclusive end; one detector reports the first frame after the shot."""
    return F.struct(
        start_frame.cast("bigint").alias("start_frame"),
        (end_frame - (1 if end_exclusive else 0)).cast("bigint").alias("end_frame"),
        F.lit("cut").alias("transition_type"),
    )


def shot_seconds(start_time: Column, end_time: Column, start_frame: Column, end_frame: Column, fps: Column, duration: Column):
    """Start and end of a shot in seconds: the stored seconds, else frame / fps, else the whole clip."""
    rate = F.coalesce(fps, F.lit(30.0))
    start = F.coalesce(start_time, start_frame / rate, F.lit(0.0))
    end = F.coalesce(end_time, (end_frame + 1) / rate, duration, F.lit(0.0))
    return start, end
