"""Ordered computations of the catalog, on top of the segmented forms in `skew`."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from cinelake.functions.vectors import cosine_distance
from cinelake.operators.skew import ROWS_PER_SALT, affine_scan, has_hot_key, last_known_across, neighbour_across, range_segments, running_sum_across
from cinelake.session import cut_lineage


def split_on_flag(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], flag: Column, name: str) -> DataFrame:
    """Number the parts a key falls into when a new part starts at every row whose flag is true."""
    starts = F.coalesce(flag, F.lit(False)).cast("bigint")
    return running_sum_across(df, keys, segment, order, starts, name)


def sessions(df: DataFrame, keys: Sequence[str], ts: str, gap_s: float, tie: str, name: str, rows_per_segment: int = ROWS_PER_SALT) -> DataFrame:
    """Number the sessions of each key. A gap of exactly `gap_s` still joins. `ts` is in seconds.

    A key with more than `rows_per_segment` rows, be they of one minute, is cut into ranges of (ts, tie). Each range is handed the last time
    and the number of sessions begun before it.
    """
    order = [ts, tie]
    cut = range_segments(df, keys, order, "__range", rows_per_segment)
    lagged = neighbour_across(cut, keys, "__range", order, {"__before": ts})
    out = split_on_flag(lagged, keys, "__range", order, F.col(ts) - F.col("__before") > gap_s, name)
    return out.drop("__before", "__range")


def vector_breaks(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], vector: str, threshold: float, name: str) -> DataFrame:
    """Number the runs of similar vectors: a new run starts where the distance to the row before exceeds the threshold.

    A missing or zero vector never starts a run, nor does the row after it.
    """
    lagged = neighbour_across(df, keys, segment, order, {"__before": vector})
    far = cosine_distance(F.col("__before"), F.col(vector)) > threshold
    return split_on_flag(lagged, keys, segment, order, far, name).drop("__before")


def with_next_clip(clips: DataFrame, keys: Sequence[str], start: str, order: Sequence[str], more: dict[str, str] | None = None, rows_per_segment: int = ROWS_PER_SALT) -> DataFrame:
    """Each clip but the last of its track with `next_start`, where the next one starts, and what `more` names of it.

    A clip overlaps when its end lies after `next_start`; touching is fine. Only neighbours are compared.
    """
    placed, columns = clips.filter(F.col(start).isNotNull()), {"next_start": start, **(more or {})}
    if has_hot_key(placed, keys, rows_per_segment):
        cut = range_segments(placed, keys, [start, *order], rows_per_segment=rows_per_segment)
        ahead = neighbour_across(cut, keys, "__segment", [start, *order], columns, ahead=True).drop("__segment")
    else:
        along = Window.partitionBy(*keys).orderBy(start, *order)
        ahead = placed.withColumns({new: F.lead(old).over(along) for new, old in columns.items()})
    return ahead.filter(F.col("next_start").isNotNull())


def fill_gaps(
    path: DataFrame, keys: Sequence[str], frame: str, x: str, y: str, fps: Column, centre_x: Column, centre_y: Column,
    hold_s: float = 2.0, drift_s: float = 1.0, segment_frames: int = 4096,
) -> DataFrame:
    """Replace missing points of a dense path: hold the last one, then drift to the frame's centre, then stay there.

    Before the first point the centre is held. Needs one row per frame, numbered from 0.
    """
    cut = path.withColumn("__segment", F.floor(F.col(frame) / segment_frames).cast("bigint"))
    known = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.col(frame).alias("f"), F.col(x).alias("x"), F.col(y).alias("y")))
    seen = last_known_across(cut, keys, "__segment", [frame], known, "__last")
    hold, drift = F.floor(fps * F.lit(hold_s)), F.floor(fps * F.lit(drift_s))
    into = F.col(frame) - F.coalesce(F.col("__last.f"), F.lit(-1)) - 1
    t = (into - hold) / F.greatest(drift, F.lit(1)).cast("double")

    def filled(value: str, centre: Column, part: str) -> Column:
        last = F.coalesce(F.col(f"__last.{part}"), centre)
        gap = F.when(into < hold, last).when(into < hold + drift, last + t * (centre - last)).otherwise(centre)
        return F.when(F.col("__last.f") == F.col(frame), F.col(value)).otherwise(gap)

    return seen.withColumns({x: filled(x, centre_x, "x"), y: filled(y, centre_y, "y")}).drop("__segment", "__last")


def smooth(path: DataFrame, keys: Sequence[str], frame: str, columns: Sequence[str], alpha: Column) -> DataFrame:
    """Exponential smoothing s += alpha * (x - s) in frame order, one row per frame.

    Starts at the first known point; a missing point holds the value before, 0 when there is none.
    """
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    marked = cut_lineage(path.withColumn("__missing", missing))
    first = marked.filter(~F.col("__missing")).groupBy(*keys).agg(F.min(frame).alias("__first"))
    staged = marked.join(first, list(keys), "left").withColumn("__alpha", alpha)
    start = F.col(frame) == F.col("__first")
    steps = staged.withColumns({
        "__m": F.when(F.col("__missing"), 1.0).when(start, 0.0).otherwise(F.lit(1.0) - F.col("__alpha")),
        **{f"__b_{c}": F.when(F.col("__missing"), 0.0).when(start, F.col(c)).otherwise(F.col("__alpha") * F.col(c)) for c in columns},
    })
    scanned = affine_scan(steps.select(*keys, frame, "__m", *[f"__b_{c}" for c in columns]), keys, frame, "__m", {c: f"__b_{c}" for c in columns})
    return marked.drop("__missing", *columns).join(scanned, [*keys, frame])


def smoothing_alpha(tau: Column, fps: Column) -> Column:
    return F.lit(1.0) - F.exp(F.lit(-1.0) / (tau * fps))


def timeline_offsets(clips: DataFrame, keys: Sequence[str], pos: str, tie: Sequence[str], length: Column, name: str = "offset_s", rows_per_segment: int = ROWS_PER_SALT) -> DataFrame:
    """Where each clip starts on the timeline: the lengths of the clips before it."""
    if not has_hot_key(clips, keys, rows_per_segment):
        before = Window.partitionBy(*keys).orderBy(pos, *tie).rowsBetween(Window.unboundedPreceding, -1)
        return clips.withColumn(name, F.coalesce(F.sum(length).over(before), F.lit(0)))
    cut = range_segments(clips, keys, [pos, *tie], rows_per_segment=rows_per_segment)
    return running_sum_across(cut, keys, "__segment", [pos, *tie], length, name, exclusive=True).drop("__segment")


def tiles(samples: DataFrame, key: str, index: str, value: str, rate: int, seconds: float = 1.0) -> DataFrame:
    """Fixed tiles of a waveform: their number, their length in samples, samples present and the zeros that pad the last."""
    size = int(rate * seconds)
    tile = F.floor(F.col(index) / size).cast("bigint")
    agg = samples.groupBy(key, tile.alias("tile")).agg(F.count("*").alias("n_samples"), F.sum(value).alias("total"))
    return agg.withColumn("n_padding", F.lit(size) - F.col("n_samples"))


def first_method(boundaries: DataFrame, keys: Sequence[str], place: Sequence[str]) -> DataFrame:
    """The shot method stored first for each media."""
    return boundaries.groupBy(*keys).agg(F.min_by("method", F.struct(*place)).alias("method"))


def crop_jumps(path: DataFrame, keys: Sequence[str], frame: str, x: str, width: Column, limit: float = 0.02, segment_frames: int = 4096) -> DataFrame:
    """Frames whose crop moved by more than `limit` of the width since the frame before."""
    cut = path.withColumn("__segment", F.floor(F.col(frame) / segment_frames).cast("bigint"))
    moved = neighbour_across(cut, keys, "__segment", [frame], {"__x": x}).withColumn("jump", F.abs(F.col(x) - F.col("__x")))
    return moved.filter(F.col("jump") > width * limit).drop("__segment", "__x")


def subject_inside(path: DataFrame, keys: Sequence[str], inside: Column) -> DataFrame:
    """Share of frames whose subject lies inside the crop, and whether it is above 90 %."""
    agg = path.groupBy(*keys).agg(F.avg(inside.cast("double")).alias("inside_share"))
    return agg.withColumn("meets_target", F.col("inside_share") > 0.9)


def sliding_means(vectors: DataFrame, keys: Sequence[str], time: str, vector: str, length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Mean vector per key and sliding window (`window_start`); null vectors do not count.

    Vectors are summed once, per pane (the longest span that fits both length and slide); windows are merged from the sums of their panes.
    """
    pane = f"{math.gcd(*(int(pd.Timedelta(x).total_seconds() * 1000) for x in (length, slide)))} milliseconds"
    rows = vectors.filter(F.col(vector).isNotNull()).select(*keys, F.window(time, pane)["start"].alias("__pane"), array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    panes = rows.groupBy(*keys, "__pane").agg(Summarizer.sum(F.col("__v")).alias("__v"), F.count(F.lit(1)).alias("__n"))
    merged = panes.groupBy(*keys, F.window("__pane", length, slide)["start"].alias("window_start")).agg(Summarizer.sum(F.col("__v")).alias("__v"), F.sum("__n").alias("__n"))
    return merged.select(*keys, "window_start", F.transform(vector_to_array("__v"), lambda x: x / F.col("__n")).alias("mean_vector"))


def window_breaks(means: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cosine distance of each window's mean vector to the one before, null for the first."""
    cut = means.withColumn("__day", F.to_date("window_start"))
    lagged = neighbour_across(cut, keys, "__day", ["window_start"], {"__before": "mean_vector"})
    return lagged.withColumn("distance", cosine_distance(F.col("__before"), F.col("mean_vector"))).drop("__before", "__day")
