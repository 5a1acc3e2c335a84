"""Which frames and moments of a clip to look at."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def frame_grid(total_frames: Column, step: Column) -> Column:
    """Frame numbers 0, step, 2*step, ... below the total; empty when there are no frames."""
    none = F.expr("cast(array() as array<bigint>)")
    last = F.greatest(total_frames.cast("bigint") - 1, F.lit(0))
    grid = F.sequence(F.lit(0).cast("bigint"), last, F.greatest(step.cast("bigint"), F.lit(1)))
    return F.when(total_frames > 0, grid).otherwise(none)


def step_per_second(fps: Column, rate: float = 1.0) -> Column:
    """Frames between samples when sampling `rate` times a second; at least one."""
    return F.greatest(F.lit(1), F.floor(fps / F.lit(rate))).cast("bigint")


def even_stamps(start: Column, end: Column, n: int) -> Column:
    """`n` moments from start to end, both included; the middle when n is 1; empty for an empty interval."""
    none = F.expr("cast(array() as array<double>)")
    if n == 1:
        stamps = F.array((start + end) / F.lit(2.0))
    else:
        step = (end - start) / F.lit(float(n - 1))
        stamps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + i * step)
    return F.when(end > start, stamps).otherwise(none)
