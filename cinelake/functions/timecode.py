"""Timecodes, subtitle stamps and the texts shown for durations and ages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cinelake.functions.text import fill, padded


def timecode_seconds(tc: Column) -> Column:
    """`HH:MM:SS.mmm` to seconds; null when there are not three parts or one is not a number."""
    parts = F.split(tc, ":")
    hours = F.get(parts, F.lit(0)).try_cast("int")
    minutes = F.get(parts, F.lit(1)).try_cast("int")
    seconds = F.get(parts, F.lit(2)).try_cast("double")
    return F.when(F.size(parts) == 3, hours * F.lit(3600.0) + minutes * F.lit(60.0) + seconds)


def seconds_timecode(seconds: Column) -> Column:
    """Seconds to `HH:MM:SS.mmm`, the format edit plans carry."""
    return F.regexp_replace(srt_stamp(seconds), ",", ".")


def _hms(total: Column) -> tuple[Column, Column, Column]:
    total = total.cast("bigint")
    return F.floor(total / 3600), F.floor(F.pmod(total, F.lit(3600)) / 60), F.pmod(total, F.lit(60))


def srt_stamp(seconds: Column) -> Column:
    """`HH:MM:SS,mmm`; milliseconds are cut, not rounded."""
    whole = F.floor(seconds)
    h, m, s = _hms(whole)
    return fill("{}:{}:{},{}", padded(h, 2), padded(m, 2), padded(s, 2), padded(F.floor((seconds - whole) * 1000), 3))


def duration_text(seconds: Column) -> Column:
    """`M:SS`, with hours in front when there are any; `--:--` for null."""
    h, m, s = _hms(seconds)
    short = fill("{}:{}", m, padded(s, 2))
    return F.when(seconds.isNull(), "--:--").when(h > 0, fill("{}:{}:{}", h, padded(m, 2), padded(s, 2))).otherwise(short)


def clock_text(seconds: Column) -> Column:
    """`HH:MM:SS`; `--:--:--` for null."""
    h, m, s = _hms(seconds)
    return F.coalesce(fill("{}:{}:{}", padded(h, 2), padded(m, 2), padded(s, 2)), F.lit("--:--:--"))


def age_text(seconds: Column) -> Column:
    """Seconds below a minute, minutes below an hour, then hours and minutes."""
    h, m, _ = _hms(seconds)
    whole = F.floor(seconds)
    return F.when(seconds < 60, fill("{}s", whole)).when(seconds < 3600, fill("{}m", m)).otherwise(fill("{}h{}m", h, m))


def parse_iso(raw: Column) -> Column:
    """ISO 8601 text to a timestamp, null when it is none. Stamps without a zone are UTC."""
    return raw.try_cast("timestamp")


def epoch_seconds(ts: Column) -> Column:
    """Timestamp as fractional seconds since 1970."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)
