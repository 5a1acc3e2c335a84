"""Rule checks: each gives null when all is well, else struct(severity, check, message)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cinelake.functions.text import fill, fixed


# Texts of findings, each `{}` in turn a value of the case at hand.
MESSAGES = {
    "in_unread": "Clip {}: invalid or missing in_timecode in overlap check",
    "out_unread": "Clip {}: invalid or missing timecode in overlap check",
    "overlap": "Overlap on track {}: clip ends at {} but next clip starts at {}",
    "length_unread": "Clip {}: invalid or missing timecode in duration check",
    "length": "Total duration {}s is outside ±10% of target {}s (allowed: {}–{}s)",
    "no_clip": "Clip not found in catalog: {}",
    "unread": "Clip {}: invalid or missing timecode",
    "backwards": "Clip {}: in_timecode ({}) must be before out_timecode ({})",
    "no_duration": "Clip {}: non-numeric duration_seconds in catalog",
    "out_beyond": "Clip {}: out_timecode ({}) exceeds clip duration ({}s)",
    "in_beyond": "Clip {}: in_timecode ({}) exceeds clip duration ({}s)",
    "level_text": "Audio level for clip {}: non-numeric level_db value '{}'",
    "level_high": "Audio level for clip {}: {} dB exceeds 0 dB (clipping risk)",
    "level_low": "Audio level for clip {}: {} dB is below -24 dB (may be inaudible)",
    "render_length": "Duration {}s differs from target {}s by more than 1s",
    "resolution": "Resolution {}x{} does not match expected {}x{}",
    "codec": "Codec '{}' does not match expected '{}'",
    "too_small": "File size {} MB ({} MB/min) is below expected minimum of {} MB/min",
    "too_big": "File size {} MB ({} MB/min) exceeds expected maximum of {} MB/min",
    "no_loudness_block": "Could not parse loudnorm output from ffmpeg stderr",
    "no_loudness": "Could not parse LUFS from loudnorm output",
    "loudness": "Integrated loudness {} LUFS differs from target {} LUFS by more than 1 LUFS",
    "black": "Black frame detected: {}s–{}s (duration: {}s)",
    "black_unread": "Could not parse blackdetect values: {} {} {}",
    "silence": "Silence detected: {}s–{}s (duration: {}s)",
    "silence_unread": "Could not parse silencedetect values: {} {} {}",
}


def message(name: str, *values: Column) -> Column:
    return fill(MESSAGES[name], *values)


def issue(severity: str, check: str, text: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"), text.alias("message"))


def number_text(value: Column) -> Column:
    """A double as shown in messages: shortest form, always with a fraction."""
    return value.cast("double").cast("string")


def audio_level_issue(clip_id: Column, level: Column) -> Column:
    """Above 0 dB clips, below -24 dB may be inaudible, text that is no number is an error, null is fine."""
    db = level.try_cast("double")
    who = F.coalesce(clip_id, F.lit("unknown"))
    return (
        F.when(level.isNull(), F.lit(None))
        .when(db.isNull(), issue("error", "audio", message("level_text", who, level)))
        .when(db > 0, issue("error", "audio", message("level_high", who, number_text(db))))
        .when(db < -24, issue("warning", "audio", message("level_low", who, number_text(db))))
    )


def render_duration_issue(actual: Column, target: Column, tolerance: float = 1.0) -> Column:
    text = message("render_length", fixed(actual, 1), fixed(target, 1))
    return F.when(F.abs(actual - target) > tolerance, issue("error", "duration", text))


def render_resolution_issue(w: Column, h: Column, want_w: int, want_h: int) -> Column:
    text = message("resolution", w, h, F.lit(want_w), F.lit(want_h))
    return F.when((w != want_w) | (h != want_h), issue("error", "resolution", text))


def render_codec_issue(codec: Column, want: str) -> Column:
    return F.when(codec != want, issue("error", "codec", message("codec", codec, F.lit(want))))


# Expected size of 1080p h264, in MB (2^20 bytes) per minute.
MIN_MB_PER_MINUTE = 8
MAX_MB_PER_MINUTE = 15


def render_size_issue(size_bytes: Column, duration: Column, want_w: int, want_h: int, want_codec: str) -> Column:
    """Size per minute; only judged when 1080p h264 is wanted."""
    if (want_w, want_h, want_codec) != (1920, 1080, "h264"):
        return F.lit(None).cast("struct<severity:string,check:string,message:string>")
    mb = size_bytes / F.lit(1048576.0)
    rate = mb / (duration / F.lit(60.0))
    low = message("too_small", fixed(mb, 1), fixed(rate, 1), F.lit(MIN_MB_PER_MINUTE))
    high = message("too_big", fixed(mb, 1), fixed(rate, 1), F.lit(MAX_MB_PER_MINUTE))
    return (
        F.when(~(duration > 0) | size_bytes.isNull(), F.lit(None))
        .when(rate < MIN_MB_PER_MINUTE, issue("warning", "file_size", low))
        .when(rate > MAX_MB_PER_MINUTE, issue("warning", "file_size", high))
    )


# Where each kind of asset is usually found.
ASSET_SOURCES = {
    "Music": "Freesound, MusicGen, AudioJungle",
    "B-Roll": "Pexels, Pixabay, Artgrid",
    "Voiceover": "Kokoro TTS, ElevenLabs, manual recording",
}


def asset_sources(kind: Column) -> Column:
    out = F.lit("N/A")
    for name, places in ASSET_SOURCES.items():
        out = F.when(kind == name, places).otherwise(out)
    return out


def asset_priority(kind: Column, duration: Column) -> Column:
    """Voice-over always High; music from more than 30 s, b-roll from more than 3 s."""
    high = (kind == "Voiceover") | ((kind == "Music") & (duration > 30)) | ((kind == "B-Roll") & (duration > 3))
    return F.when(high, "High").otherwise("Medium")


def render_route(overlay: Column, crop_mode: Column, clip_id: Column) -> Column:
    """`slow` for picture-in-picture, split screen and subject tracking, else `fast`."""
    composed = F.coalesce(overlay.isin("pip", "split_screen"), F.lit(False))
    tracked = clip_id.isNotNull() & F.coalesce(crop_mode == "auto_subject", F.lit(False))
    return F.when(composed | tracked, "slow").otherwise("fast")
