"""Scalar rules of media time, frames, names and outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyframe_count(ms: Column) -> Column:
    """One keyframe per four seconds of a shot, 2 at least and 32 at most."""
    return F.greatest(F.lit(2), F.least(F.lit(32), F.ceil(F.greatest(ms, F.lit(0)) / 4000))).cast("int")


def candidate_stride(fps: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(fps / 2, 0)).cast("int")


def expected_candidates(frames: Column, stride: Column) -> Column:
    return F.ceil(frames / stride).cast("int")


def frame_to_ms(frame: Column, fps: Column) -> Column:
    return F.bround(frame / fps * 1000, 0).cast("bigint")


def snap_ms_to_frame(ms: Column, fps: Column) -> Column:
    """The nearest frame, halves up."""
    return F.floor(ms / 1000 * fps + 0.5).cast("bigint")


def timecode_to_ms(s: Column) -> Column:
    """HH:MM:SS.mmm or MM:SS.mmm, with a point or a comma; null otherwise."""
    form = r"^(?:(\d+):)?(\d+):(\d+(?:[.,]\d+)?)$"
    part = lambda k: F.regexp_extract(s, form, k)
    seconds = F.regexp_replace(part(3), ",", ".").try_cast("double") + part(2).try_cast("bigint") * 60 + F.coalesce(part(1).try_cast("bigint"), F.lit(0)) * 3600
    return F.when(s.rlike(form), F.bround(seconds * 1000, 0).cast("bigint"))


def parse_timecode(s: Column) -> Column:
    """Milliseconds of (h:)mm:ss(.fff) as a user types it; null where it makes no time.

    Seconds end at 59, and so do minutes behind an hour; alone, 90 minutes are fine. A fraction is a decimal one.
    """
    form = r"^(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,](\d{1,3}))?$"
    t = F.trim(s)
    part = lambda k: F.coalesce(F.regexp_extract(t, form, k).try_cast("bigint"), F.lit(0))
    hour = F.regexp_extract(t, form, 1) != ""
    fraction = F.rpad(F.regexp_extract(t, form, 4), 3, "0").cast("bigint")
    return F.when(t.rlike(form) & (part(3) <= 59) & (~hour | (part(2) <= 59)), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + fraction)


def format_timecode(ms: Column) -> Column:
    """(h:)mm:ss.cc, rounded to hundredths; the hour only where there is one, nothing below zero."""
    t = F.floor((F.greatest(ms, F.lit(0)) + 5) / 10).cast("bigint")  # hundredths, halves up
    whole = (t / 100).cast("bigint")
    base = F.format_string("%02d:%02d.%02d", (whole / 60).cast("bigint") % 60, whole % 60, t % 100)
    return F.when(whole >= 3600, F.concat((whole / 3600).cast("bigint").cast("string"), F.lit(":"), base)).otherwise(base)


def format_duration(seconds: Column) -> Column:
    """42s, 58m 42s or 1h 05m; null counts as no time."""
    t = F.greatest(F.floor(F.coalesce(seconds, F.lit(0)) + 0.5), F.lit(0)).cast("bigint")
    minutes = (t / 60).cast("bigint")
    short = F.concat(t.cast("string"), F.lit("s"))
    return F.when(t < 60, short).when(t < 3600, F.format_string("%dm %02ds", minutes, t % 60)).otherwise(F.format_string("%dh %02dm", (t / 3600).cast("bigint"), minutes % 60))


def format_gap(ms: Column) -> Column:
    """The time between two places of a chain: +12s or +1m 05s."""
    t = F.floor(F.coalesce(ms, F.lit(0)) / 1000 + 0.5).cast("bigint")
    return F.when(t < 60, F.format_string("+%ds", t)).otherwise(F.format_string("+%dm %02ds", (t / 60).cast("bigint"), t % 60))


def keyframe_ms(time: Column, frame: Column, fps: Column) -> Column:
    """The time of a keyframe, or that of its frame number where the time is missing."""
    return F.coalesce(F.floor(time + 0.5), F.when(fps > 0, F.floor(frame / fps * 1000 + 0.5))).cast("bigint")


def scene_candidates(start: Column, end: Column, stride: Column, most: Column) -> Column:
    """(first, last) candidate whose frame lies in a scene, counted from 1; first > last where there is none."""
    first = F.greatest(F.lit(1), F.ceil(start / stride) + 1)
    return F.struct(first.cast("bigint").alias("first"), F.least(most, F.floor(end / stride) + 1).cast("bigint").alias("last"))


# What a decoder says of a broken file.
DAMAGE = [
    "Invalid NAL unit size", "Error splitting the input into NAL units", "Error submitting packet to decoder", "missing picture in access unit",
    "no frame!", "out of range", "Invalid data found when processing input", "corrupt",
]


def looks_damaged(log: Column) -> Column:
    """The decoder's log tells that the file itself is broken, so another try is of no use."""
    said = F.lit(False)
    for text in DAMAGE:
        said = said | F.contains(log, F.lit(text))
    return F.coalesce(said, F.lit(False))


def is_degenerate(mean: Column, std: Column, edge: Column) -> Column:
    """Too dark, too bright or flat, and without edges."""
    return ((mean < 16) | (mean > 240) | (std < 8)) & (edge <= 0.002)


def decode_outcome(candidates: Column, expected: Column, damaged_log: Column) -> Column:
    return F.when(candidates == 0, "failed").when(candidates >= expected * 0.98, "ok").when(damaged_log, "damaged").otherwise("failed")


def keep_decode(candidates: Column, expected: Column, known_damaged: Column) -> Column:
    """A decode of an earlier run is kept if it is complete, or short of a file that is known to be damaged."""
    return (candidates > 0) & ((candidates >= expected * 0.98) | F.coalesce(known_damaged, F.lit(False)))


def verdict_state(verdict: Column, code: Column) -> Column:
    return F.when(verdict == "CORRECT", "success").when(verdict.isin("WRONG", "UNDECIDABLE"), "error").when((verdict == "INDETERMINATE") | (code == 202), "pending").when(code.between(200, 299), "success").otherwise("error")


def shard_of(video_id: Column) -> Column:
    return F.lpad(F.substring(video_id, 1, 2), 2, "0")


def keyframe_path(video_id: Column, shot: Column, kf: Column, folder: str = "kf") -> Column:
    """<folder>/<shard>/<id>/<shot, 5 digits>_<kf>.webp"""
    return F.format_string(f"{folder}/%s/%s/%05d_%d.webp", shard_of(video_id), video_id, shot, kf)
