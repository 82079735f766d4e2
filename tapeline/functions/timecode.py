"""Timecodes HH:MM:SS:FF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FPS = 25


def frames(seconds: Column, fps: int = FPS) -> Column:
    """Frames, ties to even; null, NaN and negative seconds count as 0."""
    safe = F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), F.lit(0.0)).otherwise(seconds)
    return F.rint(safe * F.lit(fps)).cast("long")


def from_frames(f: Column, fps: int = FPS) -> Column:
    """At least two digits a part; hours don't wrap."""
    second = F.floor(f / fps)
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(f / (3600 * fps)), F.floor(second / 60) % 60, second % 60, f % fps)


def timecode(seconds: Column, fps: int = FPS) -> Column:
    return from_frames(frames(seconds, fps), fps)


def to_frames(text: Column, fps: int = FPS) -> Column:
    """The inverse of `from_frames`."""
    part = F.split(text, ":")
    n = lambda i: part[i].cast("long")
    return ((n(0) * 60 + n(1)) * 60 + n(2)) * fps + n(3)
