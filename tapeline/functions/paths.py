"""Parts of slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of media files.
AUDIO = ("wav", "mp3", "m4a", "flac", "aac", "ogg", "wma")
VIDEO = ("mp4", "mov", "m4v", "avi", "mkv", "webm")


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, "(?<=.)/+$", "")


def name(path: Column) -> Column:
    return F.substring_index(_bare(path), "/", -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading or trailing dot starts no suffix."""
    own = name(path)
    cut = F.regexp_extract(own, r"(?s)^(.+)\.[^.]+$", 1)
    return F.when(cut != "", cut).otherwise(own)


def suffix(path: Column) -> Column:
    """The last suffix with its dot, or an empty string."""
    return F.regexp_extract(name(path), r"(?s)^.+(\.[^.]+)$", 1)


def folder(path: Column) -> Column:
    cut = F.regexp_replace(_bare(path), r"/[^/]*$", "")
    return F.when(~F.contains(path, F.lit("/")), ".").when(cut == "", "/").otherwise(cut)


def absolute(path: Column, base: Column | str) -> Column:
    """The path from the root: relative ones start at `base`; empty and `.` steps go, `..` takes a step back, the root is
    its own parent. Links of the file system are not followed."""
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(base) if isinstance(base, str) else base, F.lit("/"), path))
    steps = F.filter(F.split(whole, "/"), lambda x: ~x.isin("", "."))
    walk = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/"))


def target(path: Column, output_folder: Column | None = None) -> Column:
    """Where the document of a media file goes: the given folder, or beside the file."""
    where = folder(path) if output_folder is None else F.coalesce(output_folder, folder(path))
    return F.concat(F.regexp_replace(where, "/+$", ""), F.lit("/"), stem(path), F.lit(".md"))


def display(path: Column) -> Column:
    return F.concat_ws("    ", name(path), folder(path))


def is_media(path: Column) -> Column:
    """Whatever the case of its extension."""
    return F.lower(F.substring(suffix(path), 2, 16)).isin(*AUDIO, *VIDEO)
