"""Relative paths: joined by validated segments, taken apart by component."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def join(path: Column, segment: str) -> Column:
    """``path / segment``; the root is the empty path."""
    if not segment or segment in (".", "..") or "/" in segment or "\x00" in segment:
        raise ValueError(f"not a path segment: {segment!r}")
    return F.when(path == "", F.lit(segment)).otherwise(F.concat(path, F.lit("/"), F.lit(segment)))


def segments(path: Column) -> Column:
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/", -1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def _dot(name: Column) -> Column:
    """Place of the last dot that starts an extension, or 0: not a leading and not a final one."""
    at = F.length(name) - F.length(F.substring_index(name, ".", -1))
    return F.when((F.instr(name, ".") > 0) & (at > 1) & (at < F.length(name)), at).otherwise(F.lit(0))


def extension(path: Column) -> Column:
    name = file_name(path)
    return F.when(_dot(name) > 0, F.substring_index(name, ".", -1))


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(_dot(name) > 0, F.substring(name, F.lit(1), _dot(name) - 1)).otherwise(name)


def parent(path: Column) -> Column:
    name = file_name(path)
    return F.when(F.contains(path, F.lit("/")), F.substring(path, F.lit(1), F.length(path) - F.length(name) - 1)).otherwise(F.lit(""))


def to_text(path: Column) -> Column:
    """A path's spelling."""
    return path.cast("string")
