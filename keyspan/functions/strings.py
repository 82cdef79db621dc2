"""Strings: literal (never regular-expression) semantics, ASCII white space, checked parses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyspan.functions.results import error, result

BLANKS = " \t\n\r\x0c"


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def trim(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


def contains(s: Column, part: Column) -> Column:
    return F.contains(s, part)


def split_once(s: Column, delimiter: str) -> Column:
    """Result of (before, after) the first delimiter."""
    at = F.instr(s, delimiter)
    pair = F.struct(F.substring(s, F.lit(1), at - 1).alias("before"), F.substring(s, at + len(delimiter), F.length(s)).alias("after"))
    return result(pair, (at == 0, error("MissingDelimiter", "split_once", s)))


def parse_int(s: Column) -> Column:
    """Result of a canonical decimal: an optional minus and digits."""
    value, valid = s.try_cast("long"), s.rlike(r"\A-?[0-9]+\z")
    return result(value, (~valid, error("InvalidInteger", "parse_int", s)), (valid & value.isNull(), error("IntegerOverflow", "parse_int", s)))


def is_numeric(s: Column) -> Column:
    return s.rlike(r"\A[0-9]+\z")


def lines(s: Column) -> Column:
    """Lines; a final newline adds no empty one, and an empty text has none."""
    body = F.regexp_replace(s, r"\n\z", "")
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def split(s: Column, separator: str) -> Column:
    """At every occurrence; an empty separator leaves the text whole."""
    if not separator:
        return F.array(s)
    return F.split(s, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def starts_with(s: Column, prefix: str) -> Column:
    return s.startswith(prefix)


def strip_prefix(s: Column, prefix: str) -> Column:
    """What follows the prefix, or null."""
    return F.when(s.startswith(prefix), F.substring(s, F.lit(len(prefix) + 1), F.length(s)))


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new)) if old else s


def join(xs: Column, separator: str) -> Column:
    return F.array_join(xs, separator)
