"""Versions with structural precedence, and sets of versions as interval lists.

A version is a struct whose field order is its precedence: major, minor, patch, then
a release after all its prereleases, then prerelease identifiers (numbers before
words).  Build metadata comes last and takes no part in precedence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_NUMBER = r"(?:0|[1-9][0-9]*)"
PATTERN = rf"\A({_NUMBER})(?:\.({_NUMBER}))?(?:\.({_NUMBER}))?(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?\z"


def _identifiers(pre: Column) -> Column:
    """tag 0: a number; tag 1: a word."""
    parts = F.when(pre == "", F.array().cast("array<string>")).otherwise(F.split(pre, r"\.", -1))
    number = lambda p: p.rlike(r"\A[0-9]+\z")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.when(number(p), 0).otherwise(1).alias("tag"),
            F.coalesce(F.when(number(p), p.try_cast("long")), F.lit(0).cast("long")).alias("num"),
            F.when(number(p), "").otherwise(p).alias("alpha"),
        ),
    )


def parse(text: Column) -> Column:
    """The version, or null where the text is none. Missing parts read 0."""
    part = lambda k: F.regexp_extract(text, PATTERN, k)
    number = lambda k: F.when(part(k) == "", F.lit(0).cast("long")).otherwise(part(k).try_cast("long"))
    whole = F.struct(
        number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"),
        F.struct((part(4) == "").cast("int").alias("is_release"), _identifiers(part(4)).alias("ids")).alias("pre"), part(5).alias("build"),
    )
    return F.when(text.rlike(PATTERN), whole)


def precedence(version: Column) -> Column:
    """What is compared: all but the build."""
    return F.struct(version["major"].alias("major"), version["minor"].alias("minor"), version["patch"].alias("patch"), version["pre"].alias("pre"))


@dataclass(frozen=True, order=True)
class Bound:
    """A version as an interval's end; ``pre`` is (is_release, identifiers) and orders as the column does."""

    major: int
    minor: int
    patch: int
    pre: tuple[int, tuple[tuple[int, int, str], ...]] = (1, ())

    @property
    def line(self) -> tuple[int, int, int]:
        return self.major, self.minor, self.patch

    def column(self) -> Column:
        one = [F.struct(F.lit(tag).alias("tag"), F.lit(num).cast("long").alias("num"), F.lit(alpha).alias("alpha")) for tag, num, alpha in self.pre[1]]
        pre = F.struct(F.lit(self.pre[0]).alias("is_release"), F.array(*one).cast("array<struct<tag:int,num:bigint,alpha:string>>").alias("ids"))
        return F.struct(
            F.lit(self.major).cast("long").alias("major"), F.lit(self.minor).cast("long").alias("minor"),
            F.lit(self.patch).cast("long").alias("patch"), pre.alias("pre"),
        )


@dataclass(frozen=True)
class Interval:
    """low <= v < high, each open or closed; None is unbounded. Prereleases are admitted on ``lines`` only."""

    low: Bound | None = None
    low_in: bool = True
    high: Bound | None = None
    high_in: bool = False
    lines: frozenset[tuple[int, int, int]] = frozenset()

    def meet(self, other: Interval, either: bool = False) -> Interval | None:
        """Their common part; it admits the lines that both admit, or either of them (comparators of one requirement)."""
        low, low_in = max(((i.low, not i.low_in) for i in (self, other) if i.low is not None), default=(None, False))
        high, high_in = min(((i.high, i.high_in) for i in (self, other) if i.high is not None), default=(None, False))
        made = Interval(low, not low_in if low is not None else True, high, high_in, self.lines | other.lines if either else self.lines & other.lines)
        return None if made.is_empty() else made

    def is_empty(self) -> bool:
        return self.low is not None and self.high is not None and (self.low > self.high or self.low == self.high and not (self.low_in and self.high_in))


def _prerelease(text: str | None) -> tuple[int, tuple[tuple[int, int, str], ...]]:
    """As ``_identifiers`` reads it; a number past 64 bits counts as 0 there too."""
    if text is None:
        return 1, ()
    number = lambda p: re.fullmatch(r"[0-9]+", p) is not None
    return 0, tuple((0, int(p) if int(p) < 1 << 63 else 0, "") if number(p) else (1, 0, p) for p in text.split("."))


def parse_requirement(text: str) -> list[Interval]:
    """Comma-separated comparators (``*``, ``>= <= > < = ^ ~`` or a bare version, read as ``^``), all of which hold.

    Missing numbers read 0, also in ``>``, ``<=`` and ``^``; ``~`` and ``=`` span what is
    missing. A comparator's prerelease admits the prereleases of its release line.
    """
    out = [Interval()]
    for part in text.split(","):
        part = part.strip()
        if part in ("*", ""):
            continue
        found = re.fullmatch(r"(>=|<=|>|<|\^|~|=)?\s*([0-9]+)(?:\.([0-9]+|\*))?(?:\.([0-9]+|\*))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?", part)
        if not found or found[5] is not None and "*" in found.groups():
            raise ValueError(f"not a requirement: {part!r}")
        op, *numbers, pre = found.groups()
        known = [int(n) for n in numbers if n not in (None, "*")]
        at = Bound(*(known + [0, 0])[:3], _prerelease(pre))
        exact = len(known) == 3 or pre is not None
        carets = next((k for k, n in enumerate(at.line) if n), 2)  # the leftmost number that is not zero may not change
        after = [Bound(at.major + 1, 0, 0), Bound(at.major, at.minor + 1, 0), Bound(at.major, at.minor, at.patch + 1)]
        if op == ">=":
            one = Interval(at)
        elif op == ">":
            one = Interval(at, False)
        elif op == "<":
            one = Interval(high=at)
        elif op == "<=":
            one = Interval(high=at, high_in=True)
        elif op == "=":
            one = Interval(at, True, at, True) if exact else Interval(at, True, after[len(known) - 1])
        elif op == "~":
            one = Interval(at, True, after[min(len(known), 2) - 1])
        else:
            one = Interval(at, True, after[carets])
        if pre is not None:
            one = replace(one, lines=frozenset([at.line]))
        out = [m for i in out if not one.is_empty() and (m := i.meet(one, either=True)) is not None]
    return out


def contains(intervals: list[Interval], version: Column) -> Column:
    """Whether a set of versions contains one. A prerelease is admitted on an interval's lines only."""
    p = precedence(version)
    tests = []
    for i in intervals:
        test = version["pre"]["is_release"] == 1
        for major, minor, patch in sorted(i.lines):
            test = test | ((version["major"] == major) & (version["minor"] == minor) & (version["patch"] == patch))
        if i.low is not None:
            test = test & (p >= i.low.column() if i.low_in else p > i.low.column())
        if i.high is not None:
            test = test & (p <= i.high.column() if i.high_in else p < i.high.column())
        tests.append(test)
    whole = F.lit(False)
    for t in tests:
        whole = whole | t
    return version.isNotNull() & whole


def intersect(a: list[Interval], b: list[Interval]) -> list[Interval]:
    return [m for x in a for y in b if (m := x.meet(y)) is not None]


#: Version sets as a column: intervals with their admitted release lines.
_VERSION_DDL = "struct<major:bigint,minor:bigint,patch:bigint,pre:struct<is_release:int,ids:array<struct<tag:int,num:bigint,alpha:string>>>>"
_LINE_DDL = "struct<major:bigint,minor:bigint,patch:bigint>"
SETS = f"array<struct<low:{_VERSION_DDL},low_in:boolean,high:{_VERSION_DDL},high_in:boolean,lines:array<{_LINE_DDL}>>>"


def _as_row(b: Bound | None) -> dict | None:
    if b is None:
        return None
    ids = [{"tag": tag, "num": num, "alpha": alpha} for tag, num, alpha in b.pre[1]]
    return {"major": b.major, "minor": b.minor, "patch": b.patch, "pre": {"is_release": b.pre[0], "ids": ids}}


def requirement_sets(df: DataFrame, text: str, name: str = "sets") -> DataFrame:
    """``df`` and the version set of each requirement text; null where the text is none.

    Texts are parsed once each: requirements repeat, so distinct ones meet rows by a join.
    """
    fields = to_arrow_schema(T.StructType.fromDDL(f"__text string, {name} {SETS}"))

    def one(value: str | None) -> list[dict] | None:
        try:
            found = parse_requirement(value)
        except (ValueError, AttributeError):
            return None
        return [
            {
                "low": _as_row(i.low), "low_in": i.low_in, "high": _as_row(i.high), "high_in": i.high_in,
                "lines": [dict(zip(("major", "minor", "patch"), line)) for line in sorted(i.lines)]
            }
            for i in found
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t) for t in batch.column(0).to_pylist()], fields.field(1).type)], schema=fields)

    parsed = df.select(F.col(text).cast("string").alias("__text")).distinct().mapInArrow(run, f"__text string, {name} {SETS}")
    return df.join(parsed, F.col(text).cast("string").eqNullSafe(F.col("__text")), "left").drop("__text")


def set_contains(sets: Column, version: Column) -> Column:
    """Whether a column of version sets contains a column of versions; false where either is null."""
    p = precedence(version)
    line = F.struct(version["major"].alias("major"), version["minor"].alias("minor"), version["patch"].alias("patch"))

    def inside(i: Column) -> Column:
        above = F.when(i["low"].isNull(), True).when(i["low_in"], p >= i["low"]).otherwise(p > i["low"])
        below = F.when(i["high"].isNull(), True).when(i["high_in"], p <= i["high"]).otherwise(p < i["high"])
        return above & below & ((version["pre"]["is_release"] == 1) | F.array_contains(i["lines"], line))

    return F.coalesce(F.exists(sets, inside), F.lit(False)) & version.isNotNull()


def set_meet(a: Column, b: Column) -> Column:
    """Pairwise common parts of two version sets (columns); admitted lines are those that both admit."""

    def end(x: Column, y: Column, side: str) -> tuple[Column, Column]:
        v, w, within = x[side], y[side], f"{side}_in"
        nearer = v > w if side == "low" else v < w
        take = F.when(w.isNull(), True).when(v.isNull(), False).otherwise(nearer | (v == w))
        both = v.isNotNull() & w.isNotNull() & (v == w)
        return F.when(take, v).otherwise(w), F.when(F.coalesce(both, F.lit(False)), x[within] & y[within]).when(take, x[within]).otherwise(y[within])

    def meet(x: Column, y: Column) -> Column:
        low, low_in = end(x, y, "low")
        high, high_in = end(x, y, "high")
        return F.struct(low.alias("low"), low_in.alias("low_in"), high.alias("high"), high_in.alias("high_in"), F.array_intersect(x["lines"], y["lines"]).alias("lines"))

    def real(i: Column) -> Column:
        empty = (i["low"] > i["high"]) | ((i["low"] == i["high"]) & ~(i["low_in"] & i["high_in"]))
        return ~F.coalesce(empty, F.lit(False))

    return F.filter(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: meet(x, y)))), real)
