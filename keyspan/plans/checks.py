"""Checks as rows: of values, and of how a plan came to them.

A check has a site, whether it passed, and what failed; a suite is the union of its
checks, each evaluated by itself, so that one failure hides no other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.sources.sinks import matches_snapshot

CHECK = "site string, passed boolean, failure string"


class Checks:
    """Checks of one suite, in order of their sites."""

    def __init__(self, spark: SparkSession):
        self.spark, self.found = spark, []

    def _add(self, site: str, passed: bool, failure: str | None = None) -> bool:
        self.found.append((site, bool(passed), None if passed else failure))
        return bool(passed)

    def _value(self, value: Column | object) -> object:
        return self.spark.range(1).select(value.alias("v")).first()["v"] if isinstance(value, Column) else value

    # Values.

    def expect(self, site: str, condition: Column | bool) -> bool:
        return self._add(site, self._value(condition) is True, "not true")

    def expect_eq(self, site: str, a: object, b: object) -> bool:
        x, y = self._value(a), self._value(b)
        return self._add(site, x == y, f"{x!r} is not {y!r}")

    def expect_ne(self, site: str, a: object, b: object) -> bool:
        x, y = self._value(a), self._value(b)
        return self._add(site, x != y, f"both are {x!r}")

    def expect_some(self, site: str, value: object) -> bool:
        return self._add(site, self._value(value) is not None, "absent")

    def expect_none(self, site: str, value: object) -> bool:
        found = self._value(value)
        return self._add(site, found is None, f"is {found!r}")

    def expect_fail(self, site: str, code: str, make: Callable[[], object]) -> bool:
        """``make`` has to fail with a code: as a result's error, or by raising."""
        try:
            found = make()
            found = self._value(found) if isinstance(found, Column) else found.collect() if isinstance(found, DataFrame) else found
        except Exception as e:  # noqa: BLE001 - any failure is what is looked at
            return self._add(site, code in str(e) or code in type(e).__name__, f"failed otherwise: {e}")
        err = found["err"] if hasattr(found, "asDict") and "err" in found.asDict() else None
        return self._add(site, err is not None and err["code"] == code, f"gave {found!r}")

    def expect_snapshot(self, site: str, df: DataFrame, path: str) -> bool:
        return self._add(site, matches_snapshot(df, path), f"differs from {path}")

    # Plans.

    def read(self, site: str, df: DataFrame, *columns: str) -> bool:
        missing = set(columns) - read_columns(df)
        return self._add(site, not missing, f"not read: {sorted(missing)}")

    def never_read(self, site: str, df: DataFrame, *columns: str) -> bool:
        there = set(columns) & read_columns(df)
        return self._add(site, not there, f"read: {sorted(there)}")

    def exchanges_at_most(self, site: str, df: DataFrame, n: int) -> bool:
        found = len(re.findall(r"\bExchange\b", plan_text(df)))
        return self._add(site, found <= n, f"{found} exchanges")

    def no_python(self, site: str, df: DataFrame) -> bool:
        found = re.findall(r"\w*(?:Python|Arrow|Pandas)\w*", plan_text(df))
        return self._add(site, not found, f"plan has {sorted(set(found))}")

    @contextmanager
    def jobs_at_most(self, site: str, n: int) -> Iterator[None]:
        """How many jobs what is inside starts."""
        sc, group = self.spark.sparkContext, f"checks-{len(self.found)}-{id(self)}"
        sc.setJobGroup(group, site)
        try:
            yield
        finally:
            jobs = len(sc.statusTracker().getJobIdsForGroup(group))
            sc.setLocalProperty("spark.jobGroup.id", None)
            self._add(site, jobs <= n, f"{jobs} jobs")

    def rows(self) -> DataFrame:
        return self.spark.createDataFrame(self.found, CHECK)

    def failures(self) -> list[tuple[str, str]]:
        return [(site, failure) for site, passed, failure in self.found if not passed]


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(df: DataFrame) -> set[str]:
    """Columns that the plan's scans read."""
    return {name for schema in re.findall(r"ReadSchema: struct<([^\n]*)>", plan_text(df)) for name in re.findall(r"(?:^|,)([A-Za-z_]\w*):", schema)}


def unpassed(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("passed"))
