"""Keyed unordered streams: rows that carry their key through every step.

Filters never renumber, maps never touch the key, flat_map composes keys, and
``collect`` is the one place where rows get an order and keys must be unique.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keyspan.plans.order import by_key, tagged


class DuplicateKey(ValueError):
    """A key that two rows have; the least one is named."""


def least_duplicate(df: DataFrame, keys: Sequence[str]) -> tuple | None:
    """The least key that two rows share. Counts are combined before the shuffle."""
    found = df.groupBy(*keys).count().where("count > 1").orderBy(*(F.col(k).asc_nulls_last() for k in keys)).limit(1).collect()
    return tuple(found[0][k] for k in keys) if found else None


class KeyedStream:
    """A DataFrame with key columns; all others are the value."""

    def __init__(self, df: DataFrame, keys: Sequence[str]):
        missing = set(keys) - set(df.columns)
        if missing:
            raise ValueError(f"no such key columns: {sorted(missing)}")
        self.df, self.keys = df, list(keys)

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.keys]

    def filter(self, predicate: Column) -> KeyedStream:
        return KeyedStream(self.df.where(predicate), self.keys)

    def map(self, **values: Column) -> KeyedStream:
        """The given columns become the value; keys stay."""
        return KeyedStream(self.df.select(*self.keys, *(c.alias(n) for n, c in values.items())), self.keys)

    def filter_map(self, name: str, option: Column) -> KeyedStream:
        """The option's value where it has one; other rows go, keys stay."""
        return KeyedStream(self.df.select(*self.keys, option.alias(name)).where(F.col(name).isNotNull()), self.keys)

    def flat_map(self, items: Column, name: str, position: str = "pos") -> KeyedStream:
        """One row for each element; its key is the row's and the element's position."""
        return KeyedStream(self.df.select(*self.keys, F.posexplode(items).alias(position, name)), [*self.keys, position])

    def check_unique(self) -> KeyedStream:
        """Raises ``DuplicateKey`` with the least key that occurs twice (runs a job)."""
        found = least_duplicate(self.df, self.keys)
        if found is not None:
            raise DuplicateKey(f"DuplicateKey: {found}")
        return self

    def collect(self, check: bool = True) -> DataFrame:
        """The map: rows in key order, keys unique."""
        if check:
            self.check_unique()
        return self.df.orderBy(*(F.col(k).asc_nulls_last() for k in self.keys))

    def sorted_by(self, *keys: Column | str) -> DataFrame:
        return self.df.orderBy(*by_key(self.df, *keys))

    def _by_value(self) -> list[Column]:
        return [F.col(c).asc_nulls_last() for c in (*self.values, *self.keys)]

    def split_min(self) -> tuple[DataFrame, KeyedStream]:
        """The structurally least value (ties by key) and the rest under their keys.

        The least row is a top-1, each task's candidate at most; the rest is an
        anti-join with that single row.
        """
        least = self.df.orderBy(*self._by_value()).limit(1)
        rest = self.df.join(F.broadcast(least.select(*self.keys)), self.keys, "left_anti")  # one row
        return least, KeyedStream(rest, self.keys)

    def split_min_by(self, *group: str) -> DataFrame:
        """Least value of each group."""
        place = F.row_number().over(W.partitionBy(*group).orderBy(*self._by_value()))
        return self.df.withColumn("__place", place).where("__place = 1").drop("__place")

    def _row(self) -> Column:
        return F.struct(*(F.col(c) for c in (*self.values, *self.keys)))

    def _rank(self) -> Column:
        """What rows are compared by: values, then keys, absence last."""
        kinds = {f.name: f.dataType for f in self.df.schema.fields}
        return F.struct(*(tagged(F.col(c), kinds[c]).alias(c) for c in (*self.values, *self.keys)))

    def find_min(self, predicate: Column) -> DataFrame:
        """One row with the least value of those that match: null if there is none."""
        return self.df.where(predicate).agg(F.min_by(self._row(), self._rank()).alias("found"))

    def find_max(self, predicate: Column) -> DataFrame:
        return self.df.where(predicate).agg(F.max_by(self._row(), self._rank()).alias("found"))

    def contains(self, **values: Column) -> DataFrame:
        """Whether a row has these values; absence equals absence."""
        test = F.lit(True)
        for name, value in values.items():
            test = test & F.col(name).eqNullSafe(value)
        return self.any(test)

    def count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n"))

    def any(self, predicate: Column) -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_or(predicate), F.lit(False)).alias("any"))

    def all(self, predicate: Column) -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_and(predicate), F.lit(True)).alias("all"))


def from_array(df: DataFrame, keys: Sequence[str], items: Column, name: str = "value") -> KeyedStream:
    """An array column as a stream; positions become keys."""
    return KeyedStream(df, keys).flat_map(items, name)


def counted(df: DataFrame, *keys: str) -> DataFrame:
    """Occurrences of each key, as a map from key to count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def fold_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, start: Column, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """An order-sensitive fold of each group. A group is held in one task: for bounded groups only."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    ranks = [tagged(F.col(c), kinds[c]).alias(f"__by{k}") for k, c in enumerate((*order, value))]
    items = F.transform(F.sort_array(F.collect_list(F.struct(*ranks, F.col(value).alias("__v")))), lambda s: s["__v"])
    return df.groupBy(*keys).agg(items.alias("__items")).select(*keys, F.aggregate("__items", start, step).alias(name))
