"""Dense arrays as column values: positions from 0, failures checked, order structural."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyspan.functions.results import error, result, strict
from keyspan.plans.order import options_last, tagged


def span(low: Column, high: Column) -> Column:
    """low, low + 1 ... high - 1; empty where both are equal. Reversed bounds fail the query."""
    return strict(try_span(low, high))


def try_span(low: Column, high: Column) -> Column:
    """Result of ``span``; reversed bounds are an error, never a clamp."""
    whole = F.when(low < high, F.sequence(low, F.greatest(high - 1, low))).otherwise(F.array().cast("array<bigint>"))
    return result(whole, (low > high, error("IndexOutOfBounds", "span", F.concat_ws("..", low.cast("string"), high.cast("string")))))


def at(xs: Column, i: Column) -> Column:
    """Element i from 0; out of bounds fails the query."""
    return xs[i]


def try_at(xs: Column, i: Column) -> Column:
    return result(F.get(xs, i), ((i < 0) | (i >= F.size(xs)), error("IndexOutOfBounds", "at", i)))


def mapped(xs: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(xs, f)


def mapped_at(xs: Column, f: Callable[[Column], Column], i: int) -> Column:
    """Element i of a mapped array: f is applied to that element only."""
    return f(xs[i])


def fold(xs: Column, start: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Left to right."""
    return F.aggregate(xs, start, f)


def fold_until(xs: Column, start: Column, step: Callable[[Column, Column], Column], done: Callable[[Column], Column]) -> Column:
    """Left to right until ``done`` holds of the state: what follows is not stepped over."""
    more = lambda s: ~F.coalesce(done(s), F.lit(False))
    return F.aggregate(xs, start, lambda s, x: F.when(more(s), step(s, x)).otherwise(s))


def split_last(xs: Column) -> Column:
    """The last element and what precedes it; null for an empty array."""
    return F.when(F.size(xs) > 0, F.struct(F.try_element_at(xs, F.lit(-1)).alias("last"), F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0))).alias("rest")))


def sorted_by(xs: Column, key: Callable[[Column], Column]) -> Column:
    """Ascending by key, ties by the whole element; absence last in both."""
    pairs = F.transform(xs, lambda x: F.struct(tagged(key(x)).alias("by"), tagged(x).alias("tie"), x.alias("v")))
    return F.transform(F.sort_array(pairs), lambda p: p["v"])


def in_order(xs: Column) -> Column:
    """Ascending, absence last, repeats kept."""
    return options_last(xs)


def any_of(xs: Column, p: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(xs, lambda x: F.coalesce(p(x), F.lit(False))), F.lit(False))


def all_of(xs: Column, p: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.forall(xs, lambda x: F.coalesce(p(x), F.lit(False))), F.lit(True))


def contains(xs: Column, value: Column) -> Column:
    return F.coalesce(F.array_contains(xs, value), F.lit(False))


def first(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(1))


def last(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(-1))


def take(xs: Column, count: Column) -> Column:
    return F.slice(xs, F.lit(1), F.greatest(count, F.lit(0)))


def to_set(xs: Column) -> Column:
    return options_last(F.array_distinct(xs))
