"""Whole-number arithmetic with typed failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyspan.functions.results import error, result


def div(a: Column, d: Column) -> Column:
    """Quotient towards zero; a zero divisor fails the query."""
    return F.call_function("div", a.cast("long"), d.cast("long"))


def try_div(a: Column, d: Column) -> Column:
    return result(div(a, F.when(d == 0, F.lit(1)).otherwise(d)), (d == 0, error("DivisionByZero", "div")))


def rem(a: Column, d: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return a % d


def negate(n: Column) -> Column:
    """The least whole number has no negative: it fails the query."""
    return -n


def to_text(n: Column) -> Column:
    return n.cast("string")
