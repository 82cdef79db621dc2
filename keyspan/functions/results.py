"""Failures as values: ``Result`` structs of ok and err, strict and row-level forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyspan.types import ERROR, FAILURES


def error(code: str, site: str, payload: Column | None = None) -> Column:
    if code not in FAILURES:
        raise ValueError(f"unknown failure {code}")
    value = payload.cast("string") if payload is not None else F.lit(None).cast("string")
    return F.struct(F.lit(code).alias("code"), F.lit(site).alias("site"), value.alias("payload"))


def result(ok: Column, *faults: tuple[Column, Column]) -> Column:
    """ok where no fault holds, else the first fault's error.

    ``ok`` is evaluated behind the guards, so it may fail where a fault holds.
    """
    guard, which = F.lit(False), None
    for test, err in faults:
        guard = guard | F.coalesce(test, F.lit(False))
        which = F.when(test, err) if which is None else which.when(test, err)
    err = which if which is not None else F.lit(None).cast(ERROR)
    return F.struct(F.when(~guard, ok).alias("ok"), err.cast(ERROR).alias("err"))


def is_ok(value: Column) -> Column:
    return value["err"].isNull()


def strict(value: Column) -> Column:
    """The ok value; an error ends the query with its code and payload."""
    return F.when(value["err"].isNull(), value["ok"]).otherwise(F.raise_error(F.concat(value["err"]["code"], F.lit(": "), F.coalesce(value["err"]["payload"], F.lit("")))))


def fail(payload: Column) -> Column:
    """Raised, where it is demanded."""
    return F.raise_error(F.to_json(F.struct(payload.alias("raised"))))


def require(condition: Column, message: str, value: Column) -> Column:
    """``value`` where the condition holds, else a failure with the message."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def unwrap_or(value: Column, default: Column) -> Column:
    return F.coalesce(value, default)


def or_else(value: Column, other: Column) -> Column:
    return F.coalesce(value, other)


def is_some(value: Column) -> Column:
    return value.isNotNull()


def is_none(value: Column) -> Column:
    return value.isNull()
