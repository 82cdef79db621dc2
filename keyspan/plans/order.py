"""One total structural order: every sort names all columns, absence comes last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sortable(df: DataFrame) -> list[str]:
    """Columns of types that have an order (maps have none)."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def by_key(df: DataFrame, *keys: Column | str) -> list[Column]:
    """Sort expressions: the keys, then the whole row as tie-breaker."""
    given = [F.col(k) if isinstance(k, str) else k for k in keys]
    named = {k for k in keys if isinstance(k, str)}
    return [k.asc_nulls_last() for k in given] + [F.col(f"`{c}`").asc_nulls_last() for c in sortable(df) if c not in named]


def total_sort(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.orderBy(*by_key(df, *keys))


def tagged(value: Column, kind: T.DataType | None = None) -> Column:
    """What is compared in place of ``value``: a tag before each value that may be absent, so absence comes last.

    With ``kind``, the value's type, absence inside records and arrays comes last, too.
    """
    if isinstance(kind, T.StructType):
        inner = F.when(value.isNotNull(), F.struct(*(tagged(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    elif isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda x: tagged(x, kind.elementType))
    else:
        inner = value
    return F.struct(value.isNull().alias("absent"), inner.alias("value"))


def compare(a: Column, b: Column, kind: T.DataType | None = None) -> Column:
    """-1, 0 or 1 by structural order, absence last (inside the values too, where their type is given)."""
    x, y = tagged(a, kind), tagged(b, kind)
    return F.when(x.eqNullSafe(y), F.lit(0)).when(x < y, F.lit(-1)).otherwise(F.lit(1))


def options_last(xs: Column, kind: T.DataType | None = None) -> Column:
    """An array in ascending order with its nulls last. ``kind``: the type of its elements."""
    pairs = F.transform(xs, lambda x: F.struct(tagged(x, kind).alias("by"), x.alias("v")))
    return F.transform(F.sort_array(pairs), lambda p: p["v"])


def entries(m: Column) -> Column:
    """A map as its canonical entry array, which has equality and order."""
    return F.sort_array(F.map_entries(m))


def keep_columns(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]
