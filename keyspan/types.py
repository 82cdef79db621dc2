"""Schemas for the algebra's types: records, tagged unions, options, results, paths.

A record is a struct in declaration order (that order is its sort order).  A tagged
union is a struct of ``tag`` and one nullable struct for each variant with a payload.
An option is a nullable column, a result a struct of ``ok`` and ``err``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of failure, as the ``code`` of an error.
FAILURES = (
    "IndexOutOfBounds", "MissingKey", "DuplicateKey", "MissingDelimiter", "InvalidInteger", "IntegerOverflow", "DivisionByZero", "ProcessFailure",
    "MissingTreeEntry", "TreeEntryNotAFile", "InvalidText", "MissingRegistryArtifact", "FetchIntegrity", "MalformedArchive", "Raised",
)

ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("site", T.StringType()), T.StructField("payload", T.StringType())])


def path_field(name: str, nullable: bool = False) -> T.StructField:
    """A relative path: a string that says so in its metadata."""
    return T.StructField(name, T.StringType(), nullable, {"kind": "path"})


def record(name: str, fields: Mapping[str, T.DataType]) -> T.StructType:
    """A nominal record type."""
    return T.StructType([T.StructField(k, v, True, {"record": name}) for k, v in fields.items()])


def make_record(**fields: Column) -> Column:
    return F.struct(*(c.alias(k) for k, c in fields.items()))


def spread(base: Column, **fields: Column) -> Column:
    """``base`` with some of its fields replaced."""
    for name, value in fields.items():
        base = base.withField(name, value)
    return base


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is bound to a name and computed once."""
    return F.transform(F.array(value), body)[0]


def destructure(value: Column, names: Sequence[str], body: Callable[..., Column]) -> Column:
    """``body`` of a record's or tuple's fields, in the given order."""
    return body(*(value[n] for n in names))


class Enum:
    """A tagged union; variants in declaration order, each with its payload fields."""

    def __init__(self, name: str, variants: Mapping[str, Mapping[str, T.DataType]]):
        self.name, self.variants = name, {k: dict(v) for k, v in variants.items()}

    @property
    def names(self) -> list[str]:
        return list(self.variants)

    def schema(self) -> T.StructType:
        fields = [T.StructField("tag", T.IntegerType(), False)]
        fields += [T.StructField(v, record(v, p), True) for v, p in self.variants.items() if p]
        return T.StructType(fields)

    def make(self, variant: str, **payload: Column) -> Column:
        """A value of one variant."""
        if variant not in self.variants or set(payload) != set(self.variants[variant]):
            raise ValueError(f"{self.name} has no variant {variant} with fields {sorted(payload)}")
        parts = [F.lit(self.names.index(variant)).alias("tag")]
        for name, fields in self.variants.items():
            if fields:
                kind = record(name, fields)
                own = F.struct(*(payload[f].cast(fields[f]).alias(f) for f in fields)) if name == variant else F.lit(None).cast(kind)
                parts.append(own.alias(name))
        return F.struct(*parts)

    def is_variant(self, value: Column, variant: str) -> Column:
        return value["tag"] == self.names.index(variant)

    def payload(self, value: Column, variant: str) -> Column:
        return value[variant]

    def match(self, value: Column, arms: Mapping[str, Column], default: Column | None = None) -> Column:
        """The arm of the value's variant; without a default every variant needs an arm."""
        missing = set(self.names) - set(arms)
        if set(arms) - set(self.names):
            raise ValueError(f"{self.name} has no variant {sorted(set(arms) - set(self.names))}")
        if missing and default is None:
            raise ValueError(f"match on {self.name} is not exhaustive: {sorted(missing)}")
        out = None
        for name, arm in arms.items():
            test = self.is_variant(value, name)
            out = F.when(test, arm) if out is None else out.when(test, arm)
        if out is None:
            return default
        return out.otherwise(default) if default is not None else out


def ordered_match(arms: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """The first arm whose guard holds; later guards are not evaluated for that row."""
    out = None
    for guard, value in arms:
        out = F.when(guard, value) if out is None else out.when(guard, value)
    return default if out is None else out.otherwise(default)
