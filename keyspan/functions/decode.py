"""Typed decode of JSON and TOML into declared shapes, with row-level failures.

``try_json`` stays in Catalyst: JSON goes through VARIANT, which keeps each value's own
type.  A field of the wrong type, a missing required field, a duplicate key and text
behind the document are errors; unknown fields are ignored; an optional field may be
absent or null.  Records nest, and arrays hold scalars or records.

``decode_rows`` decodes JSON or TOML into any shape, tagged unions included, and says
where a document went wrong: kind, field path, place and length of the document.  It
parses in Arrow batches, since no built-in tells places or reads TOML.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.functions.results import error, result
from keyspan.types import Enum

#: Types that a VARIANT names for the JSON values a field may take.
_JSON_TYPES = {"bigint": ["BIGINT"], "string": ["STRING"], "boolean": ["BOOLEAN"], "double": ["DOUBLE", "BIGINT"]}


def _kind(t: T.DataType) -> str:
    name = t.simpleString()
    if name not in _JSON_TYPES:
        raise ValueError(f"decode has no field type {name}")
    return name


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _faults(root: Column, at: str, kind: T.DataType, path: str, required: bool) -> list[tuple[Column, str]]:
    """(test, message) of all that may be wrong with the VARIANT at a place of ``root``, outer faults first."""
    item = F.try_variant_get(root, at, "variant")
    named = F.schema_of_variant(item)
    present = item.isNotNull() & (named != "VOID")
    found: list[tuple[Column, str]] = []
    if isinstance(kind, T.StructType):
        is_record = present & named.startswith("OBJECT")
        found.append((present & ~named.startswith("OBJECT"), f"{path}: wrong type"))
        for f in kind.fields:
            inner = _faults(root, f"{at}.{f.name}", f.dataType, f"{path}.{f.name}", not f.nullable)
            found += [(is_record & F.coalesce(test, F.lit(False)), message) for test, message in inner]
    elif isinstance(kind, T.ArrayType):
        is_array = present & named.startswith("ARRAY")
        found.append((present & ~named.startswith("ARRAY"), f"{path}: wrong type"))
        each = lambda x: F.coalesce(_any([test for test, _ in _faults(x, "$", kind.elementType, path, True)]), F.lit(False))
        elements = F.coalesce(F.try_variant_get(root, at, "array<variant>"), F.array().cast("array<variant>"))
        found.append((F.when(is_array, F.exists(elements, each)).otherwise(False), f"{path}: wrong element"))
    else:
        found.append((present & ~named.isin(_JSON_TYPES[_kind(kind)]), f"{path}: wrong type"))
    if required:
        found.append((~present, f"{path}: missing"))
    return found


def try_json(text: Column, schema: T.StructType) -> Column:
    """Result of a record. ``payload`` of an error is the field's path or the reason.

    The text is read as the only element of an array. A parser stops where the array
    ends, so text behind the document is either a second element or follows a closing bracket of
    its own: only a text that has one is read again, as the only value of an object, and what passes as
    both is one document with white space around it. A text that is not is read by
    itself, to tell what it is. Spark evaluates equal expressions of a row once.
    """
    array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    whole = F.when(F.instr(text, "]") == 0, True).otherwise(F.try_parse_json(F.concat(F.lit('{"document":'), text, F.lit("}"))).isNotNull())
    first, second = F.try_variant_get(array, "$[0]", "variant"), F.try_variant_get(array, "$[1]", "variant")
    single = F.coalesce(first.isNotNull() & second.isNull() & whole, F.lit(False))
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    alone = F.when(single, False).otherwise(is_object(F.try_parse_json(text)))
    faults = [
        (F.when(single, ~is_object(first)).otherwise(~alone), error("InvalidText", "json", F.lit("not one JSON object"))),
        (~single, error("InvalidText", "json", F.lit("trailing text"))),
    ]
    fields = []
    for f in schema.fields:
        at = f"$[0].{f.name}"
        faults += [(test, error("InvalidText", "json", F.lit(message))) for test, message in _faults(array, at, f.dataType, f.name, not f.nullable)]
        fields.append(F.try_variant_get(array, at, f.dataType.simpleString()).alias(f.name))
    return result(F.struct(*fields), *faults)


# Shapes of ``decode_rows``.


@dataclass(frozen=True)
class Option:
    """A value that may be absent or null."""

    of: object


@dataclass(frozen=True)
class Sequence:
    """An array of one shape."""

    of: object


@dataclass(frozen=True)
class Record:
    name: str
    fields: Mapping[str, object]


@dataclass(frozen=True)
class Choice:
    """A tagged union by form: a string selects the variant of shape ``"String"``, a table the one that is a ``Record``."""

    name: str
    variants: Mapping[str, object]

    def enum(self) -> Enum:
        payload = {"String": {"text": T.StringType()}}
        return Enum(self.name, {k: payload["String"] if v == "String" else {} if v is None else {f: spark_type(s) for f, s in v.fields.items()} for k, v in self.variants.items()})


_SCALARS = {"Int": T.LongType(), "String": T.StringType(), "Bool": T.BooleanType()}


def spark_type(shape: object) -> T.DataType:
    if isinstance(shape, Option):
        return spark_type(shape.of)
    if isinstance(shape, Sequence):
        return T.ArrayType(spark_type(shape.of))
    if isinstance(shape, Record):
        return T.StructType([T.StructField(k, spark_type(v)) for k, v in shape.fields.items()])
    if isinstance(shape, Choice):
        return shape.enum().schema()
    return _SCALARS[shape]


class Fault(Exception):
    """A typed decode failure at a path of fields and positions."""

    def __init__(self, kind: str, path: tuple = (), detail: str = "", place: int | None = None):
        super().__init__(kind)
        self.kind, self.path, self.detail, self.place = kind, path, detail, place


class _Pairs(list):
    """A JSON object's members in order, repeats included."""


def _found(value: object) -> str:
    return {
        bool: "bool", int: "int", float: "float", str: "string", type(None): "null", list: "array", dict: "object", _Pairs: "object",
    }.get(type(value), type(value).__name__)


def _fields(name: str, fields: Mapping[str, object], value: object, path: tuple) -> dict:
    if not isinstance(value, (dict, _Pairs)):
        raise Fault("expected-object", path, f"{name}, found {_found(value)}")
    made: dict[str, object] = {}
    for key, item in value.items() if isinstance(value, dict) else value:
        if key in fields:
            if key in made:
                raise Fault("duplicate-field", (*path, key), name)
            made[key] = decoded(fields[key], item, (*path, key))
    for key, shape in fields.items():
        if key not in made:
            if not isinstance(shape, Option):
                raise Fault("missing-field", path, f"{name}.{key}")
            made[key] = None
    return {key: made[key] for key in fields}


def _only(shape: Choice, test, form: str, path: tuple) -> str:
    names = [k for k, v in shape.variants.items() if test(v)]
    if len(names) != 1:
        raise Fault(("ambiguous-" if names else "no-") + form, path, shape.name)
    return names[0]


def decoded(shape: object, value: object, path: tuple = ()) -> object:
    """``value`` in a shape; unknown fields are ignored. Raises ``Fault``."""
    if isinstance(shape, Option):
        return None if value is None else decoded(shape.of, value, path)
    if isinstance(shape, Sequence):
        if type(value) is not list:
            raise Fault("expected-array", path, f"found {_found(value)}")
        return [decoded(shape.of, x, (*path, k)) for k, x in enumerate(value)]
    if isinstance(shape, Record):
        return _fields(shape.name, shape.fields, value, path)
    if isinstance(shape, Choice):
        names = list(shape.variants)
        if isinstance(value, (dict, _Pairs)):
            name = _only(shape, lambda v: isinstance(v, Record), "table-form", path)
            payload = _fields(shape.name, shape.variants[name].fields, value, path)
        elif value is None or type(value) is list:
            raise Fault("expected-string-or-object", path, f"{shape.name}, found {_found(value)}")
        else:
            name = _only(shape, lambda v: v == "String", "string-form", path)
            payload = {"text": decoded("String", value, path)}
        return {"tag": names.index(name)} | {k: payload if k == name else None for k, v in shape.variants.items() if v is not None}
    if type(value) is not {"Int": int, "String": str, "Bool": bool}[shape]:
        raise Fault("expected-scalar", path, f"{shape}, found {_found(value)}")
    if shape == "Int" and not -(1 << 63) <= value < 1 << 63:
        raise Fault("int-out-of-range", path)
    return value


_BLANKS = " \t\n\r"


def _refuse(name: str) -> object:
    raise ValueError(f"{name} is no JSON")


_JSON = json.JSONDecoder(object_pairs_hook=_Pairs, parse_constant=_refuse)


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in _BLANKS:
        at += 1
    return at


def json_place(text: str, path: tuple) -> int:
    """Where the value at a path starts: the last one of a repeated field."""
    at = _skip(text, 0)
    for step in path:
        close, at, k, found = "]" if text[at] == "[" else "}", _skip(text, at + 1), 0, None
        while text[at] != close:
            key: object = k
            if close == "}":
                key, at = _JSON.raw_decode(text, at)
                at = _skip(text, _skip(text, at) + 1)
            if key == step:
                found = at
            at = _skip(text, _JSON.raw_decode(text, at)[1])
            at = _skip(text, at + 1) if text[at] == "," else at
            k += 1
        at = found
    return at


def decode_json(text: str, shape: object) -> object:
    """Raises ``Fault`` with its place, in characters."""
    try:
        value, end = _JSON.raw_decode(text, _skip(text, 0))
    except json.JSONDecodeError as e:
        raise Fault("parse-error", (), e.msg, e.pos) from e
    except (ValueError, RecursionError) as e:
        raise Fault("parse-error", (), str(e), 0) from e
    try:
        made = decoded(shape, value)
    except Fault as fault:
        fault.place = json_place(text, fault.path)
        raise
    if (end := _skip(text, end)) < len(text):
        raise Fault("trailing-content", (), "", end)
    return made


def decode_toml(text: str, shape: object) -> object:
    import tomllib

    try:
        value = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError) as e:
        raise Fault("parse-error", (), str(e)) from e
    return decoded(shape, value)


DECODE_ERROR = T.StructType(
    [
        T.StructField("kind", T.StringType()), T.StructField("path", T.StringType()), T.StructField("detail", T.StringType()),
        T.StructField("document_offset", T.LongType()), T.StructField("document_len", T.LongType()),
    ]
)


def decode_rows(df: DataFrame, keys: list[str], text: str, shape: object, format: str = "json", name: str = "decoded") -> DataFrame:
    """Key columns and ``name``, a struct of ok and err, for each row.

    Places and lengths are in bytes of UTF-8 (TOML tells no places); paths name fields. A
    null text is a parse error of length 0.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    read = {"json": decode_json, "toml": decode_toml}[format]
    out = T.StructType([*(df.schema[k] for k in keys), T.StructField(name, T.StructType([T.StructField("ok", spark_type(shape)), T.StructField("err", DECODE_ERROR)]))])
    arrow = to_arrow_schema(out)

    def one(value: str | None) -> dict:
        if value is None:
            return {"ok": None, "err": {"kind": "parse-error", "path": "", "detail": "no text", "document_offset": None, "document_len": 0}}
        try:
            return {"ok": read(value, shape), "err": None}
        except Fault as e:
            place = None if e.place is None else len(value[: e.place].encode())
            return {
                "ok": None,
                "err": {
                    "kind": e.kind, "path": ".".join(p for p in e.path if isinstance(p, str)), "detail": e.detail, "document_offset": place,
                    "document_len": len(value.encode()),
                }
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [one(t) for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(values, arrow.field(name).type)], schema=arrow)

    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, out)


def try_toml(df: DataFrame, keys: list[str], text: str, schema: T.StructType, name: str = "decoded") -> DataFrame:
    """Key columns and a struct of ok and err (a message) for each row, for a flat record."""
    shapes = {"bigint": "Int", "string": "String", "boolean": "Bool"}
    fields = {}
    for f in schema.fields:
        if f.dataType.simpleString() not in shapes:
            raise ValueError(f"decode has no field type {f.dataType.simpleString()}")
        shape = shapes[f.dataType.simpleString()]
        fields[f.name] = Option(shape) if f.nullable else shape
    out = decode_rows(df, keys, text, Record("record", fields), "toml", "__r")
    err = F.col("__r.err")
    missing = F.concat(F.regexp_extract(err["detail"], r"([^.]*)\z", 1), F.lit(": missing"))
    message = F.when(err["kind"] == "missing-field", missing).when(err["kind"].startswith("expected"), F.concat(err["path"], F.lit(": wrong type"))).otherwise(err["detail"])
    return out.select(*keys, F.struct(F.col("__r.ok").alias("ok"), F.when(err.isNotNull(), message).alias("err")).alias(name))
