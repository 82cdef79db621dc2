"""Sinks: canonical text of a relation, snapshots of it, and a journal of results."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.plans.order import tagged
from keyspan.sources.store import complete


def _canonical(value: Column, kind: T.DataType) -> Column:
    """JSON text of a value: fields in declaration order, absence as null, maps as entries by key."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), _canonical(value[f.name], f.dataType)) for f in kind.fields]
        inner = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        inner = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.sort_array(F.map_entries(value))
        inner = F.concat(
            F.lit("["),
            F.array_join(
                F.transform(
                    pairs,
                    lambda p: F.concat(
                        F.lit("["), _canonical(p["key"], kind.keyType), F.lit(","), _canonical(p["value"], kind.valueType), F.lit("]"),
                    ),
                ),
                ",",
            ),
            F.lit("]"),
        )
    else:
        # {"v":...} gives the value's own JSON between its fifth character and its last.
        inner = F.regexp_replace(F.substring(F.to_json(F.struct(value.alias("v"))), 6, (1 << 31) - 1), r"\}\z", "")
    return F.when(value.isNull(), F.lit("null")).otherwise(inner)


def canonical_text(df: DataFrame) -> DataFrame:
    """``line``: each row as canonical JSON, in total order; the same rows give the same lines however they are dealt."""
    kinds = df.schema
    ranks = [tagged(F.col(f"`{f.name}`"), f.dataType).alias(f"r{k}") for k, f in enumerate(kinds.fields) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    row = F.struct(*(F.col(f"`{f.name}`") for f in kinds.fields))
    lines = df.select(_canonical(row, T.StructType(kinds.fields)).alias("line"), F.struct(*ranks).alias("rank") if ranks else F.lit(0).alias("rank"))
    return lines.orderBy("rank", "line").select("line")


def digest(df: DataFrame) -> str:
    """SHA-256 over the sorted digests of the canonical lines, in two steps: no task holds all rows."""
    lines = canonical_text(df).select(F.sha2("line", 256).alias("d"))
    counted = lines.groupBy("d").count()
    parts = counted.groupBy(F.substring("d", 1, 3).alias("part")).agg(
        F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws(" ", "d", "count")))), 256).alias("digest")
    )
    rows = parts.orderBy("part").collect()  # 4,096 at most
    return hashlib.sha256("\n".join(f"{r['part']} {r['digest']}" for r in rows).encode()).hexdigest()


def write_snapshot(df: DataFrame, path: str) -> None:
    canonical_text(df).write.mode("overwrite").text(path)


def matches_snapshot(df: DataFrame, path: str) -> bool:
    """Whether a relation is what a snapshot holds; a missing one is written and matches."""
    spark = df.sparkSession
    if not complete(spark, path):
        write_snapshot(df, path)
        return True
    kept = spark.read.text(path).select(F.col("value").alias("line"))
    now = canonical_text(df)
    return now.exceptAll(kept).isEmpty() and kept.exceptAll(now).isEmpty()


#: A journal's entry: what was demanded, what it read, what came of it.
JOURNAL = "recipe string, receipt array<struct<kind:string,path:string,digest:string>>, digest string"


def append_journal(spark: SparkSession, path: str, recipe: str, receipt: list[dict], result: str) -> None:
    """One entry as a line of JSON; entries are files of their own, so writers do not meet."""
    spark.createDataFrame([(recipe, [(r["kind"], r["path"], r["digest"]) for r in receipt], result)], JOURNAL).coalesce(1).write.mode("append").json(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """All entries; a line that is none fails the read."""
    return spark.read.schema(JOURNAL).option("mode", "FAILFAST").json(path)
