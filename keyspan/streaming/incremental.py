"""New files as they appear: a file stream whose batches are upserted under their keys.

There is no event time in the algebra, so no window and no watermark; what is
incremental is that each file is read once, and that of a key's rows the last in
order wins, whichever batch brought it.

The target is a folder of ``base-<batch>`` and ``delta-<batch>`` tables.  A batch writes
its own last rows as a delta, so its cost is that of the batch; after ``MERGE`` deltas a
base is written that stands for all before it.  A reader merges the newest whole base
with the whole deltas behind it.  Tables are named by Spark's batch number and a batch reads
nothing of its own, so a batch that is tried again writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from keyspan.sources.store import children, complete, delete, scratch_path

#: Deltas behind a base before the next base is written.
MERGE = 8


def last_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last; ties by the whole row."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(c) for c in (*order, *rest))))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def _tables(spark: SparkSession, target: str) -> tuple[str | None, list[str]]:
    """The newest whole base and the whole deltas behind it, oldest first."""
    names = [n for n in children(spark, target) if n[:5] in ("base-", "delta") and complete(spark, f"{target}/{n}")]
    base = max((n for n in names if n.startswith("base-")), default=None)
    after = base.split("-")[1] if base else ""
    return base, sorted(n for n in names if n.startswith("delta-") and n.split("-")[1] > after)


def upsert_new_files(spark: SparkSession, source: str, schema: T.StructType | str, keys: list[str], order: list[str], target: str, checkpoint: str) -> None:
    """Reads files under ``source`` not seen before and upserts them into ``target``."""

    def apply(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        last_by_key(batch, keys, order).write.mode("overwrite").parquet(f"{target}/delta-{number:010d}")
        base, deltas = _tables(session, target)
        if len(deltas) > MERGE:
            merged = current(session, target, schema, keys, order)
            merged.write.mode("overwrite").parquet(f"{target}/base-{deltas[-1].split('-')[1]}")
            for old in [*deltas[:-1], *([base] if base else [])]:  # readers of the newest base need none of them
                delete(session, f"{target}/{old}")

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, target: str, schema: T.StructType | str, keys: list[str], order: list[str]) -> DataFrame | None:
    """The map as of the last whole batch, or None."""
    base, deltas = _tables(spark, target)
    found = [f"{target}/{n}" for n in ([base] if base else []) + deltas]
    return last_by_key(spark.read.schema(schema).parquet(*found), keys, order) if found else None


def drained(spark: SparkSession, source: str, schema: T.StructType | str, keys: list[str], order: list[str]) -> DataFrame:
    """One pass over all files, from nothing: the map that the stream converges to."""
    target, checkpoint = scratch_path(spark, "target"), scratch_path(spark, "progress")
    upsert_new_files(spark, source, schema, keys, order, target, checkpoint)
    out = current(spark, target, schema, keys, order)
    return out if out is not None else spark.createDataFrame([], schema)
