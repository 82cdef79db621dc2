"""Helpers shared by the training-data operators: tables and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from keyspan.sources.store import delete, finished, scope, scratch_path, shared_dir, written

__all__ = ["CHUNK_BYTES", "as_binary", "delete", "finished", "map_arrow", "pieces", "read_table", "scope", "scratch_path", "shared_dir", "written"]

#: Bytes of text that an operator works on at once inside an Arrow batch.
CHUNK_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_binary(column: pa.Array) -> pa.Array:
    """A string column as its UTF-8 bytes with 64-bit offsets; null stays null."""
    return column.cast(pa.large_binary())


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about ``limit`` bytes at most in each.

    One value larger than the limit forms a piece of its own.
    """
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, column: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """Runs a per-piece function in Arrow batches.

    ``make`` runs once in each task and returns a function from a record batch to
    ``{output column: values}``; ``schema`` is the DDL of the result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in pieces(batches, column, limit):
            out = work(part)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)
