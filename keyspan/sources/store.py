"""Tables in the folder that driver and executors share, and how long they stay there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The folder of each local application without a setting of its own; Spark lets no session set it later.
_LOCAL: dict[str, str] = {}
#: Scratch tables of the scopes that are open, innermost last.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset a local session gets a folder of this machine; a cluster is refused."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _LOCAL:
            _LOCAL[application] = "file://" + tempfile.mkdtemp(prefix="shared-")
        known = _LOCAL[application]
    return known.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; the innermost open scope removes it at its end."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables made inside once it ends; nothing may read them after."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def finished(spark: SparkSession, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make`` as a table that outlives the scratch tables it was made from."""
    path = scratch_path(spark, what)
    with scope(spark):
        df = make()
        schema = df.schema
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _located(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _located(spark, path)
    return files.exists(target)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was committed whole: a torn write has no ``_SUCCESS``."""
    return exists(spark, f"{path}/_SUCCESS")


def delete(spark: SparkSession, path: str) -> None:
    files, target = _located(spark, path)
    files.delete(target, True)


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's file sources spell it."""
    files, target = _located(spark, path)
    return files.makeQualified(target).toString()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names right in a folder; none where it is missing."""
    files, target = _located(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []
