"""Bytes: length, slices, text, decompression, archives, and pinned content."""

from __future__ import annotations

import gzip
import io
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.functions.results import error, result
from keyspan.sources.store import complete, exists, shared_dir


def length(blob: Column) -> Column:
    return F.octet_length(blob).cast("long")


def take(blob: Column, n: int) -> Column:
    return F.substring(blob, 1, max(n, 0))


def slice_of(blob: Column, start: int, count: int) -> Column:
    return F.substring(blob, start + 1, max(count, 0))


def try_text(blob: Column) -> Column:
    return F.try_validate_utf8(blob.cast("string"))


def digest(blob: Column) -> Column:
    return F.sha2(blob, 256)


@F.pandas_udf(T.StructType([T.StructField("ok", T.BinaryType()), T.StructField("err", T.StringType())]))
def gunzip(blobs: pd.Series) -> pd.DataFrame:
    """Result of decompressing each blob."""
    out = []
    for b in blobs:
        try:
            out.append((gzip.decompress(b), None))
        except (OSError, EOFError, TypeError, zlib.error) as e:
            out.append((None, f"MalformedArchive: {e}"))
    return pd.DataFrame(out, columns=["ok", "err"])


ENTRY = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("executable", T.BooleanType()),
        T.StructField("target", T.StringType()),
    ]
)


@F.udtf(returnType=ENTRY)
class Untar:
    """Rows of an archive's entries: files, folders and links."""

    def eval(self, blob: bytes) -> Iterator[tuple]:
        if blob is None:
            return
        try:
            with tarfile.open(fileobj=io.BytesIO(blob)) as archive:
                for entry in archive:
                    if entry.isfile() or entry.islnk():  # a hard link is a file with its target's bytes
                        content = archive.extractfile(entry).read()
                        yield entry.name, "file", len(content), content, bool(entry.mode & 0o111), None
                    elif entry.isdir():
                        yield entry.name, "dir", 0, None, False, None
                    elif entry.issym():
                        yield entry.name, "symlink", 0, None, False, entry.linkname
        except (tarfile.TarError, KeyError) as e:
            raise ValueError(f"MalformedArchive: {e}") from e


def fetch(spark: SparkSession, pins: DataFrame) -> DataFrame:
    """name and a result with the bytes of each pinned location (name, url, sha256).

    Content lies in the shared folder under its digest; what is not there whole is read from
    the location, checked against its pin and kept. ``url`` may be an array: origins are
    tried in their order until one has the pinned bytes. Pins are a short list of names.
    """
    store = f"{shared_dir(spark)}/content"
    rows = []
    for pin in pins.orderBy("name").collect():
        kept = f"{store}/{pin['sha256']}"
        if not complete(spark, kept):
            origins = pin["url"] if isinstance(pin["url"], list) else [pin["url"]]
            found, failure = None, "MissingRegistryArtifact"
            for origin in (o for o in origins if exists(spark, o)):
                good = spark.read.format("binaryFile").load(origin).select("content").where(digest(F.col("content")) == pin["sha256"])
                if not good.isEmpty():
                    found = good
                    break
                failure = "FetchIntegrity"
            if found is None:
                rows.append((pin["name"], None, failure))
                continue
            found.limit(1).write.mode("overwrite").parquet(kept)
        rows.append((pin["name"], pin["sha256"], None))
    found = spark.createDataFrame(rows, "name string, sha256 string, err string")
    names = [r[1] for r in rows if r[1]]
    if not names:
        return found.select("name", "sha256", F.lit(None).cast("binary").alias("content"), "err")
    contents = spark.read.parquet(*[f"{store}/{n}" for n in sorted(set(names))])
    return found.join(contents.withColumn("sha256", digest(F.col("content"))), "sha256", "left").select("name", "sha256", "content", "err")


def pinned_url(manifest: DataFrame, names: DataFrame) -> DataFrame:
    """Each name's location and pin, or the failure that the manifest lacks it."""
    joined = names.join(manifest, "name", "left")
    return joined.select("name", result(F.struct("url", "sha256"), (F.col("url").isNull(), error("MissingRegistryArtifact", "url", F.col("name")))).alias("pin"))
