"""Sessions with the settings that the algebra's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Errors are raised rather than nulled, duplicate keys rejected, time zones pinned.
SEMANTICS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "EXCEPTION",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str = "local[8]", name: str = "keyspan", **conf: str) -> SparkSession:
    """A session; keyword settings use ``__`` for the dots of Spark's names."""
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in (SEMANTICS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
