"""Reuse of results across runs: by recipe and content, never by name alone.

A recipe is canonical JSON of operator names, parameters and child recipes.  A result
is kept with a receipt of what was read to make it: files' contents, folders' listings, and
what was looked for and was not there.  A demand looks among the receipts of its
recipe, newest first; the first whose every read still holds is a hit.  Where no
receipt holds the result is computed and kept with a new one.

Contents are hashed where they are read; a source of many files is one digest, made of
its files' relative paths and digests in two steps, so that no task holds all of them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.sources import trees
from keyspan.sources.store import children, complete, exists, qualified, shared_dir


def recipe(operator: str, *children: dict, **parameters: object) -> dict:
    return {"op": operator, "with": parameters, "of": list(children)}


def recipe_key(r: dict) -> str:
    return hashlib.sha256(json.dumps(r, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def source_digest(spark: SparkSession, path: str) -> str | None:
    """Digest of all below a path: relative paths and contents. None if nothing is there."""
    if not exists(spark, path):
        return None
    base = qualified(spark, path).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    line = F.concat_ws(" ", F.substring("path", len(base) + 1, 1 << 30), F.sha2("content", 256))
    lines = files.select(line.alias("line"), F.substring(F.sha2(line.cast("binary"), 256), 1, 3).alias("part"))
    parts = lines.groupBy("part").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("line"))), 256).alias("digest"))
    # 4,096 parts at most.
    return parts.agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws(" ", "part", "digest")))), 256)).first()[0]


def listing_digest(spark: SparkSession, path: str) -> str | None:
    """Digest of the names right in a folder. None if there is none."""
    return hashlib.sha256("\n".join(children(spark, path)).encode()).hexdigest() if exists(spark, path) else None


def source_digests(spark: SparkSession, paths: list[str]) -> dict[str, str | None]:
    return {path: source_digest(spark, path) for path in sorted(paths)}


_OBSERVE = {"content": source_digest, "listing": listing_digest}


@dataclass
class Reads:
    """What a computation looks at; each look is recorded with what it saw."""

    spark: SparkSession
    seen: dict[tuple[str, str], str | None] = field(default_factory=dict)

    def _look(self, kind: str, path: str) -> str | None:
        if (kind, path) not in self.seen:
            self.seen[kind, path] = _OBSERVE[kind](self.spark, path)
        return self.seen[kind, path]

    def parquet(self, path: str) -> DataFrame:
        self._look("content", path)
        return self.spark.read.parquet(path)

    def tree(self, path: str) -> DataFrame:
        self._look("content", path)
        return trees.tree(self.spark, path)

    def exists(self, path: str) -> bool:
        return self._look("content", path) is not None

    def listing(self, path: str) -> list[str]:
        self._look("listing", path)
        return children(self.spark, path)

    def receipt(self) -> list[dict]:
        return [{"kind": kind, "path": path, "digest": digest} for (kind, path), digest in sorted(self.seen.items())]


class Memo:
    """A cache in the shared folder. ``hits`` and ``misses`` count this object's demands."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/memo"
        self.hits = self.misses = 0

    def _receipts(self, key: str) -> list[tuple[str, list[dict]]]:
        """Paths and receipts of the whole results of a recipe, newest first."""
        found = []
        for name in reversed(children(self.spark, f"{self.root}/{key}")):
            path = f"{self.root}/{key}/{name}"
            if complete(self.spark, f"{path}/rows") and complete(self.spark, f"{path}/receipt"):
                found.append((path, [json.loads(r["value"]) for r in self.spark.read.text(f"{path}/receipt").collect()]))  # the reads of one computation
        return found

    def demand(self, r: dict, sources: list[str], compute: Callable[..., DataFrame]) -> DataFrame:
        """The recipe's result. ``sources`` are read in any case; ``compute`` may take a ``Reads`` and look at more."""
        key, now = recipe_key(r), Reads(self.spark)
        for path, receipt in self._receipts(key):
            if all(now._look(x["kind"], x["path"]) == x["digest"] for x in receipt) and set(sources) <= {x["path"] for x in receipt}:
                self.hits += 1
                return self.spark.read.parquet(f"{path}/rows")
        self.misses += 1
        reads = Reads(self.spark)
        for s in sources:
            reads._look("content", s)
        made = compute(reads) if compute.__code__.co_argcount else compute()
        count = len(children(self.spark, f"{self.root}/{key}"))
        path = f"{self.root}/{key}/{count:08d}-{uuid.uuid4().hex}"
        made.write.parquet(f"{path}/rows")
        lines = [(json.dumps(x, sort_keys=True),) for x in reads.receipt()]
        self.spark.createDataFrame(lines, "value string").coalesce(1).write.text(f"{path}/receipt")
        return self.spark.read.parquet(f"{path}/rows")
