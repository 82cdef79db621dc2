"""Lockfiles: packages of a TOML lock, what they need, and the order to build them in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.functions.decode import Option, Record, Sequence, decode_rows
from keyspan.operators import graph

PACKAGE = Record("LockPackage", {"name": "String", "version": "String", "source": Option("String"), "checksum": Option("String"), "dependencies": Option(Sequence("String"))})
LOCK = Record("Lockfile", {"version": "Int", "package": Sequence(PACKAGE)})


class UnresolvableDependency(ValueError):
    """A dependency entry that names no package of its lock, or several by a bare name."""


def read_locks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and a struct of ok and err for each lock's text."""
    return decode_rows(df, [key], text, LOCK, "toml")


def packages(locks: DataFrame, key: str) -> DataFrame:
    """One row for each package of the locks that decode; ``pin`` is what a fetch of it has to match."""
    rows = locks.select(key, F.posexplode("decoded.ok.package").alias("pos", "p"))
    pin = F.when(F.col("p.checksum").isNotNull(), F.concat(F.lit("sha256:"), F.col("p.checksum")))
    return rows.select(
        key, "pos", "p.name", "p.version", F.col("p.source").isNotNull().alias("vendored"), pin.alias("pin"),
        F.coalesce("p.dependencies", F.array().cast("array<string>")).alias("dependencies"),
    )


def dependencies(rows: DataFrame, key: str) -> DataFrame:
    """key, name, version, entry, and the package that each entry names, with its number of matches.

    ``name version`` is taken as it says; a bare name is looked up among the packages of
    its lock and is resolved only if exactly one has it. An entry of either form that
    names no package has no match.
    """
    entries = rows.select(key, "name", "version", F.explode("dependencies").alias("entry"))
    space = F.instr("entry", " ")
    entries = entries.withColumns(
        {
            "need": F.when(space > 0, F.substring("entry", F.lit(1), space - 1)).otherwise(F.col("entry")),
            "at": F.when(space > 0, F.substring("entry", space + 1, F.length("entry"))),
        }
    )
    known = rows.select(key, F.col("name").alias("need"), F.col("version").alias("known"))
    exact = entries.where("at is not null").join(known.withColumn("at", F.col("known")).distinct(), [key, "need", "at"], "left")
    exact = exact.select(key, "name", "version", "entry", "need", F.col("known").alias("need_version"), F.col("known").isNotNull().cast("long").alias("matches"))
    by_name = known.groupBy(key, "need").agg(F.count("*").alias("matches"), F.min("known").alias("known"))
    bare = entries.where("at is null").join(by_name, [key, "need"], "left")
    bare = bare.select(
        key, "name", "version", "entry", "need", F.when(F.col("matches") == 1, F.col("known")).alias("need_version"),
        F.coalesce("matches", F.lit(0)).cast("long").alias("matches"),
    )
    return exact.unionByName(bare)


def build_order(rows: DataFrame, key: str) -> DataFrame:
    """key, name, version and round: a package comes one round after the last one it needs.

    Packages on or behind a cycle have no row, so a short order tells a cycle. An entry
    that resolves to no single package raises.
    """
    needs = dependencies(rows, key)
    bad = needs.where("matches <> 1").orderBy(key, "entry").limit(1).collect()
    if bad:
        raise UnresolvableDependency(f"{bad[0]['entry']!r} of lock {bad[0][key]!r} has {bad[0]['matches']} matches")
    node = lambda name, version: F.struct(F.col(key).alias("lock"), F.col(name).alias("name"), F.col(version).alias("version"))
    nodes = rows.select(node("name", "version").alias("node"))
    edges = needs.select(node("name", "version").alias("src"), node("need", "need_version").alias("dst"))
    rounds = graph.topological_rounds(nodes, edges, cycles="short")
    return rounds.select(F.col("node.lock").alias(key), "node.name", "node.version", "round")
