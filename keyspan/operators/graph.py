"""Recursion over relations: closures, topological rounds, numeric loops.

Each round is a join against what is known so far and is written to the shared
folder, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.operators.maps import symmetric_difference
from keyspan.sources.store import written


#: Rounds whose nodes are kept apart before they are written as one table.
_MERGE = 8


def reach(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node and depth of all that is reachable; cycles end, each node has its least depth.

    Null nodes reach nothing. What is seen is written as one table every few rounds, so
    the plan has a bounded number of scans however deep the graph is.
    """
    seen = written(roots.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "reach")
    fringe, depth = seen, 0
    steps = written(edges.where("src is not null and dst is not null").select(F.col("src").alias("node"), "dst").distinct(), "steps")
    while True:
        depth += 1
        after = fringe.join(steps, "node").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        fringe = written(after.withColumn("depth", F.lit(depth)), "reach")
        if fringe.isEmpty():
            return seen
        seen = seen.unionByName(fringe)
        if depth % _MERGE == 0:
            seen = written(seen, "reach")


def select_test(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], root: object) -> DataFrame:
    """Whether a test has to run again: one row of verdict and changed (hashes of one side only).

    Each side is (atoms, edges): atoms have node, hash and unknown (what could not be
    followed, or null). ``UnknownRun`` where the root is missing or something unknown is
    reached on a side; else ``Reached`` if the hashes that the root reaches differ, and
    ``NotReached`` if not.
    """
    spark, sides = before[0].sparkSession, []
    for atoms, edges in (before, after):
        roots = atoms.where(F.col("node") == F.lit(root)).select("node")
        sides.append(written(reach(roots, edges).select("node").join(atoms.select("node", "hash", "unknown"), "node"), "reached"))
    unknown = any(s.isEmpty() or not s.where("unknown is not null").isEmpty() for s in sides)
    if unknown:
        return spark.createDataFrame([("UnknownRun", [])], "verdict string, changed array<string>")
    changed = symmetric_difference(*(s.select("hash").distinct() for s in sides)).select("hash")
    # The changed hashes of one test.
    out = changed.agg(F.sort_array(F.collect_list(F.col("hash").cast("string"))).alias("changed"))
    return out.select(F.when(F.size("changed") > 0, "Reached").otherwise("NotReached").alias("verdict"), "changed")


def topological_rounds(nodes: DataFrame, needs: DataFrame, cycles: str = "raise") -> DataFrame:
    """node and round: a node comes one round after the last thing it needs.

    ``needs``: src needs dst. What lies on or behind a cycle fails with ``ValueError``, or
    with ``cycles="short"`` has no row.
    """
    left = written(nodes.select("node").distinct(), "rounds")
    open_needs = written(needs.select(F.col("src").alias("node"), F.col("dst").alias("need")).distinct(), "rounds")
    done, number = None, 0
    while not left.isEmpty():
        ready = left.join(open_needs.select("node"), "node", "left_anti").withColumn("round", F.lit(number))
        ready = written(ready, "rounds")
        if ready.isEmpty() and cycles == "short":
            break
        if ready.isEmpty():
            raise ValueError(f"the needs of {left.orderBy('node').first()['node']!r} form a cycle")
        done = ready if done is None else done.unionByName(ready)
        left = written(left.join(ready, "node", "left_anti"), "rounds")
        open_needs = written(open_needs.join(ready.select(F.col("node").alias("need")), "need", "left_anti").select("node", "need"), "rounds")
        number += 1
    return done if done is not None else nodes.select("node").where("false").withColumn("round", F.lit(0))


def tail_sum(spark: SparkSession, low: int, high: int) -> DataFrame:
    """The accumulating loop over low .. high - 1, as a range and a sum."""
    return spark.range(low, high).agg(F.coalesce(F.sum("id"), F.lit(0)).alias("total"))
