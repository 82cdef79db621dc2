"""Connected components of an edge table, by alternating star contractions.

Each round is two grouped passes over the edges that are left: every node links
its larger neighbours to its smallest one, then its smaller neighbours to the
smallest.  The number of edges never grows, a hub's edges are dealt by the smaller
side of each pair, and after a few rounds (logarithmic in the longest path) every
node points to the least node of its component.  Each round is written to the
shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import delete, scratch_path


def _larger_to_least(edges: DataFrame) -> DataFrame:
    """Large star: v's larger neighbours point to the least of v and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _smaller_to_least(edges: DataFrame) -> DataFrame:
    """Small star: v and its smaller neighbours point to the least of them. Here a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches), for every node of an edge.

    ``edges``: columns a and b of one ordered type. Direction, repeats, loops and
    nulls do not matter; rows with a null are left out.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType.simpleString()
    read = lambda path: spark.read.schema(f"a {kind}, b {kind}").parquet(path)
    path = scratch_path(spark, "edges")
    edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().write.parquet(path)
    while True:
        now = read(path)
        step = scratch_path(spark, "edges")
        _smaller_to_least(_larger_to_least(now)).write.parquet(step)
        after = read(step)
        # Both are sets of edges: equal if their sizes and the sums of their hashes are.
        sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        same = sign(now) == sign(after)
        delete(spark, path)
        path = step
        if same:
            break
    stars = read(path)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select(F.col("b"), F.col("b")).distinct())
