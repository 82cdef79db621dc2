"""Approximate nearest neighbours by adaptive dimension scan.

Index: unit vectors turned by one random rotation, dealt to inverted lists by their
nearest centroid.  Lists are packed into shards of bounded size, and a crowded list is
cut into several.

Search in two passes.  The first visits each query's nearest few lists.  Its k-th
best distance, and the distance within which the lists' sizes and radii let k others
be expected, bound what is still wanted; from the same figures follows how many such
vectors each list not visited may hold.  The second pass visits the lists that hold
the most of them, until those left are expected to hold a share ``missed`` of k.  So a
query among clusters ends after the first pass, and one without near neighbours looks at many lists.

Scan: candidates of the visited lists lie in column blocks of the rotated
dimensions, and after each column block those are abandoned whose partial distance
fails the test

    partial > threshold * d / D * (1 + epsilon / sqrt(d)) ** 2

(the hypothesis that the whole distance is below the threshold, the k-th best so far).
What survives all dimensions is scored exactly: cosine in double precision on the
original vectors.

Copies of a vector are one candidate with its smallest ids, so a vector that a third
of all rows share is compared once.  Centroids are fitted on at most ``Settings.sample`` vectors
and ``Settings.sample_bytes`` bytes; every vector is indexed.  The number of lists grows with the root of the
number of distinct vectors, up to ``Settings.max_lists``, which bounds what is sent to tasks.

Results for edge cases: vectors that are null, zero or hold null or non-finite
components, or whose length is not the commonest (ties: the greater),
and rows with a null id, take no part; repeated rows count once; ties go to the smaller id; a
query with fewer candidates than k gets all; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keyspan.llm.common import written


@dataclass(frozen=True)
class Settings:
    """Parameters of index and search."""

    k: int = 5
    sample: int = 65_536
    sample_bytes: int = 64 << 20
    max_lists: int = 4_096
    #: Lists of the first pass: this share of all, and at least ``min_probes``.
    first_share: float = 0.05
    min_probes: int = 16
    #: Neighbours that lists left out may hold, as expected, for each one wanted.
    missed: float = 0.15
    epsilon: float = 2.1
    column_block: int = 16
    rows_block: int = 8_192
    queries_block: int = 2_048
    seed: int = 7


@dataclass(frozen=True)
class Index:
    """What tasks need: the rotation, the centroids (rotated), sizes, mean squared radii and shards of lists."""

    rotation: np.ndarray
    centroids: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    splits: np.ndarray


def _rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row, in slices of bounded size."""
    half = (centroids**2).sum(1) / 2
    step = max(1, (8 << 20) // max(1, len(centroids)))
    return np.concatenate([np.zeros(0, np.int64), *((x[i : i + step] @ centroids.T - half).argmax(1) for i in range(0, len(x), step))])


def kmeans(x: np.ndarray, lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centroids of unit vectors; an empty one stays where it was."""
    draw = np.random.default_rng(seed)
    centroids = x[np.sort(draw.choice(len(x), lists, replace=False))].copy()
    for _ in range(rounds):
        near = _nearest(x, centroids)
        order = np.argsort(near, kind="stable")
        found, first = np.unique(near[order], return_index=True)
        centroids[found] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return centroids


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _normal(z: np.ndarray) -> np.ndarray:
    """Distribution function of the normal distribution, to three digits."""
    return 0.5 * (1 + np.tanh(np.sqrt(2 / np.pi) * (z + 0.044715 * z**3)))


def expected(index: Index, distances: np.ndarray, within: float) -> np.ndarray:
    """How many members of each list are within a squared distance of a query.

    ``distances``: of the query to the centroids, squared. A member's distance is taken as
    normal: its offset from the centroid has the list's radius and any direction.
    """
    d = index.centroids.shape[1]
    spread = 2 * np.sqrt(np.maximum(distances * index.radii / d, 1e-12))
    return index.sizes * _normal((within - distances - index.radii) / spread)


def nearest_lists(index: Index, distances: np.ndarray, probes: int, keep: int) -> np.ndarray:
    """The nearest lists: ``probes`` of them, and more until they hold ``keep`` vectors."""
    order = np.argsort(distances, kind="stable")
    enough = int((np.cumsum(index.sizes[order]) < keep).sum()) + 1
    return order[: max(probes, enough)]


def further_lists(index: Index, distances: np.ndarray, visited: np.ndarray, best: float, k: int, missed: float) -> np.ndarray:
    """Lists of the second pass: all but those that together are expected to hold ``missed`` * k of what is still wanted."""
    low, high = 0.0, 4.0
    for _ in range(24):  # the distance within which k others are expected
        middle = (low + high) / 2
        low, high = (middle, high) if expected(index, distances, middle).sum() < k + 1 else (low, middle)
    held = expected(index, distances, min(best, high))
    held[visited] = 0.0
    order = np.argsort(held, kind="stable")
    return np.sort(order[np.cumsum(held[order]) > missed * k])


def scan(query: np.ndarray, columns: list[np.ndarray], rows: np.ndarray, keep: int, epsilon: float, first: int = 128, chunk: int = 2048, known: float = np.inf) -> np.ndarray:
    """Those of ``rows`` that no test abandoned and that are among the ``keep`` best of them.

    ``columns``: for each column block an array (dimensions, candidates); ``rows``: the
    candidates to scan, the most promising first. The threshold is the ``keep``-th best
    whole distance so far, or ``known`` where that is less; the first rows set it, all
    others are tested against it.
    """
    d = len(query)
    best_at, best = np.zeros(0, np.int64), np.zeros(0)
    threshold, start, size = known, 0, first
    while start < len(rows):
        alive = rows[start : start + size]
        start, size = start + size, chunk
        partial, done = np.zeros(len(alive)), 0
        for block in columns:
            partial = partial + ((block[:, alive] - query[done : done + len(block), None]) ** 2).sum(0)
            done += len(block)
            if threshold < np.inf:
                # Whole distances are compared as they are, but for rounding.
                limit = threshold * (1.0 + 1e-9) if done == d else threshold * done / d * (1.0 + epsilon / np.sqrt(done)) ** 2
                ok = partial <= limit
                alive, partial = alive[ok], partial[ok]
                if not len(alive):
                    break
        if len(alive):
            best_at, best = np.concatenate([best_at, alive]), np.concatenate([best, partial])
            if len(best) > keep:
                # Ties with the last one stay; equal distances are told apart by their ids later.
                limit = np.partition(best, keep - 1)[keep - 1]
                top = best <= limit * (1.0 + 1e-9)
                best_at, best = best_at[top], best[top]
            if len(best) >= keep:
                threshold = min(known, np.partition(best, keep - 1)[keep - 1])
    return best_at


def packed(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each list: small lists share one, a crowded one has several."""
    first, splits = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // block))
    shard, room = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if splits[i] > 1:
            shard += 1
            first[i], shard, room = shard, shard + int(splits[i]) - 1, 0
        else:
            if n > room:
                shard, room = shard + 1, block
            first[i], room = shard, room - n
    return first, splits


def nearest(df: DataFrame, is_query: Column, settings: Settings = Settings(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each query row."""
    spark, k, keep = df.sparkSession, settings.k, settings.k + 1
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<float>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    rows = rows.where(F.size("v") == d)
    # Copies: the smallest ids of each vector; Spark keeps the first ranks within each task before it shuffles.
    place = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    distinct = rows.dropDuplicates(["vec_id", "v"]).withColumn("place", place).where(F.col("place") <= keep)
    distinct = distinct.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asking = rows.where("asks").select("v").distinct().withColumn("asked", F.lit(True))
    distinct = written(distinct.join(asking, "v", "left").select("v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "vectors")

    n = distinct.count()
    rotation = _rotation(d, settings.seed)
    sample = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(max(1, min(settings.sample, settings.sample_bytes // (8 * d)))).toArrow()["v"]
    x = _units(_matrix(sample, d)) @ rotation
    lists = max(1, min(settings.max_lists, len(x), round(n**0.5)))
    centroids = kmeans(x, lists, settings.seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = _units(_matrix(batch.column(0), d)) @ rotation
            near = _nearest(turned, centroids)
            radius = ((turned - centroids[near]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(radius), *batch.columns], names=["list", "radius", "v", "ids", "asked"])

    placed = written(distinct.mapInArrow(assign, "list int, radius double, v array<float>, ids array<long>, asked boolean"), "lists")
    sizes, radii = np.zeros(lists, np.int64), np.zeros(lists)
    for row in placed.groupBy("list").agg(F.count("*").alias("n"), F.avg("radius").alias("radius")).collect():  # one row a list at most
        sizes[row["list"]], radii[row["list"]] = row["n"], row["radius"]
    index = Index(rotation, centroids, sizes, radii, *packed(sizes, settings.rows_block))
    probes = min(lists, max(settings.min_probes, round(lists * settings.first_share)))

    def first_pass(distances: np.ndarray, best: float) -> np.ndarray:
        return nearest_lists(index, distances, probes, keep)

    def second_pass(distances: np.ndarray, best: float) -> np.ndarray:
        return further_lists(index, distances, nearest_lists(index, distances, probes, keep), best, k, settings.missed)

    asks = placed.where("asked").select("v", F.lit(float("inf")).alias("best"))
    found = written(_visited(asks, placed, index, settings, first_pass), "found")
    top = W.partitionBy("q").orderBy(F.desc("score"))
    # The query's own vector is among the best: it is the k + 1st that bounds the others.
    ranked = found.withColumn("place", F.row_number().over(top)).where(F.col("place") <= keep)
    best = ranked.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    limit = F.when(F.col("n") == keep, 2 - 2 * F.col("worst")).otherwise(F.lit(float("inf")))
    again = asks.select("v").join(best.select(F.col("q").alias("v"), limit.alias("best")), "v")
    near = found.unionByName(_visited(again, placed, index, settings, second_pass)).select("q", "score", F.explode("ids").alias("vec_id"))
    by_score = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= keep).select("q", "score", "vec_id")
    near = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("near"))  # k + 1 at most
    # Spark splits the rows of a vector that many queries share.
    queries = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()
    others = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    out = queries.join(near, "q").select("query_id", F.posexplode(others).alias("pos", "c"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), (-F.col("c.minus")).alias("score"))


def _visited(asks: DataFrame, placed: DataFrame, index: Index, settings: Settings, choose: Callable[[np.ndarray, float], np.ndarray]) -> DataFrame:
    """q, score and ids of the best that each asking vector (v, best) finds in the lists that ``choose`` gives it."""
    spark, d, keep = asks.sparkSession, index.centroids.shape[1], settings.k + 1
    lists = len(index.sizes)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                turned = _units(_matrix(part.column(0), d)) @ index.rotation
                distances = (turned**2).sum(1)[:, None] + (index.centroids**2).sum(1) - 2 * turned @ index.centroids.T
                at, shard, own = [], [], []
                for i, best in enumerate(part.column(1).to_pylist()):
                    chosen = choose(np.maximum(distances[i], 0.0), best)
                    chosen = chosen[index.sizes[chosen] > 0]
                    heads = index.first[chosen]
                    for head in np.unique(heads).tolist():
                        of_head = chosen[heads == head]
                        # A crowded list is alone in its shards.
                        for s in range(head, head + int(index.splits[of_head].max())):
                            at.append(i)
                            shard.append(s)
                            own.append(of_head.tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard, pa.int32()), pa.array(own, pa.list_(pa.int32())), part.column(0).take(pa.array(at, pa.int64())),
                        part.column(1).take(pa.array(at, pa.int64())),
                    ],
                    names=["shard", "lists", "q", "best"],
                )

    wanted = written(asks.mapInArrow(visits, "shard int, lists array<int>, q array<float>, best double"), "visits")
    # Queries of a shard are dealt to blocks, too; a crowded list's shards have equal numbers.
    shards = int((index.first + index.splits).max(initial=0)) + 1
    blocks = np.ones(shards, np.int64)
    for row in wanted.groupBy("shard").count().collect():  # one row a shard
        blocks[row["shard"]] = -(-row["count"] // settings.queries_block)
    part_of = lambda value, n: F.pmod(F.xxhash64(value), n).cast("int")
    dealt = spark.createDataFrame(pa.table({"shard": np.arange(shards, dtype=np.int32), "blocks": blocks.astype(np.int32)}))
    queries = wanted.join(F.broadcast(dealt), "shard").select("shard", part_of("q", F.col("blocks")).alias("block"), "lists", "q", "best")  # one row a shard
    table = spark.createDataFrame(pa.table({"list": np.arange(lists, dtype=np.int32), "first": index.first.astype(np.int32), "splits": index.splits.astype(np.int32)}))
    candidates = placed.join(F.broadcast(table), "list")  # max_lists rows at most
    candidates = candidates.select((F.col("first") + part_of("v", F.col("splits"))).alias("shard"), "list", "v", "ids").join(F.broadcast(dealt), "shard")
    candidates = candidates.select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "list", "v", "ids")

    def search(asking: pa.Table, held: pa.Table) -> pa.Table:
        qs, found, scores = [], [], []
        if asking.num_rows and held.num_rows:
            held = held.sort_by("list")
            number = held["list"].to_numpy()
            low, high = np.searchsorted(number, np.arange(lists)), np.searchsorted(number, np.arange(lists), "right")
            original = _matrix(held["v"], d)
            norms = np.linalg.norm(original, axis=1)
            by_dimension = np.ascontiguousarray(((original / norms[:, None]) @ index.rotation).T)
            columns = [by_dimension[c : c + settings.column_block] for c in range(0, d, settings.column_block)]
            asked_for = _matrix(asking["q"], d)
            lengths = np.linalg.norm(asked_for, axis=1)
            rotated = (asked_for / lengths[:, None]) @ index.rotation
            for i, (own, best) in enumerate(zip(asking["lists"].to_pylist(), asking["best"].to_pylist())):
                rows = np.concatenate([np.zeros(0, np.int64), *(np.arange(low[x], high[x]) for x in own)])
                at = scan(rotated[i], columns, rows, keep, settings.epsilon, known=best)
                qs.append(np.full(len(at), i))
                found.append(at)
                scores.append((original[at] * asked_for[i]).sum(1) / (norms[at] * lengths[i]))
        place = np.concatenate([np.zeros(0, np.int64), *qs])
        at = np.concatenate([np.zeros(0, np.int64), *found])
        return pa.table(
            {
                "q": asking["q"].combine_chunks().take(pa.array(place)), "score": np.concatenate([np.zeros(0), *scores]),
                "ids": held["ids"].combine_chunks().take(pa.array(at)),
            }
        )

    # A cell: a shard of candidates with a block of the queries that visit it.
    return queries.groupBy("shard", "block").cogroup(candidates.groupBy("shard", "block")).applyInArrow(search, "q array<float>, score double, ids array<long>")
