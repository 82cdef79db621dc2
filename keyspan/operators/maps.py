"""Maps and sets as relations with unique keys: lookups, upserts, disjoint unions.

Lookups are joins; Spark picks the strategy from sizes it knows, and splits a key that
many rows probe.  Nothing here broadcasts a side by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keyspan.operators.keyed import DuplicateKey, least_duplicate
from keyspan.plans.order import by_key
from keyspan.sources.store import written


def literal(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A map from rows; raises on a repeated key."""
    found = least_duplicate(df, keys)
    if found is not None:
        raise DuplicateKey(f"DuplicateKey: {found}")
    return df


def concat_disjoint(m: DataFrame, n: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of two maps; raises with the least key that both have."""
    both = m.select(*keys).join(n.select(*keys), list(keys), "left_semi").orderBy(*(F.col(k).asc_nulls_last() for k in keys)).limit(1).collect()
    if both:
        raise DuplicateKey(f"DuplicateKey: {tuple(both[0])}")
    return m.unionByName(n)


def add(m: DataFrame, row: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One more row; raises if its key is there."""
    return concat_disjoint(m, row, keys)


def with_rows(m: DataFrame, n: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: rows of n replace those of m under the same key."""
    return m.join(n.select(*keys), list(keys), "left_anti").unionByName(n)


def get(probes: DataFrame, m: DataFrame, keys: Sequence[str], strict: bool = True) -> DataFrame:
    """Each probe with the map's row; a missing key fails the query, or with
    ``strict=False`` leaves nulls and ``found`` false."""
    marked = m.withColumn("found", F.lit(True))
    out = probes.join(marked, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if not strict:
        return out
    named = F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
    present = F.when(F.col("found"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("MissingKey: "), named)).cast("boolean"))
    return out.where(present).drop("found")


def has(probes: DataFrame, m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probes whose key is in the map; its values are not read."""
    return probes.join(m.select(*keys), list(keys), "left_semi")


def has_not(probes: DataFrame, m: DataFrame, keys: Sequence[str]) -> DataFrame:
    return probes.join(m.select(*keys), list(keys), "left_anti")


def size(m: DataFrame) -> DataFrame:
    return m.agg(F.count("*").alias("n"))


#: Bits of ``monotonically_increasing_id`` that count rows within a partition.
_WITHIN = 33


def positions(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """Dense positions from 0 in the given order, without a single-task window.

    Rows are dealt to ranges of the order, sorted there and written once with their
    range and place in it; ranges are counted in what was written, and the counts before
    each (one number for each range) are added.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    rows = written(ranged, "positions")
    part = F.shiftright("__place", _WITHIN)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.col("__place").bitwiseAND((1 << _WITHIN) - 1)
    # As many rows as ranges: at most the shuffle's partitions.
    joined = rows.withColumn("__part", part).join(F.broadcast(before), "__part")
    return joined.withColumn(name, (within + F.col("__before")).cast("long")).drop("__part", "__place", "__before")


def keys_array(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys in order, with positions."""
    return positions(m.select(*keys), *(F.col(k).asc_nulls_last() for k in keys))


def values_array(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values in key order under new, dense positions."""
    return positions(m, *(F.col(k).asc_nulls_last() for k in keys)).drop(*keys)


def resolve_unique(probes: DataFrame, m: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each probe's number of matches, and the values where there is exactly one."""
    # One row for each key of m, so a probed key is met once whatever the matches.
    per_key = m.groupBy(*keys).agg(F.count("*").alias("matches"), *(F.min(v).alias(v) for v in values))
    out = probes.join(per_key, list(keys), "left").withColumn("matches", F.coalesce("matches", F.lit(0)).cast("long"))
    return out.withColumns({v: F.when(F.col("matches") == 1, F.col(v)) for v in values})


def match_requirements(needs: DataFrame, offers: DataFrame, kind: str, low: str, capacity: str) -> DataFrame:
    """Each need with the best offer of its kind, or the reason why there is none."""
    best = offers.groupBy(kind).agg(F.max(capacity).alias("best"), F.count("*").alias("offers"))
    out = needs.join(best, kind, "left").withColumn("offers", F.coalesce("offers", F.lit(0)).cast("long"))
    reason = F.when(F.col("offers") == 0, "NoOfferOfKind").when(F.col("best") < F.col(low), "TooSmall").otherwise("Matched")
    return out.withColumn("verdict", reason)


# Sets: relations without repeated rows.


def to_set(df: DataFrame) -> DataFrame:
    return df.distinct()


def union(s: DataFrame, t: DataFrame) -> DataFrame:
    return s.unionByName(t).distinct()


def intersect(s: DataFrame, t: DataFrame) -> DataFrame:
    return s.intersect(t.select(*s.columns))


def symmetric_difference(s: DataFrame, t: DataFrame) -> DataFrame:
    """Rows of exactly one of two relations, with the side they are on. One shuffle."""
    sided = s.withColumn("__l", F.lit(1)).unionByName(t.select(*s.columns).withColumn("__l", F.lit(2)))
    grouped = sided.groupBy(*s.columns).agg(F.min("__l").alias("__a"), F.max("__l").alias("__b"))
    return grouped.where("__a = __b").withColumn("side", F.when(F.col("__a") == 1, "left").otherwise("right")).drop("__a", "__b")


def values_in_order(s: DataFrame) -> DataFrame:
    return s.orderBy(*by_key(s))


def prefix(df: DataFrame, count: int, *keys: Column | str) -> DataFrame:
    """The first rows of the total order; Spark plans a top-k."""
    return df.orderBy(*by_key(df, *keys)).limit(max(0, count))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ``points`` beside each of ``ranges`` with low <= point < high.

    Both sides meet in cells of ``width``, an equi-join that Spark shuffles and splits; a
    range is as many rows as it has cells, so the width should be near the usual range's
    length. Null points and bounds meet nothing, and neither do empty ranges.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    held = points.where(F.col(point).isNotNull()).withColumn("__cell", cell(point))
    real = ranges.where(F.col(low) < F.col(high)).withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    return held.join(real, "__cell").where((F.col(low) <= F.col(point)) & (F.col(point) < F.col(high))).drop("__cell")
