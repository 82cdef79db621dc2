"""Mixing sources to target weights by Poisson replication.

The rate of a source is its target share of the output over its share of the input:
a document of that source is wanted so many times on average.  Each document draws a
count from the Poisson distribution of its rate by inverting it at a uniform number
made of a hash of seed and id, so the same document draws the same count on every
run and machine.  A document of count c is repeated c times, and a sort by the hash of seed, id and
copy shuffles the result globally.

Target weights are a bounded list; sources that are not in it share ``rest``.  The
count of each source is one aggregation that combines before it shuffles.  Rates meet
documents by broadcast only for sources with at least ``1 / max_sources`` of all
documents (there are ``max_sources`` at most); smaller ones are joined by key, where
none is hot.

Results for edge cases: null and empty texts are documents as any other; a null
source is a source of its own; repeated rows draw equal counts; a null id is hashed as ''; a
weight of 0 drops the source; an empty table gives an empty result; other columns
are carried along as they are, whatever their names; the columns added may be named, and a
name that the documents have already is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import written

#: Columns of this module in between; named so as not to clash.
_SOURCE, _RATE, _COUNT, _COPY, _KEY = "__source", "__rate", "__count", "__copy", "__key"


def uniform(seed: str, *parts: Column) -> Column:
    """In (0, 1), from the first 48 bits of an MD5: the same in any SQL engine."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def poisson_count(u: Column, rate: Column) -> Column:
    """The least k with u below the distribution function at k. ``rate`` up to 500.

    Terms are summed until they pass u; the bound is where the upper tail is below 2**-48.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    none = F.exp(-rate)
    # u is part of the state: made once, not at each step.
    start = F.struct(u.alias("u"), none.alias("p"), none.alias("c"), F.when(u < none, 0).otherwise(-1).alias("n"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        c = a["c"] + p
        n = F.when((a["u"] < c) | (k == last), k).otherwise(-1)
        return F.when(a["n"] >= 0, a).otherwise(F.struct(a["u"].alias("u"), p.alias("p"), c.alias("c"), n.alias("n")))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["n"])


def source_rates(df: DataFrame, weights: dict[str, float], rest: float = 1.0, epoch: float = 1.0, source_column: str = "source") -> DataFrame:
    """__source, __docs, __all and __rate of every source.

    ``weights``: relative target share of each named source; ``rest``: of each other one.
    ``epoch``: expected size of the output over that of the input.
    """
    counted = df.groupBy(F.col(f"`{source_column}`").cast("string").alias(_SOURCE)).agg(F.count("*").alias("__docs"))
    named = F.create_map(*(F.lit(x) for kv in weights.items() for x in (str(kv[0]), float(kv[1])))) if weights else None
    weight = F.coalesce(named[F.col(_SOURCE)], F.lit(float(rest))) if weights else F.lit(float(rest))
    counted = counted.withColumn("__weight", weight)
    # One row of sums; sources are far fewer than documents and combined before.
    sums = counted.agg(F.sum("__docs").alias("__all"), F.sum("__weight").alias("__weights"))
    rate = F.when(F.col("__weights") > 0, F.lit(float(epoch)) * F.col("__all") * F.col("__weight") / (F.col("__weights") * F.col("__docs"))).otherwise(F.lit(0.0))
    return counted.crossJoin(F.broadcast(sums)).select(_SOURCE, "__docs", "__all", rate.alias(_RATE))


def mixed(
    df: DataFrame, weights: dict[str, float], rest: float = 1.0, epoch: float = 1.0, seed: str = "mix-1", id_column: str = "doc_id",
    source_column: str = "source", max_sources: int = 1000, shuffled: bool = True, copy_name: str | None = None, key_name: str | None = None,
) -> DataFrame:
    """The documents, each as often as it drew, in the order of their keys: a hash of seed, id and copy.

    ``copy_name`` and ``key_name`` name columns for the copy's number, from 1, and the key.
    """
    clash = {copy_name, key_name} & set(df.columns)
    if clash:
        raise ValueError(f"the documents have columns {sorted(clash)}")
    rates = written(source_rates(df, weights, rest, epoch, source_column), "rates")
    large = F.col("__docs") * max_sources >= F.col("__all")
    # The document's own columns travel as one, so that no name of theirs can clash.
    own = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__own")
    rows = df.select(own, F.col(f"`{source_column}`").cast("string").alias("__of"), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("__id"))
    same = F.col("__of").eqNullSafe(F.col(_SOURCE))
    rated = rows.join(F.broadcast(rates.where(large).select(_SOURCE, _RATE)), same, "left").select("__own", "__of", "__id", _RATE)
    rare = rates.where(~large).select(_SOURCE, F.col(_RATE).alias("__small"))
    if not rare.isEmpty():
        others = rated.where(F.col(_RATE).isNull()).join(rare, same).select("__own", "__of", "__id", F.col("__small").alias(_RATE))
        rated = rated.where(F.col(_RATE).isNotNull()).unionByName(others)
    # Counts of very high rates: sums of Poisson draws are Poisson, so a rate splits into equal parts.
    rate = F.col(_RATE)
    parts = F.greatest(F.lit(1), F.ceil(rate / 400).cast("int"))
    draws = F.transform(F.sequence(F.lit(1), parts), lambda j: poisson_count(uniform(seed, F.col("__id"), j), rate / parts))
    count = F.when(rate > 0, F.aggregate(draws, F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0))
    out = rated.select("__own", "__id", count.alias(_COUNT)).where(F.col(_COUNT) > 0)
    out = out.select("__own", "__id", F.explode(F.sequence(F.lit(1), F.col(_COUNT))).alias(_COPY))
    out = out.select("__own", _COPY, F.md5(F.concat_ws(":", F.lit(seed), "__id", F.col(_COPY).cast("string")).cast("binary")).alias(_KEY))
    if shuffled:
        out = out.repartitionByRange(_KEY).sortWithinPartitions(_KEY)
    added = [F.col(made).alias(name) for made, name in ((_COPY, copy_name), (_KEY, key_name)) if name]
    return out.select(*(F.col("__own").getField(c).alias(c) for c in df.columns), *added)
