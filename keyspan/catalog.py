"""The engine's own queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyspan.queries import arrays, effects, maps, programs, scalars, streams, texts
from keyspan.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "arrays", "effects", "flagship", "maps", "programs", "scalars", "streams", "texts"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed filter, then the first rows of the total order by value."""
    return QUERIES["sort_by_key"](spark, sf_dir)
