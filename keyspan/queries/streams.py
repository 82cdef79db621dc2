"""Keyed streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.operators.keyed import KeyedStream, from_array
from keyspan.queries.registry import Tables, query


def _events(t: Tables, *values: str) -> KeyedStream:
    return KeyedStream(t.events.select("event_id", *values), ["event_id"])


@query("SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS value FROM embeddings")
def stream_posexplode(t: Tables) -> DataFrame:
    return from_array(t.embeddings.select("vec_id", "embedding"), ["vec_id"], F.col("embedding")).df.select("vec_id", F.col("pos").cast("long").alias("pos"), "value")


@query("SELECT event_id, event_type, value FROM events WHERE value > 40 AND event_type <> 'view'")
def stream_filter_keyed(t: Tables) -> DataFrame:
    return _events(t, "event_type", "value").filter((F.col("value") > 40) & (F.col("event_type") != "view")).df


@query("SELECT event_id, upper(event_type) AS kind FROM events")
def stream_map(t: Tables) -> DataFrame:
    return _events(t, "event_type").map(kind=F.upper("event_type")).df


@query("SELECT event_id, value * 2 AS doubled FROM events WHERE value > 50")
def stream_filter_map(t: Tables) -> DataFrame:
    return _events(t, "value").filter_map("doubled", F.when(F.col("value") > 50, F.col("value") * 2)).df


@query("SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos, unnest(string_split(p_name, ' ')) AS word FROM part")
def stream_flat_map(t: Tables) -> DataFrame:
    s = KeyedStream(t.part.select("p_partkey", "p_name"), ["p_partkey"]).flat_map(F.split("p_name", " ", -1), "word")
    return s.df.select("p_partkey", F.col("pos").cast("long").alias("pos"), "word")


@query("SELECT event_id, user_id, event_type FROM events WHERE value > 30 ORDER BY event_id")
def stream_collect(t: Tables) -> DataFrame:
    return _events(t, "user_id", "event_type", "value").filter(F.col("value") > 30).map(user_id=F.col("user_id"), event_type=F.col("event_type")).collect()


@query("SELECT event_id, value, r = 1 AS least FROM (SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) AS r FROM events)")
def stream_split_min(t: Tables) -> DataFrame:
    least, rest = _events(t, "value").split_min()
    return least.withColumn("least", F.lit(True)).unionByName(rest.df.withColumn("least", F.lit(False)))


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r FROM events) WHERE r = 1")
def stream_split_min_by(t: Tables) -> DataFrame:
    return _events(t, "value", "event_type").split_min_by("event_type").select("event_type", "event_id", "value")


@query(
    "SELECT (SELECT event_id FROM events WHERE value > 20 ORDER BY value, event_id LIMIT 1) AS low, (SELECT event_id FROM events WHERE value < 80 "
    "ORDER BY value DESC, event_id DESC LIMIT 1) AS high"
)
def stream_find_min_max(t: Tables) -> DataFrame:
    s = _events(t, "value")
    one = lambda df, name: df.select(F.col("found.event_id").alias(name))
    return one(s.find_min(F.col("value") > 20), "low").crossJoin(one(s.find_max(F.col("value") < 80), "high"))  # one row each


@query(
    "SELECT (SELECT event_id FROM events ORDER BY CASE WHEN value > 50 THEN value END NULLS LAST, event_id LIMIT 1) AS low, (SELECT event_id FROM "
    "events ORDER BY CASE WHEN value > 50 THEN value END DESC NULLS FIRST, event_id DESC LIMIT 1) AS high"
)
def stream_find_absent(t: Tables) -> DataFrame:
    """Absent values are the greatest, never the least."""
    s = _events(t, "value").map(value=F.when(F.col("value") > 50, F.col("value")))
    one = lambda df, name: df.select(F.col("found.event_id").alias(name))
    return one(s.find_min(F.lit(True)), "low").crossJoin(one(s.find_max(F.lit(True)), "high"))  # one row each


@query("SELECT bool_or(user_id = 7 AND event_type = 'click') AS click, false AS none FROM events")
def stream_contains(t: Tables) -> DataFrame:
    s = _events(t, "user_id", "event_type")
    held = s.contains(user_id=F.lit(7), event_type=F.lit("click")).select(F.col("any").alias("click"))
    return held.crossJoin(s.contains(event_type=F.lit("no such")).select(F.col("any").alias("none")))  # one row each


@query("SELECT count(*) AS n, bool_or(value > 99) AS found, bool_and(value > 0) AS whole FROM events")
def stream_count(t: Tables) -> DataFrame:
    s = _events(t, "value")
    return s.df.agg(
        F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("value") > 99), F.lit(False)).alias("found"),
        F.coalesce(F.bool_and(F.col("value") > 0), F.lit(True)).alias("whole"),
    )
