"""Dense arrays, folds, sorts and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.functions import arrays as A
from keyspan.functions.strings import join
from keyspan.operators import maps
from keyspan.operators.keyed import counted, fold_groups
from keyspan.plans.order import total_sort
from keyspan.queries.registry import Tables, query


def words() -> Column:
    """Words of a part's name: a small array in every row."""
    return F.split("p_name", " ", -1)


@query(
    "SELECT p_partkey, CASE WHEN p_size % 5 <= p_size % 7 THEN array_to_string(range(p_size % 5, p_size % 7), ',') END AS xs,"
    " CASE WHEN p_size % 5 > p_size % 7 THEN 'IndexOutOfBounds' END AS failure FROM part"
)
def arr_range(t: Tables) -> DataFrame:
    """Reversed bounds are an error."""
    xs = A.try_span((F.col("p_size") % 5).cast("long"), (F.col("p_size") % 7).cast("long"))
    return t.part.select("p_partkey", xs.alias("r")).select("p_partkey", join(F.col("r.ok").cast("array<string>"), ",").alias("xs"), F.col("r.err.code").alias("failure"))


@query("SELECT p_partkey, [p_size, 7, p_size] AS xs FROM part")
def arr_literal(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array("p_size", F.lit(7), "p_size").alias("xs"))


@query(
    "SELECT vec_id, embedding[3] AS third, CASE WHEN vec_id % 70 < 64 THEN embedding[vec_id % 70 + 1] END AS some, CASE WHEN vec_id % 70 >= 64 "
    "THEN 'IndexOutOfBounds' END AS failure FROM embeddings"
)
def arr_index(t: Tables) -> DataFrame:
    r = A.try_at(F.col("embedding"), (F.col("vec_id") % 70).cast("int"))
    return t.embeddings.select("vec_id", A.at(F.col("embedding"), F.lit(2)).alias("third"), r.alias("r")).select(
        "vec_id", "third", F.col("r.ok").alias("some"), F.col("r.err.code").alias("failure"),
    )


@query("SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n FROM part")
def arr_len(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.size(words()).cast("long").alias("n"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w) || '!'), ' ') AS xs FROM part")
def arr_map(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", join(A.mapped(words(), lambda w: F.concat(F.upper(w), F.lit("!"))), " ").alias("xs"))


@query("SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS total, count(*) AS n FROM orders GROUP BY o_custkey")
def agg_fold_sum(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.sum("o_orderkey").alias("total"), F.count("*").alias("n"))


@query("SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS states FROM orders GROUP BY o_custkey")
def agg_fold_concat(t: Tables) -> DataFrame:
    return fold_groups(t.orders, ["o_custkey"], ["o_orderkey"], "o_orderstatus", F.lit(""), lambda a, x: F.concat(a, x), "states")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def agg_count_by_key(t: Tables) -> DataFrame:
    return counted(t.events, "event_type")


@query(
    "SELECT p_partkey, list_last(string_split(p_name, ' ')) AS tail, array_to_string(list_slice(string_split(p_name, ' '), 1, "
    "len(string_split(p_name, ' ')) - 1), ' ') AS rest FROM part"
)
def arr_split_last(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", A.split_last(words()).alias("s")).select("p_partkey", F.col("s.last").alias("tail"), join(F.col("s.rest"), " ").alias("rest"))


@query("SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS xs FROM part")
def sort_array(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", join(A.in_order(words()), " ").alias("xs"))


@query("SELECT p_partkey, list_sort([p_size, NULL, p_size % 7], 'ASC', 'NULLS LAST') AS xs FROM part")
def sort_array_absent(t: Tables) -> DataFrame:
    """Absence comes last."""
    return t.part.select("p_partkey", A.in_order(F.array("p_size", F.lit(None).cast("int"), F.col("p_size") % 7)).alias("xs"))


@query("SELECT p_partkey, CAST(coalesce(nullif(list_position(list_transform(range(0, 9), lambda i: (p_size * (i + 1)) % 5 = 0), true), 0), 9) AS BIGINT) AS steps FROM part")
def agg_fold_until(t: Tables) -> DataFrame:
    """A state machine over an array that stops at the first multiple of five."""
    xs = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.col("p_size") * i)
    start = F.struct(F.lit(0).cast("long").alias("steps"), F.lit(False).alias("found"))
    end = A.fold_until(xs, start, lambda s, x: F.struct((s["steps"] + 1).alias("steps"), (x % 5 == 0).alias("found")), lambda s: s["found"])
    return t.part.select("p_partkey", end["steps"].alias("steps"))


@query("SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM events WHERE event_type <> 'view') WHERE r <= 10")
def sort_by_key(t: Tables) -> DataFrame:
    """Keys survive the filter; the top 10 by value in total order is one top-k."""
    return total_sort(t.events.where("event_type <> 'view'").select("event_id", "event_type", "value"), F.expr("-value")).limit(10)


@query("SELECT p_partkey, p_name || ' ' || p_brand AS xs FROM part")
def arr_append(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", join(F.array_append(words(), F.col("p_brand")), " ").alias("xs"))


@query("SELECT p_partkey, p_name || ' ' || p_type AS xs FROM part")
def arr_concat(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", join(F.concat(words(), F.split("p_type", " ", -1)), " ").alias("xs"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.35)) > 0 AS found FROM embeddings")
def arr_any(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", A.any_of(F.col("embedding"), lambda x: x > F.lit(0.35)).alias("found"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > -0.3)) = len(embedding) AS found FROM embeddings")
def arr_all(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", A.all_of(F.col("embedding"), lambda x: x > F.lit(-0.3)).alias("found"))


@query("SELECT p_partkey, list_contains(string_split(p_name, ' '), '7') AS found FROM part")
def arr_contains(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", A.contains(words(), F.lit("7")).alias("found"))


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS head, string_split(p_name, ' ')[-1] AS tail FROM part")
def arr_first_last(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", A.first(words()).alias("head"), A.last(words()).alias("tail"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, "
    "l_partkey, l_suppkey LIMIT 20"
)
def topk_take(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return maps.prefix(rows, 20, F.expr("-l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT p_partkey, replace(p_type, ' ', '-') AS s FROM part")
def str_join(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", join(F.split("p_type", " ", -1), "-").alias("s"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name || ' ' || p_name, ' '))), ' ') AS s FROM part")
def set_from_array(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", join(A.to_set(F.concat(words(), words())), " ").alias("s"))


@query("SELECT CAST(i AS BIGINT) AS i, CAST(i * 3 + 1 AS BIGINT) AS value FROM (VALUES (0), (1), (524288), (999999)) AS v(i)")
def arr_build_million(t: Tables) -> DataFrame:
    """A million elements as one array value, built by a map, then indexed."""
    xs = A.mapped(A.span(F.lit(0).cast("long"), F.lit(1_000_000).cast("long")), lambda x: x * 3 + 1)
    at = t.spark.createDataFrame([(0,), (1,), (524_288,), (999_999,)], "i long")
    built = t.spark.range(1).select(xs.alias("xs"))
    return built.crossJoin(F.broadcast(at)).select("i", A.at(F.col("xs"), F.col("i").cast("int")).alias("value"))  # one row beside four
