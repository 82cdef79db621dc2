"""Maps and sets as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.operators import maps as M
from keyspan.queries.registry import Tables, query


@query("SELECT n_nationkey, n_name FROM nation")
def map_literal(t: Tables) -> DataFrame:
    return M.literal(t.nation.select("n_nationkey", "n_name"), ["n_nationkey"])


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT -1, 'NOWHERE'")
def map_add(t: Tables) -> DataFrame:
    row = t.spark.createDataFrame([(-1, "NOWHERE")], "n_nationkey int, n_name string")
    return M.add(t.nation.select("n_nationkey", "n_name"), row, ["n_nationkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders")
def map_concat_disjoint(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return M.concat_disjoint(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 <> 0"), ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'NEW' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def map_with_upsert(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    return M.with_rows(rows, rows.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("NEW").alias("o_orderstatus")), ["o_orderkey"])


@query("SELECT o_orderkey, c_custkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def map_get_join(t: Tables) -> DataFrame:
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customers = t.customer.select("c_custkey", "c_name", "c_nationkey")
    probes = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return M.get(M.get(probes, customers, ["c_custkey"]), nations, ["c_nationkey"]).select("o_orderkey", "c_custkey", "c_name", "n_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def map_has_semi(t: Tables) -> DataFrame:
    rich = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return M.has(t.customer.select("c_custkey", "c_name"), rich, ["c_custkey"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def map_hasnot_anti(t: Tables) -> DataFrame:
    return M.has_not(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


@query("SELECT count(*) AS n FROM orders")
def map_len(t: Tables) -> DataFrame:
    return M.size(t.orders)


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer")
def map_keys(t: Tables) -> DataFrame:
    return M.keys_array(t.customer.select("c_custkey"), ["c_custkey"])


@query("SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events WHERE value > 60")
def map_values_compact(t: Tables) -> DataFrame:
    return M.values_array(t.events.where("value > 60").select("event_id", "value"), ["event_id"])


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def set_distinct(t: Tables) -> DataFrame:
    return M.to_set(t.lineitem.select("l_returnflag", "l_linestatus"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t: Tables) -> DataFrame:
    return M.union(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")))


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 10)")
def set_has(t: Tables) -> DataFrame:
    return M.has(t.lineitem.select("l_partkey").distinct(), t.part.where("p_size = 10").select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"])


@query("SELECT count(DISTINCT l_suppkey) AS n FROM lineitem")
def set_len(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.countDistinct("l_suppkey").alias("n"))


@query("SELECT DISTINCT p_brand, p_size FROM part ORDER BY p_brand, p_size")
def set_values(t: Tables) -> DataFrame:
    return M.values_in_order(M.to_set(t.part.select("p_brand", "p_size")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t: Tables) -> DataFrame:
    return M.intersect(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")))


@query(
    "SELECT k, side FROM (SELECT k, CASE WHEN min(l) = 1 THEN 'left' ELSE 'right' END AS side, count(DISTINCT l) AS c FROM (SELECT c_nationkey AS "
    "k, 1 AS l FROM customer WHERE c_nationkey < 15 UNION ALL SELECT s_nationkey, 2 FROM supplier) GROUP BY k) WHERE c = 1"
)
def set_symdiff(t: Tables) -> DataFrame:
    return M.symmetric_difference(t.customer.where("c_nationkey < 15").select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")))


@query(
    "SELECT n_nationkey, coalesce(m, 0) AS matches, CASE WHEN m = 1 THEN s END AS s_suppkey FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS "
    "m, min(s_suppkey) AS s FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey"
)
def map_resolve_unique(t: Tables) -> DataFrame:
    offers = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return M.resolve_unique(t.nation.select("n_nationkey"), offers, ["n_nationkey"], ["s_suppkey"])


@query(
    "SELECT o_orderkey, coalesce(k, 0) AS offers, CASE WHEN k IS NULL THEN 'NoOfferOfKind' WHEN best < o_totalprice THEN 'TooSmall' ELSE 'Matched' "
    "END AS verdict FROM orders LEFT JOIN (SELECT c_custkey, max(c_acctbal * 30) AS best, count(*) AS k FROM customer WHERE c_custkey % 4 <> 0 "
    "GROUP BY 1) ON o_custkey = c_custkey"
)
def match_requirements(t: Tables) -> DataFrame:
    needs = t.orders.select("o_orderkey", F.col("o_custkey").alias("kind"), "o_totalprice")
    offers = t.customer.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("kind"), (F.col("c_acctbal") * 30).alias("room"))
    return M.match_requirements(needs, offers, "kind", "o_totalprice", "room").select("o_orderkey", "offers", "verdict")


@query("SELECT event_id, n_nationkey FROM events JOIN nation ON value >= n_nationkey * 3 AND value < n_nationkey * 3 + 5")
def range_join(t: Tables) -> DataFrame:
    """Events in the ranges that their value lies in; the ranges overlap."""
    ranges = t.nation.select("n_nationkey", (F.col("n_nationkey") * 3).cast("double").alias("low"), (F.col("n_nationkey") * 3 + 5).cast("double").alias("high"))
    return M.range_join(t.events.select("event_id", "value"), ranges, "value", "low", "high", 5.0).select("event_id", "n_nationkey")


@query("SELECT 200000 AS n, CAST(sum(r * r % 1000) AS BIGINT) AS total FROM range(200000) AS x(r)")
def map_accumulate(t: Tables) -> DataFrame:
    """A map of 200,000 rows, its keys checked, and a fold over its values."""
    rows = t.spark.range(200_000).select(F.col("id").alias("k"), (F.col("id") * F.col("id") % 1000).alias("v"))
    return M.literal(rows, ["k"]).agg(F.count("*").cast("int").alias("n"), F.sum("v").alias("total"))
