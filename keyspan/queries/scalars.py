"""Projection, construction, control, arithmetic and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.functions import arith, paths
from keyspan.plans.order import compare, entries
from keyspan.queries.registry import Tables, query
from keyspan.types import Enum, destructure, let, make_record, ordered_match, spread

#: An order's state, with and without a payload.
STATE = Enum("State", {"Open": {}, "Filled": {"price": T.DoubleType()}, "Other": {"code": T.StringType()}})


def _state(status: Column, price: Column) -> Column:
    return F.when(status == "O", STATE.make("Open")).when(status == "F", STATE.make("Filled", price=price)).otherwise(STATE.make("Other", code=status))


@query("SELECT r_regionkey, true AS b, 42 AS i, 'x' AS s, 'a/b' AS p FROM region")
def proj_literals(t: Tables) -> DataFrame:
    return t.region.select("r_regionkey", F.lit(True).alias("b"), F.lit(42).alias("i"), F.lit("x").alias("s"), paths.to_text(F.lit("a/b")).alias("p"))


@query("SELECT o_orderkey, o_custkey + o_custkey AS twice, o_orderstatus || o_orderstatus AS both FROM orders")
def let_destructure(t: Tables) -> DataFrame:
    """A pair is bound once, taken apart, and its parts are used."""
    pair = F.struct(F.col("o_custkey").alias("_0"), F.col("o_orderstatus").alias("_1"))
    made = let(pair, lambda p: destructure(p, ("_0", "_1"), lambda n, s: F.struct((n + n).alias("twice"), F.concat(s, s).alias("both"))))
    return t.orders.select("o_orderkey", made.alias("r")).select("o_orderkey", "r.twice", "r.both")


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS size, CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_size < 25 "
    "THEN -1 WHEN p_size = 25 THEN 0 ELSE 1 END AS INTEGER) AS o FROM part"
)
def cmp_absent(t: Tables) -> DataFrame:
    """Absence inside a record comes after every value."""
    size = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size"))
    kind = T.StructType([T.StructField("size", T.IntegerType())])
    return t.part.select("p_partkey", size.alias("size"), compare(F.struct(size.alias("size")), F.struct(F.lit(25).alias("size")), kind).alias("o"))


@query("SELECT o_orderkey, o_custkey AS a, o_orderstatus AS b FROM orders")
def proj_tuple(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", F.struct(F.col("o_custkey").alias("_0"), F.col("o_orderstatus").alias("_1")).alias("t"),
    ).select("o_orderkey", F.col("t._0").alias("a"), F.col("t._1").alias("b"))


@query("SELECT c_custkey, 'X-' || c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def proj_record_spread(t: Tables) -> DataFrame:
    base = make_record(name=F.col("c_name"), balance=F.col("c_acctbal"), segment=F.col("c_mktsegment"))
    return t.customer.select("c_custkey", spread(base, name=F.concat(F.lit("X-"), F.col("c_name"))).alias("r")).select("c_custkey", "r.name", "r.balance", "r.segment")


@query("SELECT p_partkey, p_brand AS brand FROM part")
def proj_field(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", make_record(brand=F.col("p_brand"), size=F.col("p_size")).alias("r")).select("p_partkey", F.col("r").getField("brand").alias("brand"))


@query(
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS tag, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END "
    "AS price, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN o_orderstatus END AS code FROM orders"
)
def enum_construct(t: Tables) -> DataFrame:
    e = t.orders.select("o_orderkey", _state(F.col("o_orderstatus"), F.col("o_totalprice")).alias("e"))
    return e.select(
        "o_orderkey", F.col("e.tag").alias("tag"), STATE.payload(F.col("e"), "Filled")["price"].alias("price"),
        STATE.payload(F.col("e"), "Other")["code"].alias("code"),
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity * 2 + 1) * 2 + 1 AS twice FROM lineitem")
def hof_twice(t: Tables) -> DataFrame:
    def twice(f, x: Column) -> Column:
        return f(f(x))

    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", twice(lambda x: x * 2 + 1, F.col("l_quantity")).alias("twice"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS size FROM orders")
def ctl_if(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 100000, "large").otherwise("small").alias("size"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other ' || o_orderstatus END AS label FROM orders")
def ctl_match(t: Tables) -> DataFrame:
    e = t.orders.select("o_orderkey", _state(F.col("o_orderstatus"), F.col("o_totalprice")).alias("e"))
    label = STATE.match(F.col("e"), {"Open": F.lit("open"), "Filled": F.lit("filled"), "Other": F.concat(F.lit("other "), F.col("e.Other.code"))})
    return e.select("o_orderkey", label.alias("label"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 AND p_brand LIKE '%1' THEN 'M1' WHEN p_size < 30 THEN 'M' ELSE 'L' END AS grade FROM part")
def ctl_match_guard(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.part.select(
        "p_partkey",
        ordered_match(
            [(size < 10, F.lit("S")), ((size < 30) & F.col("p_brand").endswith("1"), F.lit("M1")), (size < 30, F.lit("M"))], F.lit("L"),
        ).alias("grade"),
    )


@query("SELECT event_id, event_type FROM events WHERE (value > 50 OR event_type = 'click') AND NOT (user_id % 2 = 0)")
def filt_bool(t: Tables) -> DataFrame:
    return t.events.where(((F.col("value") > 50) | (F.col("event_type") == "click")) & ~(F.col("user_id") % 2 == 0)).select("event_id", "event_type")


@query("SELECT o_orderkey, o_orderkey + o_custkey AS s, o_orderkey - o_custkey AS d, o_orderkey * o_custkey AS p FROM orders")
def math_int(t: Tables) -> DataFrame:
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select("o_orderkey", (a + b).alias("s"), (a - b).alias("d"), (a * b).alias("p"))


@query(
    "SELECT event_id, CASE WHEN d <> 0 THEN sign(a) * (abs(a) // d) END AS q, CASE WHEN d = 0 THEN 'DivisionByZero' END AS failure FROM (SELECT "
    "event_id, event_id - 500 AS a, user_id % 5 AS d FROM events)"
)
def math_div(t: Tables) -> DataFrame:
    """Quotients towards zero, of negative dividends too."""
    r = arith.try_div(F.col("event_id") - 500, F.col("user_id") % 5)
    return t.events.select("event_id", r.alias("r")).select("event_id", F.col("r.ok").alias("q"), F.col("r.err.code").alias("failure"))


@query("SELECT event_id, -(event_id - 500) AS n FROM events")
def math_negate(t: Tables) -> DataFrame:
    return t.events.select("event_id", arith.negate(F.col("event_id") - 500).alias("n"))


@query("SELECT event_id, (event_id - 500) % 7 AS r FROM events")
def math_rem(t: Tables) -> DataFrame:
    return t.events.select("event_id", arith.rem(F.col("event_id") - 500, F.lit(7)).alias("r"))


@query("SELECT o_orderkey, CAST(o_custkey - 75 AS VARCHAR) AS text FROM orders")
def math_int_to_string(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", arith.to_text(F.col("o_custkey") - 75).alias("text"))


@query("SELECT a.c_custkey, a.c_nationkey = b.s_nationkey AND a.c_mktsegment = 'BUILDING' AS same FROM customer a JOIN supplier b ON a.c_custkey = b.s_suppkey")
def cmp_struct_eq(t: Tables) -> DataFrame:
    joined = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"))
    one = entries(F.create_map(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("s"), F.col("c_mktsegment")))
    two = entries(F.create_map(F.lit("s"), F.lit("BUILDING"), F.lit("n"), F.col("s_nationkey").cast("string")))
    return joined.select("c_custkey", (one == two).alias("same"))


@query("SELECT p_partkey, CAST(CASE WHEN (p_size, p_brand) < (25, 'Brand#3') THEN -1 WHEN (p_size, p_brand) = (25, 'Brand#3') THEN 0 ELSE 1 END AS INTEGER) AS o FROM part")
def cmp_spaceship(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", compare(F.struct("p_size", "p_brand"), F.struct(F.lit(25).alias("p_size"), F.lit("Brand#3").alias("p_brand"))).alias("o"))


@query("SELECT p_partkey, [p_size, 3] < [25] AS lt, [p_size, 3] >= [p_size] AS ge FROM part")
def cmp_derived(t: Tables) -> DataFrame:
    xs = F.array("p_size", F.lit(3))
    return t.part.select("p_partkey", (xs < F.array(F.lit(25))).alias("lt"), (xs >= F.array("p_size")).alias("ge"))
