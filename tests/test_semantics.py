"""Failures, order, absence and the traps of each scalar."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.functions import arith, arrays, decode, paths, results, semver
from keyspan.functions import strings as S
from keyspan.operators import graph, maps
from keyspan.operators.keyed import DuplicateKey, KeyedStream
from keyspan.plans import order
from keyspan.plans.memo import Memo, recipe, recipe_key
from keyspan.sources import blobs, trees
from keyspan.sources.store import scratch_path
from keyspan.types import Enum


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_order_is_by_code_point_and_absence_last(spark):
    assert one(spark, F.sort_array(F.array(F.lit("é"), F.lit("a"), F.lit("Z")))) == ["Z", "a", "é"]
    assert one(spark, order.options_last(F.array(F.lit(2), F.lit(None), F.lit(1)))) == [1, 2, None]
    assert one(spark, order.compare(F.array(F.lit(1)), F.array(F.lit(1), F.lit(0)))) == -1
    rows = spark.createDataFrame([(1, None), (1, 2), (0, 9)], "a int, b int")
    assert [tuple(r) for r in order.total_sort(rows, "a").collect()] == [(0, 9), (1, 2), (1, None)]


def test_enum_order_match_and_exhaustiveness(spark):
    e = Enum("E", {"A": {}, "B": {"n": T.LongType()}})
    xs = F.sort_array(F.array(e.make("B", n=F.lit(2)), e.make("A"), e.make("B", n=F.lit(1))))
    assert [(r["tag"], r["B"] and r["B"]["n"]) for r in one(spark, xs)] == [(0, None), (1, 1), (1, 2)]
    with pytest.raises(ValueError, match="not exhaustive"):
        e.match(e.make("A"), {"A": F.lit(1)})
    with pytest.raises(ValueError):
        e.make("B")


def test_whole_number_division(spark):
    assert one(spark, arith.div(F.lit(-7), F.lit(2))) == -3
    assert one(spark, arith.rem(F.lit(-7), F.lit(2))) == -1
    assert one(spark, arith.try_div(F.lit(1).cast("long"), F.lit(0).cast("long")))["err"]["code"] == "DivisionByZero"
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one(spark, arith.div(F.lit(1), F.lit(0)))
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        spark.range(1).select((F.col("id") + F.lit(2**63 - 1)) + 1).collect()


def test_arrays(spark):
    xs = F.array(F.lit(3), F.lit(1))
    assert one(spark, arrays.span(F.lit(2), F.lit(2))) == []
    assert one(spark, arrays.try_at(xs, F.lit(2)))["err"]["code"] == "IndexOutOfBounds"
    assert one(spark, arrays.try_at(xs, F.lit(-1)))["err"]["code"] == "IndexOutOfBounds"
    assert one(spark, arrays.split_last(F.array().cast("array<int>"))) is None
    assert one(spark, arrays.take(xs, F.lit(-1))) == []
    assert one(spark, arrays.any_of(F.array().cast("array<int>"), lambda x: x > 0)) is False
    assert one(spark, arrays.all_of(F.array().cast("array<int>"), lambda x: x > 0)) is True
    assert one(spark, arrays.sorted_by(xs, lambda x: -x)) == [3, 1]
    assert one(spark, arrays.mapped_at(xs, lambda x: x * 10, 1)) == 10
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        one(spark, arrays.at(xs, F.lit(2)))


@pytest.mark.parametrize(
    "text,value,code",
    [
        ("42", 42, None), ("-42", -42, None), ("007", 7, None), (" 42", None, "InvalidInteger"), ("", None, "InvalidInteger"),
        ("forty-two", None, "InvalidInteger"), ("9223372036854775808", None, "IntegerOverflow"), ("5\n", None, "InvalidInteger"),
    ],
)
def test_parse_int(spark, text, value, code):
    r = one(spark, S.parse_int(F.lit(text)))
    assert (r["ok"], r["err"] and r["err"]["code"]) == (value, code)


def test_strings(spark):
    assert one(spark, S.trim(F.lit("\t a b \n"))) == "a b"
    assert [one(spark, S.is_numeric(F.lit(x))) for x in ("007", "-3", "5\n", "")] == [True, False, False, False]
    assert one(spark, S.lines(F.lit("a\n\nb\n"))) == ["a", "", "b"]
    assert one(spark, S.lines(F.lit(""))) == []
    assert one(spark, S.split(F.lit("a.b."), ".")) == ["a", "b", ""]
    assert one(spark, S.split(F.lit("a.b"), "")) == ["a.b"]
    assert one(spark, S.split_once(F.lit("abc"), "="))["err"]["code"] == "MissingDelimiter"
    r = one(spark, S.split_once(F.lit("k=v=w"), "="))["ok"]
    assert (r["before"], r["after"]) == ("k", "v=w")
    assert one(spark, S.replace(F.lit("aaa"), "", "x")) == "aaa"
    assert one(spark, S.strip_prefix(F.lit("abc"), "x")) is None


def test_paths(spark):
    at = lambda f, p: one(spark, f(F.lit(p)))
    assert [at(paths.extension, p) for p in ("a/b.tar.gz", "a/.hidden", "a/b.", "a")] == ["gz", None, None, None]
    assert [at(paths.stem, p) for p in ("a/b.tar.gz", "a/.hidden", "a/b.")] == ["b.tar", ".hidden", "b."]
    assert (at(paths.parent, "a/b/c"), at(paths.parent, "c"), at(paths.file_name, "a/b")) == ("a/b", "", "b")
    assert one(spark, paths.join(F.lit(""), "x")) == "x"
    for bad in ("", "..", "a/b"):
        with pytest.raises(ValueError):
            paths.join(F.lit("a"), bad)


def test_duplicates_name_the_least_key(spark):
    rows = spark.createDataFrame([(3, "a"), (2, "b"), (3, "c"), (2, "d"), (1, "e")], "k int, v string")
    with pytest.raises(DuplicateKey, match=r"\(2,\)"):
        KeyedStream(rows, ["k"]).collect()
    with pytest.raises(DuplicateKey, match=r"\(2,\)"):
        maps.concat_disjoint(rows.where("k > 1"), rows, ["k"])


def test_strict_lookup_names_the_missing_key(spark):
    m = spark.createDataFrame([(1, "a")], "k int, v string")
    probes = spark.createDataFrame([(1,), (5,)], "k int")
    with pytest.raises(Exception, match="MissingKey: 5"):
        maps.get(probes, m, ["k"]).collect()
    assert sorted(tuple(r) for r in maps.get(probes, m, ["k"], strict=False).collect()) == [(1, "a", True), (5, None, False)]


def test_filters_keep_keys_and_empty_streams(spark):
    s = KeyedStream(spark.createDataFrame([(7, 1), (8, 2), (9, 3)], "k int, v int"), ["k"]).filter(F.col("v") != 2)
    assert [r["k"] for r in s.collect().collect()] == [7, 9]
    empty = s.filter(F.lit(False))
    assert empty.find_min(F.lit(True)).first()["found"] is None
    least, rest = empty.split_min()
    assert least.isEmpty() and rest.df.isEmpty()
    assert empty.any(F.lit(True)).first()[0] is False and empty.all(F.lit(False)).first()[0] is True


def test_positions_are_dense(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("k"))
    rows = maps.keys_array(df, ["k"]).orderBy("k").collect()
    assert [r["pos"] for r in rows] == list(range(100))


SCHEMA = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("n", T.LongType(), True)])


@pytest.mark.parametrize(
    "text,payload",
    [
        ('{"name": "a", "n": 1, "more": []}', None), ('{"name": "a"}', None), ('{"name": "a", "n": null}', None),
        ('{"n": 1}', "name: missing"), ('{"name": 42}', "name: wrong type"), ('{"name": "a"} x', "trailing text"),
        ('{"name": "a"} {}', "trailing text"), ('{"name": "a", "name": "b"}', "not one JSON object"), ("[]", "not one JSON object"),
        ("", "not one JSON object"),
    ],
)
def test_json_decode(spark, text, payload):
    r = one(spark, decode.try_json(F.lit(text), SCHEMA))
    assert (r["err"] and r["err"]["payload"]) == payload


def test_toml_decode(spark):
    df = spark.createDataFrame([(1, 'name = "a"\nn = 2'), (2, "n = 2"), (3, "name = 1"), (4, "= x"), (5, None)], "id int, text string")
    rows = {r["id"]: r["decoded"] for r in decode.try_toml(df, ["id"], "text", SCHEMA).collect()}
    assert (rows[1]["ok"]["name"], rows[1]["ok"]["n"], rows[2]["err"], rows[3]["err"]) == ("a", 2, "name: missing", "name: wrong type")
    assert rows[4]["err"] and rows[5]["err"]


def test_semver(spark):
    versions = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.10.0", "2"]
    df = spark.createDataFrame([(v,) for v in reversed(versions)], "v string")
    assert [r["v"] for r in df.orderBy(semver.precedence(semver.parse(F.col("v")))).collect()] == versions
    assert one(spark, semver.parse(F.lit("1.x"))) is None
    cases = {
        "^1.2.3": ["1.2.3", "1.2.9", "1.9.0"], "~1.2": ["1.2.0", "1.2.3", "1.2.9"], "=1.2": ["1.2.0", "1.2.3", "1.2.9"],
        ">=1.2, <1.9": ["1.2.0", "1.2.3", "1.2.9"], "^0.2": ["0.2.5"], "<=0.2.5": ["0.2.5"],
        "*": ["0.2.5", "1.2.0", "1.2.3", "1.2.9", "1.9.0", "2.0.0"],
    }
    df = spark.createDataFrame([(v,) for v in cases["*"]], "v string")
    for text, expected in cases.items():
        wanted = semver.parse_requirement(text)
        assert sorted(r["v"] for r in df.where(semver.contains(wanted, semver.parse(F.col("v")))).collect()) == expected, text
    assert semver.parse_requirement(">2, <1") == []
    assert semver.intersect(semver.parse_requirement("^1"), semver.parse_requirement("~1.2")) == semver.parse_requirement("~1.2")


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "node long")
    assert sorted(tuple(r) for r in graph.reach(roots, edges).collect()) == [(1, 0), (2, 1), (3, 2)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 5)], "node long")
    diamond = spark.createDataFrame([(4, 2), (4, 3), (2, 1), (3, 1)], "src long, dst long")
    assert {r["node"]: r["round"] for r in graph.topological_rounds(nodes, diamond).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_rounds(nodes, edges)


def test_trees_and_blobs(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/lib.rs").write_text("fn main() {}\n")
    (tmp_path / "bad").write_bytes(b"\xff\xfe")
    (tmp_path / "Cargo.toml").write_text("[package]\n")
    files = trees.tree(spark, str(tmp_path))
    assert sorted(r["path"] for r in files.collect()) == ["Cargo.toml", "bad", "src/lib.rs"]
    assert [r["path"] for r in trees.glob(files, "src/*.rs").collect()] == ["src/lib.rs"]
    code = lambda p: (trees.read_text(files, p).first()["text"]["err"] or {"code": None})["code"]
    assert [code(p) for p in ("src/lib.rs", "none", "src", "bad")] == [None, "MissingTreeEntry", "TreeEntryNotAFile", "InvalidText"]
    receipt = files.select("path", F.sha2("content", 256).alias("digest")).union(spark.createDataFrame([("absent", None)], "path string, digest string"))
    kept = spark.createDataFrame(receipt.collect(), receipt.schema)
    assert trees.verify(kept, files).first()["holds"] is True
    (tmp_path / "absent").write_text("x")
    assert trees.verify(kept, trees.tree(spark, str(tmp_path))).first()["holds"] is False
    torn = spark.createDataFrame([(b"\x1f\x8b\x08torn",)], "b binary").select(blobs.gunzip("b").alias("r")).first()["r"]
    assert torn["ok"] is None and torn["err"].startswith("MalformedArchive")
    a = spark.createDataFrame([("x", b"1")], "path string, content binary")
    with pytest.raises(Exception, match="DuplicateKey: x"):
        trees.union(a, a.withColumn("content", F.lit(b"2"))).collect()


def test_memo_recomputes_when_content_changes(spark):
    memo, path = Memo(spark, scratch_path(spark, "memo")), scratch_path(spark, "table")
    spark.range(3).write.parquet(path)
    demand = lambda: memo.demand(recipe("count"), [path], lambda: spark.read.parquet(path).agg(F.count("*").alias("n"))).first()["n"]
    assert (demand(), demand(), memo.hits, memo.misses) == (3, 3, 1, 1)
    spark.range(4).write.mode("overwrite").parquet(path)
    assert (demand(), memo.misses) == (4, 2)
    assert recipe_key(recipe("a", x=1, y=2)) == recipe_key(recipe("a", y=2, x=1))


def test_results(spark):
    r = results.result(F.lit(1), (F.lit(True), results.error("Raised", "here", F.lit("p"))))
    with pytest.raises(Exception, match="Raised: p"):
        one(spark, results.strict(r))
    with pytest.raises(Exception, match="no"):
        one(spark, results.require(F.lit(None).cast("boolean"), "no", F.lit(1)))
    with pytest.raises(ValueError):
        results.error("Nonsense", "here")


def test_plans_prune_and_push_down(spark, sf_dir):
    s = KeyedStream(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_id"]).filter(F.col("value") > 40).map(kind=F.col("event_type"))
    plan = s.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,40.0)]" in plan and "props" not in plan
    assert "Python" not in plan and "Exchange" not in plan
