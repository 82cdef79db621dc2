"""Programs over trees, locks, receipts, version sets, streams and searches."""

import gzip
import io
import itertools
import json
import random
import tarfile
import tomllib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.functions import arrays, decode, semver, solver, toolchain
from keyspan.operators import graph, maps
from keyspan.operators.keyed import DuplicateKey, KeyedStream
from keyspan.plans import order
from keyspan.plans.checks import Checks
from keyspan.plans.memo import Memo, recipe, source_digest
from keyspan.sources import blobs, lockfile, process, sinks, trees
from keyspan.sources.store import complete, exists, finished, scope, scratch_path, shared_dir, written
from keyspan.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Order


def test_absence_is_last_everywhere(spark):
    kind = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("xs", T.ArrayType(T.IntegerType()))])
    row = lambda a, *xs: F.struct(F.lit(a).cast("int").alias("a"), F.array(*(F.lit(x).cast("int") for x in xs)).alias("xs"))
    assert one(spark, order.compare(row(None, 1), row(9, 1), kind)) == 1
    assert one(spark, order.compare(row(1, None), row(1, 5), kind)) == 1
    assert one(spark, order.compare(row(1, None), row(1, None), kind)) == 0
    assert one(spark, order.compare(F.lit(None).cast("int"), F.lit(1))) == 1
    xs = F.array(F.lit(2), F.lit(None), F.lit(1), F.lit(2))
    assert one(spark, arrays.in_order(xs)) == [1, 2, 2, None] and one(spark, arrays.to_set(xs)) == [1, 2, None]
    assert one(spark, arrays.sorted_by(xs, lambda x: -x)) == [2, 2, 1, None]
    s = KeyedStream(spark.createDataFrame([(1, None), (2, 5), (3, 4)], "k int, v int"), ["k"])
    assert s.find_min(F.lit(True)).first()["found"]["k"] == 3 and s.find_max(F.lit(True)).first()["found"]["k"] == 1
    assert s.split_min()[0].first()["k"] == 3
    assert s.contains(v=F.lit(None).cast("int")).first()["any"] is True and s.contains(v=F.lit(7)).first()["any"] is False


def test_reversed_spans_fail(spark):
    with pytest.raises(Exception, match="IndexOutOfBounds"):
        one(spark, arrays.span(F.lit(3).cast("long"), F.lit(2).cast("long")))
    assert one(spark, arrays.span(F.lit(2).cast("long"), F.lit(4).cast("long"))) == [2, 3]


def test_fold_stops(spark):
    xs = F.array(*map(F.lit, (3, 0, 5)))
    stepped = arrays.fold_until(xs, F.lit(1), lambda s, x: F.call_function("div", F.lit(6), x).cast("int"), lambda s: s == 2)
    assert one(spark, stepped) == 2  # the division by zero is not reached


@pytest.mark.parametrize("parts,adaptive", [(4, "true"), (16, "true"), (64, "false")])
def test_positions_of_many_wide_rows(spark, parts, adaptive):
    n = 1_000_000
    df = spark.range(n).select(
        (F.col("id") * 7_919 % 1_000_003).alias("k"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit("x" * 40)).alias("text"),
        F.lit(1).alias("a"),
    )
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        out = maps.positions(df, F.col("k").asc(), F.col("text").asc())
        found = out.agg(F.count("*"), F.countDistinct("pos"), F.min("pos"), F.max("pos")).first()
        assert tuple(found) == (n, n, 0, n - 1)
        wrong = out.join(out.select((F.col("pos") - 1).alias("pos"), F.col("k").alias("after")), "pos").where("after <= k")
        assert wrong.isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_range_join_against_all_pairs(spark):
    draw = random.Random(3)
    points = [(i, draw.choice([None, draw.uniform(-50, 50), float(draw.randint(-9, 9))])) for i in range(200)]
    ranges = [(i, a, a + draw.choice([0, 1, 7.5, 60, -3])) for i in range(40) for a in [float(draw.randint(-60, 50))]] + [(99, None, 5.0)]
    out = maps.range_join(spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(ranges, "r int, lo double, hi double"), "x", "lo", "hi", 4.0)
    expected = sorted((p, r) for p, x in points for r, a, b in ranges if x is not None and a is not None and a <= x < b)
    assert sorted((r["p"], r["r"]) for r in out.collect()) == expected


# Decode


SCHEMA = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("n", T.LongType(), True)])


@pytest.mark.parametrize(
    "text,payload",
    [
        ('{"name":"a"},{}', "trailing text"), ('{"name":"a"}\n', None), ('\t {"name":"a"} \r\n', None),
        ('{"name":"a"}],[2', "trailing text"), ('{"name":"a"},"y":{}', "trailing text"), ('{"name":"a"}}', "trailing text"),
        ("[]", "not one JSON object"), ("", "not one JSON object"), (None, "not one JSON object"),
        ('{"name":"a","name":"b"}', "not one JSON object"),
    ],
)
def test_json_ends_where_the_document_does(spark, text, payload):
    r = one(spark, decode.try_json(F.lit(text).cast("string"), SCHEMA))
    assert (r["err"] and r["err"]["payload"]) == payload


def test_nested_json_in_catalyst(spark):
    inner = T.StructType([T.StructField("k", T.LongType(), False)])
    schema = T.StructType([T.StructField("xs", T.ArrayType(inner), False), T.StructField("o", inner, True)])
    cases = {
        '{"xs": [{"k": 1}, {"k": 2}]}': None, '{"xs": [{"k": "1"}]}': "xs: wrong element", '{"xs": [null]}': "xs: wrong element",
        '{"xs": {}}': "xs: wrong type", '{"xs": [], "o": {}}': "o.k: missing", '{"xs": [], "o": null}': None, '{"o": null}': "xs: missing",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", decode.try_json(F.col("t"), schema).alias("r")).collect()
    assert {r["t"]: r["r"]["err"] and r["r"]["err"]["payload"] for r in rows} == cases
    assert [x["k"] for x in rows[0]["r"]["ok"]["xs"]] == [1, 2]


DEP = decode.Choice("Dep", {"Short": "String", "Long": decode.Record("Long", {"version": "String", "features": decode.Option(decode.Sequence("String"))})})
DOC = decode.Record("Doc", {"name": "String", "deps": decode.Sequence(DEP), "n": decode.Option("Int")})


@pytest.mark.parametrize(
    "text,kind,path,place",
    [
        ('{"name": "a", "deps": ["1", {"version": "2", "x": 1}], "n": null}', None, None, None),
        ('{"name": "é", "deps": [1]}', "expected-scalar", "deps", 24),
        ('{"name": "a", "deps": [{}]}', "missing-field", "deps", 23),
        ('{"name": "a", "deps": [], "name": "b"}', "duplicate-field", "name", 34),
        ('{"name": "a", "deps": [], "n": 9223372036854775808}', "int-out-of-range", "n", 31),
        ('{"name": "a", "deps": [], "n": 1.0}', "expected-scalar", "n", 31),
        ('{"name": "a", "deps": [], "n": true}', "expected-scalar", "n", 31),
        ('{"name": "a", "deps": {}}', "expected-array", "deps", 22),
        ('{"name": "a", "deps": [[]]}', "expected-string-or-object", "deps", 23),
        ('{"name": "a", "deps": []} x', "trailing-content", "", 26),
        ('{"name": "a", "deps": [}', "parse-error", "", 23),
        ("[1]", "expected-object", "", 0),
        ("[" * 100_000, "parse-error", "", None),
        (None, "parse-error", "", None),
    ],
)
def test_decode_says_what_is_wrong_where(spark, text, kind, path, place):
    r = decode.decode_rows(spark.createDataFrame([(1, text)], "id int, text string"), ["id"], "text", DOC).first()["decoded"]
    if kind is None:
        assert r["err"] is None and [d["tag"] for d in r["ok"]["deps"]] == [0, 1] and r["ok"]["deps"][1]["Long"]["version"] == "2"
        return
    assert (r["ok"], r["err"]["kind"], r["err"]["path"]) == (None, kind, path)
    assert r["err"]["document_len"] == len((text or "").encode())
    assert place is None or r["err"]["document_offset"] == place


def test_choices_have_one_form(spark):
    for variants, kind in (({"A": "String", "B": "String"}, "ambiguous-string-form"), ({"A": None}, "no-string-form")):
        with pytest.raises(decode.Fault) as e:
            decode.decoded(decode.Choice("C", variants), "x")
        assert e.value.kind == kind
    with pytest.raises(decode.Fault) as e:
        decode.decoded(decode.Choice("C", {"A": "String"}), {})
    assert e.value.kind == "no-table-form"


# Locks


def _lock(packages):
    out = ["version = 4"]
    for name, version, deps in packages:
        out.append(f'[[package]]\nname = "{name}"\nversion = "{version}"\ndependencies = {json.dumps(deps)}')
    return "\n\n".join(out)


def test_build_orders(spark):
    locks = {
        1: [("app", "1", ["left", "right"]), ("left", "1", ["base"]), ("right", "1", ["base"]), ("base", "1", [])],
        2: [("app", "1", ["dup 1", "dup 2"]), ("dup", "1", []), ("dup", "2", ["dup 1"])],
        3: [("a", "1", ["b"]), ("b", "1", ["a"]), ("c", "1", []), ("d", "1", ["a"])],
        4: [],
    }
    texts = {k: _lock(v) if v else "version = 4\npackage = []" for k, v in locks.items()}
    rows = lockfile.packages(lockfile.read_locks(spark.createDataFrame(list(texts.items()), "lock int, text string"), "lock", "text"), "lock")
    found = {(r["lock"], r["name"], r["version"]): r["round"] for r in lockfile.build_order(rows, "lock").collect()}
    assert found == {
        (1, "base", "1"): 0, (1, "left", "1"): 1, (1, "right", "1"): 1, (1, "app", "1"): 2, (2, "dup", "1"): 0, (2, "dup", "2"): 1, (2, "app", "1"): 2, (3, "c", "1"): 0,
    }
    assert all(len(tomllib.loads(texts[k])["package"]) == len(v) for k, v in locks.items())


@pytest.mark.parametrize(
    "packages,matches",
    [([("a", "1", ["none"])], 0), ([("a", "1", ["b"]), ("b", "1", []), ("b", "2", [])], 2), ([("a", "1", ["b 3"]), ("b", "1", [])], 0)],
)
def test_unresolvable_dependencies(spark, packages, matches):
    rows = lockfile.packages(lockfile.read_locks(spark.createDataFrame([(1, _lock(packages))], "lock int, text string"), "lock", "text"), "lock")
    with pytest.raises(lockfile.UnresolvableDependency, match=f"{matches} matches"):
        lockfile.build_order(rows, "lock")


def test_broken_locks_are_errors(spark):
    df = spark.createDataFrame([(1, "[[package]]\nname = 1"), (2, "= x"), (3, None)], "lock int, text string")
    assert {r["lock"]: r["decoded"]["err"]["kind"] for r in lockfile.read_locks(df, "lock", "text").collect()} == {1: "expected-scalar", 2: "parse-error", 3: "parse-error"}


# Versions


VERSIONS = ["0.0.0", "0.0.1", "0.2.5", "0.3.0", "1.0.0-alpha", "1.0.0-rc.1", "1.0.0", "1.2.0", "1.2.9", "1.3.0-beta", "1.3.0", "2.0.0-rc", "2.0.0", "2.1"]
REQUIREMENTS = [
    "*", "<=1.2", ">1.2", "<1.2", ">=1.2", "^0", "^0.0", "^0.2", "^1", "1", "=1.2", "=1", "~1", "~1.2", "^1.0.0-rc.1",
    ">=1.0.0-alpha, <2.0.0-rc", "=1.0.0-alpha", "<=1.0.0-rc.1",
]


def test_requirements_read_missing_numbers_as_zero(spark):
    df = spark.createDataFrame([(v,) for v in VERSIONS], "v string")
    held = lambda text: [r["v"] for r in df.where(semver.contains(semver.parse_requirement(text), semver.parse(F.col("v")))).collect()]
    assert held("<=1.2") == ["0.0.0", "0.0.1", "0.2.5", "0.3.0", "1.0.0", "1.2.0"] and held(">1.2") == ["1.2.9", "1.3.0", "2.0.0", "2.1"]
    assert held("^0") == held("^0.0") == ["0.0.0"] and held("^1.0.0-rc.1") == ["1.0.0-rc.1", "1.0.0", "1.2.0", "1.2.9", "1.3.0"]
    assert held("*") == [v for v in VERSIONS if "-" not in v]


def test_version_set_columns_do_as_lists_do(spark):
    rows = list(itertools.product(VERSIONS, REQUIREMENTS, REQUIREMENTS[::4]))
    df = spark.createDataFrame(rows, "v string, a string, b string")
    df = semver.requirement_sets(semver.requirement_sets(df, "a", "x"), "b", "y").withColumn("p", semver.parse(F.col("v")))
    out = df.select(
        "v", "a", "b", semver.set_contains(F.col("x"), F.col("p")).alias("one"),
        semver.set_contains(semver.set_meet(F.col("x"), F.col("y")), F.col("p")).alias("both"),
    ).collect()
    read = semver.parse_requirement
    for r in out:
        assert r["one"] == solver.admits(read(r["a"]), solver.bound(r["v"])), r
        assert r["both"] == solver.admits(semver.intersect(read(r["a"]), read(r["b"])), solver.bound(r["v"])), r
    odd = semver.requirement_sets(spark.createDataFrame([("x",), (None,)], "t string"), "t")
    assert [r["sets"] for r in odd.collect()] == [None, None]
    assert odd.where(semver.set_contains(F.col("sets"), semver.parse(F.lit("1.0.0")))).isEmpty()


def test_tool_ranges():
    at = toolchain.ToolVersion.parse
    assert at("15.2") == at("15.2.0") and at("1.99-nightly+abc").tag == "nightly" and at("x") is at("1-") is at("") is None
    held = lambda text, v: toolchain.ToolRange.parse(text).matches(at(v))
    assert held(">=1.2, <2", "1.10.3.4") and not held(">=1.2, <2", "2.0") and held("=15.2", "15.2.0.0") and held(">1", "1.0.1") and held("<=2", "2.0")
    assert not held(">=1", "2.0-nightly") and held(">=2.0-beta", "2.0-nightly") and not held(">=2.0-nightly", "2.0-beta")
    for text, kind in (("", "Empty"), (" , ", "Empty"), ("1.2", "MissingComparison"), ("^1", "MissingComparison"), (">=x", "UnorderableBound")):
        with pytest.raises(toolchain.RangeError) as e:
            toolchain.ToolRange.parse(text)
        assert e.value.kind == kind


def test_solver_against_all_selections():
    draw, read = random.Random(4), semver.parse_requirement
    solved = 0
    for _ in range(150):
        names = ["a", "b", "c", "d"]
        index = {n: {f"{v}.{draw.randint(0, 2)}.0": {m: draw.choice(["*", "^1", "^2", ">=1.1", "<2", "=1.0.0"]) for m in names[i + 1 :] if draw.random() < 0.7} for v in (1, 2, 3)} for i, n in enumerate(names)}
        wanted = {"a": "*"}

        def good(choice):
            needs = [(m, text) for n, v in choice.items() for m, text in index[n][v].items()]
            return all(m in choice and solver.admits(read(text), solver.bound(choice[m])) for m, text in needs)

        exists_one = any(
            good(dict(zip(some, vs))) for k in range(1, 5) for some in itertools.combinations(names, k)
            if "a" in some for vs in itertools.product(*(index[n] for n in some))
        )
        try:
            found = solver.solve(index, wanted)
            assert good(found)
            solved += 1
        except solver.Unsolvable:
            assert not exists_one
    assert 20 < solved < 150
    with pytest.raises(solver.Unsolvable) as e:
        solver.solve({"a": {"1.0.0": {}}}, {"a": "^2"})
    assert e.value.reason.package == "a"


# Trees, blobs, receipts


def test_trees_keep_equal_folder_names_apart(spark, tmp_path):
    root = tmp_path / "src"
    (root / "a/src").mkdir(parents=True)
    (root / "lib.rs").write_text("1")
    (root / "a/src/lib.rs").write_text("2")
    (root / "with space%20.txt").write_text("3")
    for spelled in (str(root), f"file://{root}", f"{root}/"):
        assert sorted(r["path"] for r in trees.tree(spark, spelled).collect()) == ["a/src/lib.rs", "lib.rs", "with space%20.txt"]


ENTRY = "path string, kind string, content binary, executable boolean, target string"


def _entries(spark, *rows):
    return spark.createDataFrame([(p, k, c, False, t) for p, k, c, t in rows], ENTRY)


def test_tree_values(spark):
    a = _entries(spark, ("d/x", "file", b"1", None), ("d/empty", "dir", None, None), ("link", "symlink", None, "d/x"))
    assert [(r["path"], r["kind"]) for r in trees.walk(a).collect()] == [("d", "dir"), ("d/empty", "dir"), ("d/x", "file"), ("link", "symlink")]
    b = _entries(spark, ("d/x", "file", b"1", None), ("d/y", "file", b"2", None))
    assert trees.union(a, b).count() == 4
    with pytest.raises(DuplicateKey, match="d/x \\(Duplicate\\)"):
        trees.disjoint_union(a, b)
    for other, conflict in (
        (("d/x", "file", b"2", None), "Disagreement"), (("link", "symlink", None, "d"), "Disagreement"),
        (("link/below", "file", b"", None), "NotADirectory"), (("d", "file", b"", None), "NotADirectory"),
    ):
        with pytest.raises(DuplicateKey, match=conflict):
            trees.union(a, _entries(spark, other))
    assert trees.insert_path(a, _entries(spark, ("new/deep/z", "file", b"", None))).count() == 4
    for bad in ("a//b", "../x", "", "."):
        with pytest.raises(ValueError):
            trees.insert_path(a, _entries(spark, (bad, "file", b"", None)))
    assert trees.insert_path(a, _entries(spark, ("d/empty", "dir", None, None))).count() == 3
    assert [r["path"] for r in trees.walk(trees.project(a, "d")).collect()] == ["empty", "x"]
    assert trees.walk(a.where("false")).isEmpty()


def test_archives_keep_links(spark):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as out:
        for name, kind, target in (("a", tarfile.REGTYPE, None), ("hard", tarfile.LNKTYPE, "a"), ("soft", tarfile.SYMTYPE, "a"), ("dir", tarfile.DIRTYPE, None)):
            info = tarfile.TarInfo(name)
            info.type, info.linkname = kind, target or ""
            info.size = 3 if kind == tarfile.REGTYPE else 0
            out.addfile(info, io.BytesIO(b"xyz") if info.size else None)
    rows = spark.createDataFrame([(gzip.compress(raw.getvalue()),)], "b binary").select(blobs.gunzip("b")["ok"].alias("tar"))
    found = {r["path"]: (r["kind"], r["content"] and bytes(r["content"]), r["target"]) for r in rows.lateralJoin(blobs.Untar(F.col("tar").outer())).collect()}
    assert found == {"a": ("file", b"xyz", None), "hard": ("file", b"xyz", None), "soft": ("symlink", None, "a"), "dir": ("dir", None, None)}


def test_fetch_after_a_torn_write_and_with_origins(spark, tmp_path):
    import hashlib
    import os
    import uuid

    body = uuid.uuid4().bytes  # content that no earlier run has kept
    (tmp_path / "good").write_bytes(body)
    (tmp_path / "bad").write_bytes(b"other")
    pin = hashlib.sha256(body).hexdigest()
    kept = f"{shared_dir(spark)}/content/{pin}"
    os.makedirs(kept.removeprefix("file://"))  # a write that was torn
    assert exists(spark, kept) and not complete(spark, kept)
    rows = [("x", [f"{tmp_path}/none", f"{tmp_path}/bad", f"{tmp_path}/good"], pin), ("y", [f"{tmp_path}/bad"], "0" * 64)]
    pins = spark.createDataFrame(rows, "name string, url array<string>, sha256 string")
    found = {r["name"]: (r["content"] and bytes(r["content"]), r["err"]) for r in blobs.fetch(spark, pins).collect()}
    assert found == {"x": (body, None), "y": (None, "FetchIntegrity")} and complete(spark, kept)


def test_digests_see_swapped_contents(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x").write_text(name)
    before = source_digest(spark, str(tmp_path))
    (tmp_path / "a/x").write_text("b")
    (tmp_path / "b/x").write_text("a")
    assert source_digest(spark, str(tmp_path)) not in (before, None) and source_digest(spark, f"{tmp_path}/none") is None


def test_receipts_of_trees(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x").write_text("1")
    files = trees.tree(spark, str(tmp_path))
    reads = spark.createDataFrame([("d/x", "content"), ("d", "listing"), ("", "listing"), ("none", "content"), ("gone", "listing")], "path string, kind string")
    receipt = trees.observed(files, reads)
    receipt = spark.createDataFrame(receipt.collect(), receipt.schema)
    assert trees.verify(receipt, trees.tree(spark, str(tmp_path))).first()["holds"] is True
    (tmp_path / "d/y").write_text("new")
    assert trees.verify(receipt, trees.tree(spark, str(tmp_path))).first()["holds"] is False
    assert trees.verify(receipt.where("kind = 'content'"), trees.tree(spark, str(tmp_path))).first()["holds"] is True


def test_memo_receipts(spark, tmp_path):
    memo, paths = Memo(spark, scratch_path(spark, "memo")), [f"{tmp_path}/a", f"{tmp_path}/b"]
    spark.range(2).write.parquet(paths[0])
    calls = []

    def compute(reads):
        calls.append(1)
        return reads.parquet(paths[1] if reads.exists(paths[1]) else paths[0])

    demand = lambda: memo.demand(recipe("first of", paths=paths), [], compute).count()
    assert (demand(), demand(), len(calls)) == (2, 2, 1)
    spark.range(5).write.parquet(paths[1])  # what was absent appears
    assert (demand(), demand(), len(calls)) == (5, 5, 2)
    spark.range(3).write.mode("overwrite").parquet(paths[0])  # not read any more
    assert (demand(), len(calls)) == (5, 2)


# Streams


def test_upserts_over_batches(spark, tmp_path):
    schema = "k int, at int, v string"
    source, target, progress = (f"{tmp_path}/{x}" for x in ("in", "out", "progress"))
    expected, draw = {}, random.Random(5)
    for batch in range(12):  # with merges in between
        rows = [(draw.randint(0, 9), draw.randint(0, 50), f"{batch}") for _ in range(6)]
        for k, at, v in rows:
            expected[k] = max(expected.get(k, (-1, "")), (at, v))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{batch}")
        incremental.upsert_new_files(spark, f"{source}/*", schema, ["k"], ["at"], target, progress)
        found = incremental.current(spark, target, schema, ["k"], ["at"])
        assert {r["k"]: (r["at"], r["v"]) for r in found.collect()} == expected
    assert incremental.current(spark, f"{tmp_path}/none", schema, ["k"], ["at"]) is None


def test_older_rows_of_a_later_batch_do_not_win(spark, tmp_path):
    schema, (source, target, progress) = "k int, at int, v string", (f"{tmp_path}/{x}" for x in ("in", "out", "progress"))
    for name, row in (("a", (1, 9, "new")), ("b", (1, 2, "old"))):
        spark.createDataFrame([row], schema).write.parquet(f"{source}/{name}")
        incremental.upsert_new_files(spark, f"{source}/*", schema, ["k"], ["at"], target, progress)
    assert incremental.current(spark, target, schema, ["k"], ["at"]).first()["v"] == "new"


# Graphs, sinks, checks, store


def test_deep_graphs_keep_short_plans(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(30, 0), (None, 1), (2, None)], "src long, dst long")
    out = graph.reach(spark.createDataFrame([(0,), (None,)], "node long"), edges)
    assert {r["node"]: r["depth"] for r in out.collect()} == {k: k for k in range(31)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 9
    short = graph.topological_rounds(spark.range(4).select(F.col("id").alias("node")), spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "src long, dst long"), cycles="short")
    assert [tuple(r) for r in short.collect()] == [(3, 0)]


def test_snapshots_and_journals(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\"\n", [1, None], {"k": 1}), (1, None, [], {}), (2, "b\"\n", [1, None], {"k": 1})], "a int, s string, xs array<int>, m map<string,int>")
    lines = [r["line"] for r in sinks.canonical_text(df).collect()]
    assert [json.loads(x)["a"] for x in lines] == [1, 2, 2] and json.loads(lines[1]) == {"a": 2, "s": "b\"\n", "xs": [1, None], "m": [["k", 1]]}
    path = f"{tmp_path}/snapshot"
    assert sinks.matches_snapshot(df, path) and sinks.matches_snapshot(df.repartition(3), path) and not sinks.matches_snapshot(df.limit(2), path)
    assert sinks.digest(df) == sinks.digest(df.repartition(5)) != sinks.digest(df.limit(2))
    journal = f"{tmp_path}/journal"
    for k in range(2):
        sinks.append_journal(spark, journal, f"r{k}", [{"kind": "content", "path": "p", "digest": None}], "d")
    assert sorted(r["recipe"] for r in sinks.read_journal(spark, journal).collect()) == ["r0", "r1"]


def test_checks_name_what_failed(spark):
    checks = Checks(spark)
    assert not checks.expect_none("n", F.lit(1)) and not checks.expect_some("s", F.lit(None)) and not checks.expect("e", F.lit(None).cast("boolean"))
    assert not checks.expect_fail("f", "MissingKey", lambda: F.lit(1)) and checks.expect_fail("r", "boom", lambda: F.raise_error(F.lit("boom")))
    joined = spark.range(9).join(spark.range(9).groupBy("id").count(), "id")
    assert checks.no_python("p", joined) and not checks.exchanges_at_most("x", spark.range(9).groupBy(F.col("id") % 3).count(), 0)
    assert [site for site, _ in checks.failures()] == ["n", "s", "e", "f", "x"]


def test_scratch_goes_with_its_scope(spark):
    with scope(spark):
        path = scratch_path(spark, "inner")
        spark.range(2).write.parquet(path)
        assert exists(spark, path)
    assert not exists(spark, path)
    inner = []

    def make():
        df = written(spark.range(5), "inner")
        inner.append(df.inputFiles()[0].rsplit("/", 1)[0])
        return df

    assert finished(spark, "outer", make).count() == 5 and not exists(spark, inner[0])


def test_programs_run_only_where_allowed(spark):
    rows = [
        (1, ["/bin/cat"], "in"), (2, ["/bin/sh", "-c", "echo x >&2; exit 3"], None), (3, ["/no/such"], ""), (4, None, None),
        (5, ["/bin/sleep", "9"], ""), (6, ["/usr/bin/env"], ""),
    ]
    df = spark.createDataFrame(rows, "k int, argv array<string>, body string")
    with pytest.raises(PermissionError):
        process.run_rows(df, ["k"], "argv")
    found = {r["k"]: r["outcome"] for r in process.run_rows(df, ["k"], "argv", "body", {"A": "b"}, 1.0, allow=True).collect()}
    assert bytes(found[1]["ok"]["stdout"]) == b"in" and bytes(found[6]["ok"]["stdout"]) == b"A=b\n"
    assert (found[2]["err"]["exit"], found[2]["err"]["stderr"]) == (3, "x\n")
    assert all(found[k]["err"]["code"] == "ProcessFailure" and found[k]["err"]["exit"] is None for k in (3, 4, 5))


class _Session:
    """As much of a session as the store looks at where no folder is set."""

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"test-{master}"})()
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})()


def test_machine_local_folders_are_for_local_masters():
    assert shared_dir(_Session("local[2]")) == shared_dir(_Session("local[2]")) != ""
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_Session("spark://host:7077"))
