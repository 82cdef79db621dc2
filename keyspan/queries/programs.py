"""Nested decode, lockfiles, receipts, tree values, test selection, snapshots and the solver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.functions import arrays, decode, solver
from keyspan.operators import graph
from keyspan.plans.checks import Checks
from keyspan.plans.memo import Memo, recipe
from keyspan.queries.registry import Tables, query
from keyspan.sources import blobs, lockfile, manifest, process, sinks, trees
from keyspan.sources.store import scratch_path

#: The short and the long form of a dependency.
DEPENDENCY = decode.Choice(
    "Dependency",
    {
        "Short": "String",
        "Detailed": decode.Record(
            "Detailed", {"version": "String", "optional": decode.Option("Bool"), "tags": decode.Option(decode.Sequence("Int"))},
        ),
    },
)

_TEXT = """CASE event_id % 6 WHEN 0 THEN '"1.' || user_id || '"' WHEN 1 THEN '{"version": "' || user_id || '", "optional": true, "extra": {}}' WHEN 2 THEN '{"version": "x", "tags": [' || user_id || ', 2]}'
 WHEN 3 THEN '[1]' WHEN 4 THEN '{"optional": false}' ELSE '{"version": "x", "tags": [1, "' || user_id || '"]}' END"""


@query(
    f"""SELECT event_id, CASE WHEN k < 3 THEN CASE WHEN k = 0 THEN 0 ELSE 1 END END AS tag, CASE k WHEN 0 THEN '1.' || user_id WHEN 1 THEN '' || user_id WHEN 2 THEN 'x' END AS version,
 k = 1 AS optional, CASE WHEN k = 2 THEN user_id + 2 END AS tags, CASE k WHEN 3 THEN 'expected-string-or-object' WHEN 4 THEN 'missing-field' WHEN 5 THEN 'expected-scalar' END AS kind,
 CASE WHEN k > 2 THEN CASE k WHEN 5 THEN 'tags' ELSE '' END END AS path, CASE WHEN k > 2 THEN CAST(CASE k WHEN 5 THEN 29 ELSE 0 END AS BIGINT) END AS at, CASE WHEN k > 2 THEN strlen(text) END AS length
 FROM (SELECT event_id, user_id, event_id % 6 AS k, {_TEXT} AS text FROM events)"""
)
def enum_decode(t: Tables) -> DataFrame:
    """A tagged union by its string and its table form, and what is wrong where."""
    rows = t.events.select("event_id", F.expr(_TEXT.replace("|| user_id ||", "|| string(user_id) ||")).alias("text"))
    out = decode.decode_rows(rows, ["event_id"], "text", DEPENDENCY)
    ok, err = F.col("decoded.ok"), F.col("decoded.err")
    return out.select(
        "event_id", ok["tag"].cast("int").alias("tag"), F.coalesce(
            ok["Short"]["text"], ok["Detailed"]["version"],
        ).alias("version"), F.coalesce(ok["Detailed"]["optional"], F.lit(False)).alias("optional"),
        F.aggregate(ok["Detailed"]["tags"], F.lit(0).cast("long"), lambda a, x: a + x).alias(
            "tags"
        ), err["kind"].alias("kind"), err["path"].alias("path"), err["document_offset"].alias("at"), err["document_len"].alias("length"),
    )


_ORDER = T.StructType(
    [
        T.StructField("who", T.StructType([T.StructField("key", T.LongType(), False), T.StructField("tag", T.StringType())]), False),
        T.StructField("xs", T.ArrayType(T.LongType()), False),
    ]
)


@query(
    "SELECT o_orderkey, CASE WHEN k IN (0, 1) THEN o_custkey END AS custkey, CASE WHEN k = 0 THEN o_orderstatus END AS tag, CASE WHEN k IN (0, 1) THEN o_custkey + 1 END AS total,"
    " CASE k WHEN 2 THEN 'who.key: missing' WHEN 3 THEN 'xs: wrong element' WHEN 4 THEN 'trailing text' END AS failure FROM (SELECT *, o_orderkey % 5 AS k FROM orders)"
)
def json_decode_nested(t: Tables) -> DataFrame:
    """Records in records and arrays, without leaving Catalyst; white space around a document is none of it."""
    k, key = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    who = F.when(
        k == 0, F.concat(F.lit('{"key": '), key, F.lit(', "tag": "'), F.col("o_orderstatus"), F.lit('"}')),
    ).when(k == 2, F.lit('{"tag": "x"}')).otherwise(F.concat(F.lit('{"key": '), key, F.lit("}")))
    xs = F.when(k == 3, F.lit('[1, "2"]')).otherwise(F.concat(F.lit("["), key, F.lit(", 1]")))
    text = F.concat(F.lit(' {"who": '), who, F.lit(', "xs": '), xs, F.lit("}"), F.when(k == 4, F.lit(",{}")).otherwise(F.lit("\n")))
    r = t.orders.select("o_orderkey", decode.try_json(text, _ORDER).alias("r"))
    total = F.aggregate(F.col("r.ok.xs"), F.lit(0).cast("long"), lambda a, x: a + x)
    return r.select("o_orderkey", F.col("r.ok.who.key").alias("custkey"), F.col("r.ok.who.tag").alias("tag"), total.alias("total"), F.col("r.err.payload").alias("failure"))


def _locks(t: Tables) -> DataFrame:
    """A lock for each region: two versions of a shared package, and its nations in a chain that all need one of them."""
    shared = '[[package]]\nname = "shared"\nversion = "1.0.0"\n\n[[package]]\nname = "shared"\nversion = "2.0.0"\nsource = "registry"\nchecksum = "ab"\n\n'
    before = F.lag("n_name").over(_by_region())
    needs = F.concat(F.lit('dependencies = ["shared 2.0.0"'), F.when(before.isNull(), "").otherwise(F.concat(F.lit(', "'), before, F.lit('"'))), F.lit("]\n"))
    one = F.concat(F.lit('[[package]]\nname = "'), F.col("n_name"), F.lit('"\nversion = "0.'), F.col("n_nationkey").cast("string"), F.lit('.0"\n'), needs)
    rows = t.nation.select("n_regionkey", "n_nationkey", one.alias("one"))
    # A region's nations: five.
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "one"))), lambda s: s["one"]), "\n")
    return rows.groupBy("n_regionkey").agg(F.concat(F.lit("version = 4\n\n" + shared), body).alias("text"))


def _by_region():
    from pyspark.sql import Window as W

    return W.partitionBy("n_regionkey").orderBy("n_nationkey")


_SHARED = "SELECT DISTINCT n_regionkey, 'shared' AS name, v AS version FROM nation, (VALUES ('1.0.0'), ('2.0.0')) AS s(v)"


@query(
    "SELECT n_regionkey, n_name AS name, '0.' || n_nationkey || '.0' AS version, false AS vendored, NULL AS pin, CAST(CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 THEN 1 ELSE 2 END AS INTEGER) AS needs FROM nation"
    f" UNION ALL SELECT n_regionkey, name, version, version = '2.0.0', CASE WHEN version = '2.0.0' THEN 'sha256:ab' END, 0 FROM ({_SHARED})"
)
def lock_decode(t: Tables) -> DataFrame:
    locks = lockfile.read_locks(_locks(t), "n_regionkey", "text")
    return lockfile.packages(locks, "n_regionkey").select("n_regionkey", "name", "version", "vendored", "pin", F.size("dependencies").alias("needs"))


@query(
    "SELECT n_regionkey, n_name AS name, '0.' || n_nationkey || '.0' AS version, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS round FROM nation"
    f" UNION ALL SELECT n_regionkey, name, version, 0 FROM ({_SHARED})"
)
def lock_build_order(t: Tables) -> DataFrame:
    """Names resolved within each lock, then rounds."""
    locks = lockfile.read_locks(_locks(t), "n_regionkey", "text")
    return lockfile.build_order(lockfile.packages(locks, "n_regionkey"), "n_regionkey")


@query(
    "SELECT * FROM (VALUES (1, 'first', 0, 1), (2, 'same', 1, 1), (3, 'new name in the folder', 1, 2), (4, 'absent file appears', 1, 3), (5, "
    "'other file', 2, 3)) AS v(step, what, hits, misses)"
)
def memo_receipt(t: Tables) -> DataFrame:
    """Hits and misses as a folder's listing, an absent file and a file that nobody read change."""
    root = scratch_path(t.spark, "world")
    memo, steps = Memo(t.spark, scratch_path(t.spark, "memo")), []
    write = lambda name: t.region.select("r_name").coalesce(1).write.parquet(f"{root}/{name}")
    write("folder/a")
    write("other/x")

    def compute(reads) -> DataFrame:
        names, there = reads.listing(f"{root}/folder"), reads.exists(f"{root}/extra")
        return t.spark.createDataFrame([(len(names), there)], "names int, there boolean")

    def demand(what: str) -> None:
        memo.demand(recipe("listed", folder="folder"), [], compute)
        steps.append((len(steps) + 1, what, memo.hits, memo.misses))

    demand("first")
    demand("same")
    write("folder/b")
    demand("new name in the folder")
    write("extra")
    demand("absent file appears")
    write("other/y")
    demand("other file")
    return t.spark.createDataFrame(steps, "step int, what string, hits int, misses int")


@query(
    "SELECT 'r' || n_regionkey || '/n' || n_nationkey AS path, 'file' AS kind FROM nation UNION ALL SELECT DISTINCT 'r' || n_regionkey, 'dir' FROM "
    "nation UNION ALL SELECT 'r0/empty', 'dir'"
)
def tree_walk(t: Tables) -> DataFrame:
    """Files, folders that they imply, and an empty one put in by its path."""
    name = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"))
    none = F.lit(None).cast("string").alias("target")
    files = t.nation.select(name.alias("path"), F.lit("file").alias("kind"), F.col("n_name").cast("binary").alias("content"), F.lit(False).alias("executable"), none)
    empty = t.spark.range(1).select(
        F.lit("r0/empty").alias("path"), F.lit("dir").alias("kind"), F.lit(None).cast("binary").alias("content"),
        F.lit(False).alias("executable"), none,
    )
    return trees.walk(trees.insert_path(files, empty)).select("path", "kind")


@query(
    "SELECT 'n' || n_nationkey AS path, CASE WHEN n_nationkey % 3 = 1 THEN 'Disagreement' WHEN n_nationkey % 3 = 0 THEN 'Duplicate' ELSE "
    "'NotADirectory' END AS conflict FROM nation"
)
def tree_conflicts(t: Tables) -> DataFrame:
    """Why two trees are not a disjoint union: equal leaves, unequal ones, a file where the other has a folder."""
    key = F.col("n_nationkey").cast("string")
    a = t.nation.select(F.concat(F.lit("n"), key).alias("path"), F.lit("file").alias("kind"), F.lit("x").alias("content"))
    third = F.col("n_nationkey") % 3
    b = t.nation.select(
        F.concat(F.lit("n"), key, F.when(third == 2, "/below").otherwise("")).alias("path"), F.lit("file").alias("kind"),
        F.when(third == 1, "y").otherwise("x").alias("content"),
    )
    return trees.conflicts(a, b, disjoint=True)


@query("SELECT 'n' || n_nationkey AS path FROM nation WHERE n_regionkey = 1")
def tree_project(t: Tables) -> DataFrame:
    path = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"))
    return trees.project(t.nation.select(path.alias("path")), "r1")


@query(
    "SELECT n_name AS name, CASE WHEN n_regionkey < 3 THEN 'https://x/' || n_name END AS url, CASE WHEN n_regionkey >= 3 THEN "
    "'MissingRegistryArtifact' END AS failure FROM nation"
)
def registry_url(t: Tables) -> DataFrame:
    manifest = t.nation.where("n_regionkey < 3").select(
        F.col("n_name").alias("name"), F.concat(F.lit("https://x/"), "n_name").alias("url"), F.sha2("n_name", 256).alias("sha256"),
    )
    pins = blobs.pinned_url(manifest, t.nation.select(F.col("n_name").alias("name")))
    return pins.select("name", F.col("pin.ok.url").alias("url"), F.col("pin.err.code").alias("failure"))


@query("SELECT n_nationkey, substr(n_name, 3, 4) AS part FROM nation")
def blob_slice(t: Tables) -> DataFrame:
    """Bytes 2 to 5; fewer where the blob ends."""
    return t.nation.select("n_nationkey", blobs.slice_of(F.col("n_name").cast("binary"), 2, 4).cast("string").alias("part"))


@query(
    "SELECT * FROM (VALUES ('cut off', 'NotReached', ''), ('no such test', 'UnknownRun', ''), ('same', 'NotReached', ''), ('touched', 'Reached', "
    "'h3,h3x'), ('unfollowed', 'UnknownRun', '')) AS v(test, verdict, changed)"
)
def test_selection(t: Tables) -> DataFrame:
    """Which tests a change of one atom's bytes reaches."""
    atoms = "node int, hash string, unknown string"
    before = t.spark.createDataFrame([(k, f"h{k}", "indirect call" if k == 9 else None) for k in range(10)], atoms)
    after = before.withColumn("hash", F.when(F.col("node").isin(3, 7), F.concat("hash", F.lit("x"))).otherwise(F.col("hash")))
    edges = t.spark.createDataFrame([(0, 1), (1, 0), (2, 3), (3, 2), (4, 9), (7, 5), (5, 6)], "src int, dst int")
    out = None
    for name, root in (("same", 0), ("touched", 2), ("unfollowed", 4), ("no such test", 99), ("cut off", 5)):
        one = graph.select_test((before, edges), (after, edges), root).select(F.lit(name).alias("test"), "verdict", F.array_join("changed", ",").alias("changed"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","region":{"key":' || n_regionkey || ',"none":null},"xs":[' || n_nationkey || ',null]}' AS line FROM nation""")
def sink_canonical(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = t.nation.select(
        "n_nationkey", "n_name", F.struct(F.col("n_regionkey").alias("key"), none.alias("none")).alias("region"),
        F.array(F.col("n_nationkey"), F.lit(None).cast("int")).alias("xs"),
    )
    return sinks.canonical_text(rows)


_SIZES = "SELECT DISTINCT p_size % 10 AS k FROM part"


@query(
    f"SELECT 'a' AS package, '1.' || max(k) || '.0' AS version FROM ({_SIZES}) WHERE k + 3 <= (SELECT max(k) FROM ({_SIZES})) UNION ALL SELECT 'b', "
    f"'1.' || max(k) || '.0' FROM ({_SIZES})"
)
def solver_select(t: Tables) -> DataFrame:
    """a 1.k.0 needs b 1.(k+3).0 or later, so the newest of a have no partner and are given up."""
    sizes = [r["k"] for r in t.part.select((F.col("p_size") % 10).alias("k")).distinct().collect()]  # ten at most
    index = {"a": {f"1.{k}.0": {"b": f">=1.{k + 3}"} for k in sizes}, "b": {f"1.{k}.0": {} for k in sizes}}
    return t.spark.createDataFrame(sorted(solver.solve(index, {"a": "^1"}).items()), "package string, version string")


@query(
    "SELECT * FROM (VALUES ('absent', true, NULL), ('eq', true, NULL), ('fails', true, NULL), ('jobs', true, NULL), ('not read', true, NULL), ('read', true, NULL), ('snapshot', true, NULL), ('there', true, NULL), ('unequal', true, NULL), ('wrong', false, '1 is not 2'))"
    " AS v(site, passed, failure)"
)
def check_vocabulary(t: Tables) -> DataFrame:
    """A suite of checks; the one that fails hides no other."""
    checks, rows = Checks(t.spark), t.nation.select("n_name")
    checks.expect_eq("eq", F.lit(1) + 1, 2)
    checks.expect_eq("wrong", F.lit(1), 2)
    checks.expect_ne("unequal", F.lit("a"), "b")
    checks.expect_some("there", F.lit(0))
    checks.expect_none("absent", arrays.first(F.array().cast("array<int>")))
    checks.expect_fail("fails", "IndexOutOfBounds", lambda: arrays.try_at(F.array(F.lit(1)), F.lit(1)))
    checks.read("read", rows, "n_name")
    checks.never_read("not read", rows, "n_nationkey")
    path = scratch_path(t.spark, "snapshot")
    sinks.write_snapshot(rows, path)
    checks.expect_snapshot("snapshot", rows.repartition(3), path)
    with checks.jobs_at_most("jobs", 2):
        rows.count()
    return checks.rows()


@query("SELECT n_nationkey, CASE WHEN n_regionkey < 4 THEN n_name END AS said, CASE WHEN n_regionkey = 4 THEN 'ProcessFailure' END AS failure FROM nation")
def exec_rows(t: Tables) -> DataFrame:
    """A program for each row: what it says, or that it failed."""
    good = F.array(F.lit("/bin/echo"), F.lit("-n"), F.col("n_name"))
    rows = t.nation.select("n_nationkey", F.when(F.col("n_regionkey") < 4, good).otherwise(F.array(F.lit("/bin/false"))).alias("argv"))
    out = process.run_rows(rows, ["n_nationkey"], "argv", allow=True)
    return out.select("n_nationkey", F.col("outcome.ok.stdout").cast("string").alias("said"), F.col("outcome.err.code").alias("failure"))


_EDITION = "CASE WHEN n_nationkey % 2 = 0 THEN '2021' ELSE '2015' END"
_ARGUMENTS = f"'--crate-name pkg_' || n_nationkey || ' --edition ' || {_EDITION} || ' --crate-type ' || kind || ' ' || root || ' --out-dir .' || CASE WHEN n_nationkey >= 5 THEN ' --extern pkg_' || (n_nationkey - 5) || '=libpkg_' || (n_nationkey - 5) || '.rlib' ELSE '' END"


@query(
    f"SELECT n_nationkey, {_ARGUMENTS} AS arguments FROM nation, (VALUES ('lib', 'src/lib.rs'), ('bin', 'src/main.rs')) AS u(kind, root) WHERE kind "
    f"= 'lib' OR n_regionkey = 0"
)
def unit_plan(t: Tables) -> DataFrame:
    """Manifests and file lists of packages, each of which links the fifth before it, as compiler arguments."""
    name = F.concat(F.lit("pkg-"), F.col("n_nationkey").cast("string"))
    edition = F.when(F.col("n_nationkey") % 2 == 0, F.lit('edition = "2021"\n')).otherwise("")
    text = F.concat(F.lit('[package]\nname = "'), name, F.lit('"\nversion = "1.0.0"\n'), edition)
    manifests = manifest.read_manifests(t.nation.select("n_nationkey", text.alias("text")), "n_nationkey", "text")
    paths = F.when(
        F.col("n_regionkey") == 0, F.array(F.lit("src/lib.rs"), F.lit("src/main.rs")),
    ).otherwise(F.array(F.lit("src/lib.rs"), F.lit("src/other.rs"), F.lit("lib.rs")))
    found = manifest.units(manifests, t.nation.select("n_nationkey", F.explode(paths).alias("path")), "n_nationkey")
    needs = F.when(F.col("n_nationkey") >= 5, F.array(F.concat(F.lit("pkg-"), (F.col("n_nationkey") - 5).cast("string")))).otherwise(F.array().cast("array<string>"))
    return found.select("n_nationkey", F.array_join(manifest.arguments(found, needs), " ").alias("arguments"))
