"""Decoding, sources, reuse, recursion and graphs."""

from __future__ import annotations

import gzip
import hashlib
import io
import tarfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.functions import decode
from keyspan.functions.strings import lines
from keyspan.operators import graph
from keyspan.plans.memo import Memo, recipe
from keyspan.queries.registry import Tables, query
from keyspan.sources import blobs, index, trees
from keyspan.sources.store import scratch_path
from keyspan.streaming.incremental import current, upsert_new_files

PROPS = T.StructType([T.StructField("k", T.LongType(), False)])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_decode(t: Tables) -> DataFrame:
    from keyspan.functions.results import strict

    return t.events.select("event_id", strict(decode.try_json(F.col("props"), PROPS)).alias("r")).select("event_id", F.col("r.k").alias("k"))


@query(
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 "
    "THEN 'k: missing' WHEN 2 THEN 'k: wrong type' WHEN 3 THEN 'trailing text' ELSE 'not one JSON object' END AS failure FROM events"
)
def json_try_decode(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.col("props")).when(k == 1, '{"other": 1}').when(k == 2, '{"k": "42"}').when(k == 3, F.concat("props", F.lit(" x"))).otherwise('{"k": 1, "k": 2}')
    return t.events.select("event_id", decode.try_json(text, PROPS).alias("r")).select("event_id", F.col("r.ok.k").alias("k"), F.col("r.err.payload").alias("failure"))


@query(
    "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS kind, event_id % "
    "4 <> 0 AS good FROM events"
)
def toml_decode(t: Tables) -> DataFrame:
    body = F.concat(F.lit("user_id = "), F.col("user_id").cast("string"), F.lit('\nkind = "'), F.col("event_type"), F.lit('"\nextra = [1, 2]\n'))
    text = F.when(F.col("event_id") % 4 == 0, F.lit("user_id = \n")).otherwise(body)
    schema = T.StructType([T.StructField("user_id", T.LongType(), False), T.StructField("kind", T.StringType(), False)])
    out = decode.try_toml(t.events.select("event_id", text.alias("text")), ["event_id"], "text", schema)
    return out.select("event_id", F.col("decoded.ok.user_id").alias("user_id"), F.col("decoded.ok.kind").alias("kind"), F.col("decoded.err").isNull().alias("good"))


@query("SELECT 'names' AS parent, 'part-' AS start, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS length FROM nation")
def src_glob(t: Tables) -> DataFrame:
    """Files of a written tree, by a pattern in its last segment."""
    root = scratch_path(t.spark, "tree")
    t.nation.select(F.col("n_name").alias("value")).coalesce(1).write.text(f"{root}/names")
    t.region.select(F.col("r_name").alias("value")).coalesce(1).write.text(f"{root}/other")
    found = trees.glob(trees.tree(t.spark, root), "names/*.txt")
    return found.select("parent", F.substring("name", 1, 5).alias("start"), "length")


@query("SELECT n_name AS line FROM nation")
def src_tree_text(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "tree")
    t.nation.select(F.col("n_name").alias("value")).coalesce(1).write.text(f"{root}/names")
    files = trees.tree(t.spark, root)
    name = trees.glob(files, "names/*.txt").select("name").first()["name"]  # one file
    read = trees.read_text(files, f"names/{name}").select(F.col("text.ok").alias("body"))
    return read.select(F.explode(lines(F.col("body"))).alias("line"))


@query(
    "SELECT 'gone' AS name, NULL AS text, 'MissingRegistryArtifact' AS err UNION ALL SELECT 'good', r_name, NULL FROM region WHERE r_regionkey = 0 "
    "UNION ALL SELECT 'torn', NULL, 'FetchIntegrity'"
)
def src_fetch_pinned(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "origin")
    name = t.region.where("r_regionkey = 0").first()["r_name"]
    t.spark.createDataFrame([(name,)], "value string").coalesce(1).write.option("lineSep", "|").text(root)
    pin = hashlib.sha256(f"{name}|".encode()).hexdigest()
    manifest = t.spark.createDataFrame(
        [("good", f"{root}/part-00000*", pin), ("torn", f"{root}/part-00000*", "0" * 64), ("gone", f"{root}/none", "1" * 64)],
        "name string, url string, sha256 string",
    )
    files = t.spark.read.format("binaryFile").load(root).select("path").first()["path"]
    manifest = manifest.withColumn("url", F.when(F.col("url").endswith("*"), files).otherwise(F.col("url")))
    out = blobs.fetch(t.spark, manifest)
    return out.select("name", F.rtrim(blobs.try_text(F.col("content")), F.lit("|")).alias("text"), "err")


def _archive(names: list[str]) -> bytes:
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as out:
        for name in names:
            body = f"content of {name}\n".encode()
            entry = tarfile.TarInfo(f"pkg/{name}")
            entry.size = len(body)
            out.addfile(entry, io.BytesIO(body))
    return gzip.compress(raw.getvalue(), mtime=0)


@query("SELECT 'pkg/' || r_name AS path, 'file' AS kind, CAST(length('content of ' || r_name) + 1 AS BIGINT) AS length FROM region")
def udtf_untar(t: Tables) -> DataFrame:
    archive = _archive([r["r_name"] for r in t.region.select("r_name").collect()])  # five names
    packed = t.spark.createDataFrame([(archive,)], "blob binary").select(blobs.gunzip("blob")["ok"].alias("tar"))
    return packed.lateralJoin(blobs.Untar(F.col("tar").outer())).select("path", "kind", "length")


_CUTS = "[substr(text, 1, k) FOR k IN range(0, 9) IF strlen(substr(text, 1, k)) = least(8, strlen(text))]"


@query(f"SELECT doc_id, strlen(text) AS n, {_CUTS}[1] AS head, CASE WHEN text IS NOT NULL AND len({_CUTS}) = 0 THEN 'InvalidText' END AS failure FROM documents")
def blob_ops(t: Tables) -> DataFrame:
    """The first 8 bytes of every document, also where they cut a code point."""
    b = F.col("text").cast("binary")
    rows = t.documents.select("doc_id", blobs.length(b).alias("n"), blobs.try_text(blobs.take(b, 8)).alias("head"), "text")
    return rows.select("doc_id", "n", "head", F.when(F.col("text").isNotNull() & F.col("head").isNull(), "InvalidText").alias("failure"))


@query("SELECT 'p/' || p_partkey AS path, p_name AS content FROM part")
def tree_union(t: Tables) -> DataFrame:
    files = t.part.select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("content"), "p_partkey")
    return trees.union(files.where("p_partkey % 3 <> 0").drop("p_partkey"), files.where("p_partkey % 2 = 0 OR p_partkey % 3 = 0").drop("p_partkey"))


@query("SELECT event_type, count(*) AS n, 1 AS hits, 1 AS misses FROM events GROUP BY event_type")
def memo_reuse(t: Tables) -> DataFrame:
    """The same demand twice: the second is read from the cache."""
    memo = Memo(t.spark, scratch_path(t.spark, "memo"))
    demand = lambda: memo.demand(
        recipe("count_by", recipe("scan", table="events"), key="event_type"), [f"{t.sf_dir}/events.parquet"],
        lambda: t.events.groupBy("event_type").agg(F.count("*").alias("n")),
    )
    demand()
    return demand().withColumn("hits", F.lit(memo.hits)).withColumn("misses", F.lit(memo.misses))


@query("SELECT CAST(sum(range) AS BIGINT) AS total FROM range(0, 10000000)")
def rec_tail_sum(t: Tables) -> DataFrame:
    return graph.tail_sum(t.spark, 0, 10_000_000)


@query("SELECT n_nationkey AS node, CAST(n_nationkey // 5 AS INTEGER) AS round FROM nation")
def graph_topo_rounds(t: Tables) -> DataFrame:
    """Nation k needs k - 5."""
    nodes = t.nation.select(F.col("n_nationkey").alias("node"))
    needs = t.nation.where("n_nationkey >= 5").select(F.col("n_nationkey").alias("src"), (F.col("n_nationkey") - 5).alias("dst"))
    return graph.topological_rounds(nodes, needs)


_EDGES = "SELECT c_custkey AS src, (c_custkey * 7 + 3) % (SELECT max(c_custkey) + 1 FROM customer) AS dst FROM customer UNION SELECT c_custkey, c_custkey // 3 FROM customer"


@query(f"WITH RECURSIVE e AS ({_EDGES}), r(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def graph_reach(t: Tables) -> DataFrame:
    top = t.customer.agg((F.max("c_custkey") + 1).alias("top"))  # one row
    a = t.customer.crossJoin(F.broadcast(top)).select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * 7 + 3) % F.col("top")).alias("dst"))
    b = t.customer.select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 3").alias("dst"))
    roots = t.spark.createDataFrame([(1,)], "node long")
    return graph.reach(roots, a.union(b).distinct()).select("node")


@query("SELECT 'pkg' || p_size AS name, count(*) AS rows, count(*) FILTER (p_partkey % 9 = 0) AS yanked, CAST(sum(p_partkey % 3) AS BIGINT) AS deps FROM part GROUP BY p_size")
def index_ingest(t: Tables) -> DataFrame:
    """Rows written as newline-delimited JSON, read under the declared schema, and counted."""
    path = scratch_path(t.spark, "index")
    dep = F.struct(
        F.lit("needed").alias("name"), F.lit("^1").alias("req"), F.array().cast("array<string>").alias("features"),
        F.lit(False).alias("optional"), F.lit(True).alias("default_features"), F.lit("normal").alias("kind"),
    )
    deps = F.when(F.col("p_partkey") % 3 > 0, F.array_repeat(dep, (F.col("p_partkey") % 3).cast("int"))).otherwise(
        F.array().cast("array<struct<name:string,req:string,features:array<string>,optional:boolean,default_features:boolean,kind:string>>")
    )
    rows = t.part.select(
        F.concat(F.lit("pkg"), F.col("p_size").cast("string")).alias("name"),
        F.concat(F.lit("1.0."), F.col("p_partkey").cast("string")).alias("vers"), deps.alias("deps"),
        (F.col("p_partkey") % 9 == 0).alias("yanked"),
    )
    rows.write.json(path)
    return index.counts(index.read_index(t.spark, path))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def stream_upsert_files(t: Tables) -> DataFrame:
    """Files of events in two batches, the later events first; the last event of each user stays."""
    source, target, progress = (scratch_path(t.spark, x) for x in ("incoming", "target", "progress"))
    rows = t.events.select("user_id", "event_id", "value")
    late = (F.col("event_id") % 3 > 0) | (F.col("user_id") % 2 == 0)
    for name, part in (("a", rows.where(late)), ("b", rows.where(~late))):
        part.write.parquet(f"{source}/{name}")
        upsert_new_files(t.spark, f"{source}/*", rows.schema, ["user_id"], ["event_id"], target, progress)
    return current(t.spark, target, rows.schema, ["user_id"], ["event_id"])
