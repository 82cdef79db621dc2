"""Strings, paths, options, failures and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.functions import paths, results, semver
from keyspan.functions import strings as S
from keyspan.operators import maps
from keyspan.queries.registry import Tables, query


@query("SELECT c_custkey, c_name || '/' || c_mktsegment AS s FROM customer")
def str_concat(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.concat(F.col("c_name"), F.lit("/"), F.col("c_mktsegment")).alias("s"))


@query("SELECT c_custkey, c_name AS s FROM customer")
def str_trim(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.trim(F.concat(F.lit("\t \n"), F.col("c_name"), F.lit(" \r\f"))).alias("s"))


@query("SELECT doc_id, contains(text, 'the.') AS found FROM documents")
def str_contains(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.contains(F.col("text"), F.lit("the.")).alias("found"))


@query(
    "SELECT doc_id, CASE WHEN contains(text, '. ') THEN substr(text, 1, instr(text, '. ') - 1) END AS head, CASE WHEN contains(text, '. ') THEN "
    "length(substr(text, instr(text, '. ') + 2)) END AS after, CASE WHEN NOT contains(text, '. ') THEN 'MissingDelimiter' END AS failure FROM "
    "documents"
)
def str_split_once(t: Tables) -> DataFrame:
    r = t.documents.select("doc_id", S.split_once(F.col("text"), ". ").alias("r"))
    return r.select("doc_id", F.col("r.ok.before").alias("head"), F.length("r.ok.after").cast("long").alias("after"), F.col("r.err.code").alias("failure"))


@query(
    "SELECT event_id, CASE WHEN regexp_full_match(s, '-?[0-9]+') THEN TRY_CAST(s AS BIGINT) END AS n, CASE WHEN NOT regexp_full_match(s, "
    "'-?[0-9]+') THEN 'InvalidInteger' WHEN TRY_CAST(s AS BIGINT) IS NULL THEN 'IntegerOverflow' END AS failure FROM (SELECT event_id, CASE "
    "event_id % 5 WHEN 0 THEN '-' || user_id WHEN 1 THEN ' 42' WHEN 2 THEN '9223372036854775808' WHEN 3 THEN '007' ELSE event_type END AS s FROM "
    "events)"
)
def str_parse_int(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    s = F.when(
        k == 0, F.concat(F.lit("-"), F.col("user_id").cast("string")),
    ).when(k == 1, " 42").when(k == 2, "9223372036854775808").when(k == 3, "007").otherwise(F.col("event_type"))
    return t.events.select("event_id", S.parse_int(s).alias("r")).select("event_id", F.col("r.ok").alias("n"), F.col("r.err.code").alias("failure"))


@query("SELECT event_id, regexp_full_match(CASE event_id % 3 WHEN 0 THEN '007' WHEN 1 THEN '-3' ELSE '5' || chr(10) END, '[0-9]+') AS numeric FROM events")
def str_is_numeric(t: Tables) -> DataFrame:
    k = F.col("event_id") % 3
    return t.events.select("event_id", S.is_numeric(F.when(k == 0, "007").when(k == 1, "-3").otherwise("5\n")).alias("numeric"))


@query(
    r"SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\n\z', ''), chr(10))) END AS BIGINT) AS n, "
    r"string_split(text, chr(10))[1] AS head FROM documents"
)
def str_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.lines(F.col("text")).alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.get("x", F.lit(0)).alias("head"))


@query("SELECT doc_id, CAST(len(string_split(text, '. ')) AS BIGINT) AS n FROM documents")
def str_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(S.split(F.col("text"), ". ")).cast("long").alias("n"))


@query("SELECT p_partkey, starts_with(p_name, 'part') AS yes FROM part")
def str_starts_with(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.starts_with(F.col("p_name"), "part").alias("yes"))


@query("SELECT c_custkey, CASE WHEN starts_with(c_name, 'Customer#') THEN substr(c_name, 10) END AS rest FROM customer")
def str_strip_prefix(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.strip_prefix(F.col("c_name"), "Customer#").alias("rest"))


@query("SELECT doc_id, md5(replace(text, 'the', 'THE')) AS digest FROM documents")
def str_replace(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(S.replace(F.col("text"), "the", "THE").cast("binary")).alias("digest"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' ELSE lang || '/' END || 'index.html' AS path FROM (SELECT page_id, 'd' || page_id AS lang FROM pages)")
def path_join(t: Tables) -> DataFrame:
    base = F.when(F.col("page_id") % 4 == 0, "").otherwise(F.concat(F.lit("d"), F.col("page_id").cast("string")))
    return t.pages.select("page_id", paths.join(base, "index.html").alias("path"))


_NAME = "string_split(url, '/')[-1]"
_LAST = f"length({_NAME}) - instr(reverse({_NAME}), '.') + 1"
_HAS = f"(contains({_NAME}, '.') AND {_LAST} > 1 AND {_LAST} < length({_NAME}))"


@query(
    f"SELECT page_id, CAST(len(string_split(url, '/')) AS BIGINT) AS segments, {_NAME} AS name, CASE WHEN {_HAS} THEN substr({_NAME}, {_LAST} + 1) END AS extension,"
    f" CASE WHEN {_HAS} THEN substr({_NAME}, 1, {_LAST} - 1) ELSE {_NAME} END AS stem, CASE WHEN contains(url, '/') THEN substr(url, 1, length(url) - length({_NAME}) - 1) ELSE '' END AS parent FROM pages"
)
def path_parts(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select(
        "page_id", F.size(paths.segments(u)).cast("long").alias("segments"), paths.file_name(u).alias("name"),
        paths.extension(u).alias("extension"), paths.stem(u).alias("stem"), paths.parent(u).alias("parent"),
    )


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def opt_unwrap_or(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.select("doc_id", results.unwrap_or(F.col("quality"), F.lit(-1)).alias("quality"))


@query("SELECT d.doc_id, l.quality IS NOT NULL AS some, l.quality IS NULL AS none FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def opt_is_some(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.select("doc_id", results.is_some(F.col("quality")).alias("some"), results.is_none(F.col("quality")).alias("none"))


@query(
    "SELECT o_orderkey, CASE WHEN o_totalprice >= 1000 THEN o_totalprice END AS price, CASE WHEN o_totalprice < 1000 THEN 'Raised' END AS failure, "
    "CASE WHEN o_totalprice < 1000 THEN 'order ' || o_orderkey END AS payload FROM orders"
)
def fail_try(t: Tables) -> DataFrame:
    note = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    r = results.result(F.col("o_totalprice"), (F.col("o_totalprice") < 1000, results.error("Raised", "price", note)))
    return t.orders.select("o_orderkey", r.alias("r")).select(
        "o_orderkey", F.col("r.ok").alias("price"), F.col("r.err.code").alias("failure"), F.col("r.err.payload").alias("payload"),
    )


@query("SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN 1000 // (user_id % 3) ELSE -1 END AS q FROM events")
def try_result(t: Tables) -> DataFrame:
    d = F.col("user_id") % 3
    r = results.result(F.call_function("div", F.lit(1000).cast("long"), F.when(d == 0, 1).otherwise(d)), (d == 0, results.error("DivisionByZero", "q")))
    return t.events.select("event_id", r.alias("r")).select("event_id", F.when(results.is_ok(F.col("r")), F.col("r.ok")).otherwise(F.lit(-1).cast("long")).alias("q"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def require_ok(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", results.require(F.col("o_orderkey") >= 0, "keys are not negative", F.col("o_totalprice")).alias("o_totalprice"))


#: A version text for each part.
_VERSION = "(p_size % 3) || '.' || (p_partkey % 12) || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '.' || (p_partkey % 7) END || CASE p_partkey % 4 WHEN 0 THEN '-alpha.' || (p_partkey % 11) WHEN 1 THEN '-rc' ELSE '' END || CASE WHEN p_partkey % 6 = 0 THEN '+b1' ELSE '' END"


def _versions(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.expr(_VERSION.replace("(p_size % 3) ||", "string(p_size % 3) ||")).alias("text"))


_PARTS = f"SELECT p_partkey, p_size % 3 AS major, p_partkey % 12 AS minor, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey % 7 END AS patch, p_partkey % 4 AS k, {_VERSION} AS text FROM part"


@query(
    f"SELECT p_partkey, text, CAST(major AS BIGINT) AS major, CAST(minor AS BIGINT) AS minor, CAST(patch AS BIGINT) AS patch, k > 1 AS release, "
    f"CASE k WHEN 0 THEN 'alpha.' || (p_partkey % 11) WHEN 1 THEN 'rc' ELSE '' END AS pre, CASE WHEN p_partkey % 6 = 0 THEN 'b1' ELSE '' END AS "
    f"build FROM ({_PARTS})"
)
def semver_parse(t: Tables) -> DataFrame:
    v = _versions(t).withColumn("v", semver.parse(F.col("text")))
    pre = F.array_join(F.transform("v.pre.ids", lambda i: F.when(i["tag"] == 0, i["num"].cast("string")).otherwise(i["alpha"])), ".")
    return v.select(
        "p_partkey", "text", F.col("v.major").alias("major"), F.col("v.minor").alias("minor"), F.col("v.patch").alias("patch"),
        (F.col("v.pre.is_release") == 1).alias("release"), pre.alias("pre"), F.col("v.build").alias("build"),
    )


@query(
    f"SELECT text, row_number() OVER (ORDER BY major, minor, patch, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, a, text) - 1 AS pos FROM (SELECT "
    f"DISTINCT text, major, minor, patch, k, CASE WHEN k = 0 THEN p_partkey % 11 ELSE 0 END AS a FROM ({_PARTS}))"
)
def semver_sort(t: Tables) -> DataFrame:
    """Every distinct version with its position."""
    v = _versions(t).select("text").distinct().withColumn("p", semver.precedence(semver.parse(F.col("text"))))
    return maps.positions(v, F.col("p").asc(), F.col("text").asc()).select("text", "pos")


_AT = "major * 1000000 + minor * 1000 + patch"
_ADMITS = ", ".join(f"k > 1 AND {_AT} >= {m}004002 OR {_AT} = {m}004002 AND (k = 0 AND p_partkey % 11 >= 3 OR k = 1) AS from{m}" for m in (0, 1, 2))


@query(f"SELECT p_partkey, text, k > 1 AS whole, {_ADMITS} FROM ({_PARTS})")
def semver_contains(t: Tables) -> DataFrame:
    """Prereleases on the line of a requirement's bound, and none in ``*``."""
    v = _versions(t).withColumn("v", semver.parse(F.col("text")))
    held = {"whole": "*"} | {f"from{m}": f">={m}.4.2-alpha.3" for m in (0, 1, 2)}
    return v.select("p_partkey", "text", *(semver.contains(semver.parse_requirement(r), F.col("v")).alias(name) for name, r in held.items()))


#: Requirement texts with what each admits: version numbers as one number, k the kind (0 and 1 are prereleases).
_REQUIREMENTS = {
    "*": "k > 1",
    "<=1.2": f"k > 1 AND {_AT} <= 1002000",
    ">1.2": f"k > 1 AND {_AT} > 1002000",
    "^0": f"k > 1 AND {_AT} = 0",
    "~0.3": f"k > 1 AND {_AT} >= 3000 AND {_AT} < 4000",
    "^1.0.0-rc": f"k > 1 AND {_AT} >= 1000000 AND {_AT} < 2000000 OR {_AT} = 1000000 AND k = 1",
    ">=2.4.2-alpha.5, <2.9": f"{_AT} < 2009000 AND (k > 1 AND {_AT} >= 2004002 OR {_AT} = 2004002 AND (k = 0 AND p_partkey % 11 >= 5 OR k = 1))",
    "no requirement": "false",
}
_CHOSEN = "list_extract([" + ", ".join(f"'{r}'" for r in _REQUIREMENTS) + "], CAST(p_partkey // 4 % 8 + 1 AS INTEGER))"
_HELD = "CASE p_partkey // 4 % 8 " + " ".join(f"WHEN {k} THEN {test}" for k, test in enumerate(_REQUIREMENTS.values())) + " END"


def _required(t: Tables) -> DataFrame:
    texts = F.array(*map(F.lit, _REQUIREMENTS))
    rows = _versions(t).withColumn("requirement", F.get(texts, (F.floor(F.col("p_partkey") / 4) % 8).cast("int")))
    return semver.requirement_sets(rows.withColumn("v", semver.parse(F.col("text"))), "requirement")


@query(f"SELECT p_partkey, text, {_CHOSEN} AS requirement, coalesce({_HELD}, false) AS held FROM ({_PARTS})")
def semver_admission(t: Tables) -> DataFrame:
    """A column of versions in a column of requirements."""
    return _required(t).select("p_partkey", "text", "requirement", semver.set_contains(F.col("sets"), F.col("v")).alias("held"))


@query(f"SELECT p_partkey, text, coalesce({_HELD}, false) AND (k > 1 AND {_AT} >= 1000000 OR {_AT} = 1000000 AND k = 1) AS held FROM ({_PARTS})")
def semver_meet(t: Tables) -> DataFrame:
    """Versions in the common part of two sets: each row's own and one that all share."""
    shared = t.spark.createDataFrame([(">=1.0.0-rc",)], "other string")
    rows = _required(t).crossJoin(F.broadcast(semver.requirement_sets(shared, "other", "others").select("others")))  # one row
    return rows.select("p_partkey", "text", semver.set_contains(semver.set_meet(F.col("sets"), F.col("others")), F.col("v")).alias("held"))
