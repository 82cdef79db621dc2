"""File trees as rows.

A tree that Spark reads has path, parent, name, length and content of its files; the
binary file source lists them, so any store that Spark lists will do, and a plan that
needs no content reads none.  A tree value (out of an archive, or put together) has
rows of path, kind (file, dir or symlink), content, executable and target; folders
may be implied by what lies below them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.functions.paths import file_name, parent
from keyspan.functions.results import error, result
from keyspan.operators.keyed import DuplicateKey
from keyspan.sources.store import qualified

#: Columns that tell one entry of a tree value from another.
ENTRY = ("kind", "content", "executable", "target")


def tree(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """path (relative), parent, name, length and content of every file below ``root``, a folder without wildcards."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(root)
    prefix = qualified(spark, root).rstrip("/") + "/"
    path = F.when(
        F.col("path").startswith(prefix), F.substring("path", len(prefix) + 1, 1 << 30),
    ).otherwise(F.raise_error(F.concat(F.lit(f"not below {prefix}: "), F.col("path"))))
    return files.select(path.alias("path"), F.col("length").cast("long").alias("length"), "content").select(
        "path", parent(F.col("path")).alias("parent"), file_name(F.col("path")).alias("name"), "length", "content",
    )


def glob(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose path matches: directories literally, one ``*`` at most in the last segment."""
    folder, _, last = pattern.rpartition("/")
    if "*" in folder or last.count("*") > 1:
        raise ValueError(f"one * in the last segment at most: {pattern!r}")
    before, star, after = last.partition("*")
    test = (F.col("name").startswith(before) & F.col("name").endswith(after) & (F.length("name") >= len(before) + len(after))) if star else F.col("name") == last
    return files.where((F.col("parent") == folder) & test)


def text(content: Column) -> Column:
    """Result of a file's bytes as UTF-8."""
    return result(F.try_validate_utf8(content.cast("string")), (F.try_validate_utf8(content.cast("string")).isNull(), error("InvalidText", "text")))


def read_text(files: DataFrame, path: str) -> DataFrame:
    """The result of reading one file: a missing entry and bytes that are no text are errors."""
    wanted = files.sparkSession.createDataFrame([(path,)], "path string")
    found = wanted.join(files.where(F.col("path") == path).select("path", "content"), "path", "left")
    below = files.where(F.col("path").startswith(path + "/")).limit(1).agg((F.count("*") > 0).alias("is_folder"))
    found = found.crossJoin(F.broadcast(below))  # one row each
    missing = F.col("content").isNull()
    ok = F.try_validate_utf8(F.col("content").cast("string"))
    return found.select(
        "path",
        result(
            ok, (missing & F.col("is_folder"), error("TreeEntryNotAFile", "text", F.col("path"))),
            (missing, error("MissingTreeEntry", "text", F.col("path"))), (ok.isNull(), error("InvalidText", "text", F.col("path"))),
        ).alias("text"),
    )


# Tree values.


def _segments(path: Column) -> Column:
    return F.split(path, "/", -1)


def valid_path(path: Column) -> Column:
    """Every segment is a name: not empty, ``.`` or ``..``."""
    return ~F.exists(_segments(path), lambda s: s.isin("", ".", ".."))


def _folders_of(paths: DataFrame) -> DataFrame:
    """Each proper prefix of each path, once."""
    parts = _segments(F.col("path"))
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return paths.where(F.size(parts) > 1).select(F.explode(above).alias("path")).distinct()


def walk(entries: DataFrame) -> DataFrame:
    """All entries, implied folders too, depth first: a folder before its children, names in order."""
    implied = _folders_of(entries.select("path")).join(entries.select("path"), "path", "left_anti")
    empty = [
        F.lit("dir").alias("kind") if c == "kind" else F.lit(False).alias(c) if c == "executable"
        else F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in entries.columns if c != "path"
    ]
    whole = entries.unionByName(implied.select("path", *empty))
    return whole.orderBy(_segments(F.col("path")))


def conflicts(a: DataFrame, b: DataFrame, disjoint: bool = False) -> DataFrame:
    """path and conflict of every reason why two trees are not one.

    ``NotADirectory``: an entry of one that is no folder has entries of the other below it.
    ``Disagreement``: the same path with different entries. ``Duplicate`` (``disjoint``): the same leaf in both.
    Two folders are joined, whether declared or implied.
    """
    kinds = [c for c in ENTRY if c in a.columns and c in b.columns] or [c for c in a.columns if c != "path"]
    own = lambda df, side: df.select("path", F.struct(*kinds).alias(side), (F.col("kind") if "kind" in kinds else F.lit("file")).alias(f"{side}_kind"))
    both = own(a, "x").join(own(b, "y"), "path")
    folders = (F.col("x_kind") == "dir") & (F.col("y_kind") == "dir")
    same = F.col("x").eqNullSafe(F.col("y"))
    named = F.when(folders, F.lit(None).cast("string")).when(~same, "Disagreement").when(F.lit(disjoint), "Duplicate")
    found = both.select("path", named.alias("conflict")).where("conflict is not null")
    for one, other in ((a, b), (b, a)):
        leaves = one.where("kind <> 'dir'") if "kind" in kinds else one
        found = found.union(leaves.select("path").join(_folders_of(other.select("path")), "path", "left_semi").select("path", F.lit("NotADirectory")))
    return found.distinct()


def _joined(a: DataFrame, b: DataFrame, disjoint: bool) -> DataFrame:
    least = conflicts(a, b, disjoint).orderBy("path", "conflict").limit(1).collect()
    if least:
        raise DuplicateKey(f"DuplicateKey: {least[0]['path']} ({least[0]['conflict']})")
    return a.unionByName(b.join(a.select("path"), "path", "left_anti"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both trees' entries; identical ones are one, a conflict raises with the least path."""
    return _joined(a, b, False)


def disjoint_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """As ``union``, but each leaf has one owner."""
    return _joined(a, b, True)


def insert_path(entries: DataFrame, entry: DataFrame) -> DataFrame:
    """The tree with one more entry (one row); a taken path and a file on the way to it raise."""
    paths = [r["path"] for r in entry.select("path").collect()]  # one row
    if len(paths) != 1 or entry.where(valid_path(F.col("path"))).isEmpty():
        raise ValueError(f"not one path of names: {paths}")
    return _joined(entries, entry, True)


def project(entries: DataFrame, folder: str) -> DataFrame:
    """The subtree below a folder, with paths relative to it."""
    inside = entries.where(F.col("path").startswith(folder + "/"))
    return inside.withColumn("path", F.substring("path", F.lit(len(folder) + 2), F.length("path")))


def observed(files: DataFrame, reads: DataFrame) -> DataFrame:
    """What reads see now: path, kind and digest of each.

    ``reads``: path and kind, ``content`` (a file's bytes) or ``listing`` (the names right
    in a folder). A file or folder that is not there has a null digest.
    """
    contents = files.join(reads.where("kind = 'content'").select("path"), "path", "left_semi").select(
        "path", F.lit("content").alias("kind"), F.sha2("content", 256).alias("digest"),
    )
    parts = _segments(F.col("path"))
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder"), F.get(parts, n).alias("name")),
    )
    names = files.select(F.explode(above).alias("s")).select(F.col("s.folder").alias("path"), F.col("s.name").alias("name")).distinct()
    wanted = names.join(reads.where("kind = 'listing'").select("path"), "path", "left_semi")
    # The names in one folder: what one listing holds.
    listings = wanted.groupBy("path").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("name")), "\n"), 256).alias("digest"))
    now = contents.unionByName(listings.select("path", F.lit("listing").alias("kind"), "digest"))
    return reads.select("path", "kind").join(now, ["path", "kind"], "left")


def verify(receipt: DataFrame, files: DataFrame) -> DataFrame:
    """Whether every recorded read still holds: same digest, or still absent (null digest)."""
    then = receipt if "kind" in receipt.columns else receipt.withColumn("kind", F.lit("content"))
    now = observed(files, then).withColumnRenamed("digest", "now")
    return then.join(now, ["path", "kind"], "left").agg(F.coalesce(F.bool_and(F.col("digest").eqNullSafe(F.col("now"))), F.lit(True)).alias("holds"))
