"""Package indexes: newline-delimited JSON rows with nested dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "name string, vers string, deps array<struct<name:string,req:string,features:array<string>,optional:boolean,default_features:boolean,target:string,kind:string>>,"
    " cksum string, features map<string,array<string>>, yanked boolean, pubtime string"
)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)


def dependency_rows(index: DataFrame) -> DataFrame:
    """One row for each dependency of each version."""
    return index.select("name", "vers", F.posexplode("deps").alias("pos", "dep")).select(
        "name", "vers", "pos", F.col("dep.name").alias("needs"), F.col("dep.req").alias("req"), F.col("dep.optional").alias("optional"),
        F.col("dep.kind").alias("kind"),
    )


def counts(index: DataFrame) -> DataFrame:
    """Rows, yanked rows and dependencies of each package."""
    return index.groupBy("name").agg(
        F.count("*").alias("rows"), F.count_if(F.coalesce("yanked", F.lit(False))).alias("yanked"),
        F.sum(F.coalesce(F.size("deps"), F.lit(0)).cast("long")).alias("deps"),
    )
