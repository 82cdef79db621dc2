"""Package manifests, the units that a package's files make, and each unit's compiler arguments, as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.functions.decode import Option, Record, decode_rows

MANIFEST = Record("Manifest", {"package": Record("Package", {"name": "String", "version": "String", "edition": Option("String")})})
#: Fixed value: the edition of a manifest that names none.
DEFAULT_EDITION = "2015"
#: The files that are a unit by their name, and its kind.
ROOTS = {"src/lib.rs": "lib", "src/main.rs": "bin"}


def read_manifests(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and a struct of ok and err for each manifest's text."""
    return decode_rows(df, [key], text, MANIFEST, "toml")


def crate_name(package: Column) -> Column:
    """A package's name as an identifier."""
    return F.translate(package, "-", "_")


def units(manifests: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """key, name, kind, root and edition of each unit: a package's files that are one by their name.

    ``files``: key and path, relative to the package. A manifest that does not decode has no units.
    """
    package = manifests.where("decoded.ok is not null").select(key, "decoded.ok.package.*")
    kind = F.create_map(*(F.lit(x) for pair in ROOTS.items() for x in pair))
    roots = files.where(F.col("path").isin(*ROOTS)).select(key, F.col("path").alias("root"), kind[F.col("path")].alias("kind"))
    return roots.join(package, key).select(key, crate_name(F.col("name")).alias("name"), "kind", "root", F.coalesce("edition", F.lit(DEFAULT_EDITION)).alias("edition"))


def arguments(unit: DataFrame, dependencies: Column) -> Column:
    """The compiler's arguments for a unit; ``dependencies``: names of what it links, in order."""

    def extern(package: Column) -> Column:
        name = crate_name(package)
        return F.array(F.lit("--extern"), F.concat(name, F.lit("=lib"), name, F.lit(".rlib")))

    own = F.array(F.lit("--crate-name"), unit["name"], F.lit("--edition"), unit["edition"], F.lit("--crate-type"), unit["kind"], unit["root"], F.lit("--out-dir"), F.lit("."))
    return F.concat(own, F.flatten(F.transform(dependencies, extern)))
