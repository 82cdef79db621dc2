"""Prereleases in sets of versions."""

from keyspan.functions import semver
from pyspark.sql import functions as F

VERSIONS = ["1.2.3-alpha", "1.2.3-alpha.2", "1.2.3-rc.1", "1.2.3", "1.2.4-alpha", "1.2.4", "1.3.0-rc", "1.3.0", "2.0.0-alpha", "2.0.0"]


def test_prereleases_on_their_line_only(spark):
    df = spark.createDataFrame([(v,) for v in VERSIONS], "v string")
    got = lambda sets: [r["v"] for r in df.where(semver.contains(sets, semver.parse(F.col("v")))).collect()]
    releases = [v for v in VERSIONS if "-" not in v]
    read = semver.parse_requirement
    assert got(read("*")) == got(read("")) == releases
    assert got(read(">=1.2.3-alpha")) == ["1.2.3-alpha", "1.2.3-alpha.2", "1.2.3-rc.1", *releases]
    assert got(read("^1.2.3-alpha.2")) == ["1.2.3-alpha.2", "1.2.3-rc.1", "1.2.3", "1.2.4", "1.3.0"]
    assert got(read("~1.2.3-rc.1")) == ["1.2.3-rc.1", "1.2.3", "1.2.4"]
    assert got(read("=1.2.3-rc.1")) == ["1.2.3-rc.1"] and got(read(">1.2.3-alpha, <1.2.3")) == ["1.2.3-alpha.2", "1.2.3-rc.1"]
    # comparators of one requirement admit either's lines; an intersection those that both admit
    assert got(read(">=1.2.3-alpha, <=1.3.0-rc")) == ["1.2.3-alpha", "1.2.3-alpha.2", "1.2.3-rc.1", "1.2.3", "1.2.4", "1.3.0-rc"]
    assert got(semver.intersect(read(">=1.2.3-alpha"), read("<=1.3.0-rc"))) == ["1.2.3", "1.2.4"]
    assert got(semver.intersect(read(">=1.2.3-alpha"), read("<1.2.3-rc.1"))) == ["1.2.3-alpha", "1.2.3-alpha.2"]
    assert read(">1.2.3-rc, <1.2.3-alpha") == []
