"""Every query against its SQL, and against itself under other partitionings."""

import pytest

from keyspan import catalog
from tests.oracle import connection, rows_of_spark, rows_of_sql

NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf_dir, con, name):
    found = rows_of_spark(catalog.QUERIES[name](spark, sf_dir))
    if name in catalog.SQL:
        assert found == rows_of_sql(con, catalog.SQL[name])
    else:
        assert found[1]


@pytest.mark.parametrize(
    "name",
    [
        "stream_split_min", "lock_build_order", "semver_admission", "range_join", "tree_conflicts", "map_values_compact", "agg_fold_concat",
        "sort_by_key", "set_symdiff", "map_resolve_unique", "semver_sort",
    ],
)
@pytest.mark.parametrize("partitions,codegen", [("1", "true"), ("7", "false")])
def test_same_under_other_plans(spark, sf_dir, name, partitions, codegen):
    expected = rows_of_spark(catalog.QUERIES[name](spark, sf_dir))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.codegen.wholeStage", codegen)
        assert rows_of_spark(catalog.QUERIES[name](spark, sf_dir)) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.codegen.wholeStage", "true")


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).columns == ["event_id", "event_type", "value"]
