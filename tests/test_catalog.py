"""Every registered query against its SQL, on the smallest tables."""

import pytest

from snapquery import catalog
from tests.compare import DATA, assert_same, duck


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, DATA), con.sql(catalog.ORACLES[name]))


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_results_do_not_depend_on_partitions_or_adaptive_execution(spark):
    names = ["group_multi", "page_skip_take", "distinct_cols", "stats_runs", "join_three_way", "sort_multi_limit"]
    seen = []
    for partitions, adaptive in (("1", "true"), ("7", "true"), ("7", "false")):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        seen.append([sorted(map(tuple, catalog.QUERIES[n](spark, DATA).collect())) for n in names])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert seen[0] == seen[1] == seen[2]
