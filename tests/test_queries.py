"""Every registered query against its DuckDB check on whole tables."""

import pytest

from registry import all_queries
from registry.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = all_queries()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    status, detail, _, _ = compare(spark, duck, FOLDER, QUERIES[name], ORACLE[name])
    assert status == "ok", detail


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["segment", "mean_price"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
