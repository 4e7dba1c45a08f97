"""What the plans must and must not contain."""

import contextlib
import io

import pytest

from quillgrid.operators import aggregates, columns, filters, joins, ordering
from quillgrid.operators.filters import Condition
from registry import all_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, _ = all_queries()


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{FOLDER}/orders.parquet")


def test_filter_and_columns_reach_the_scan(orders):
    conditions = [Condition("o_totalprice", ">", 100), Condition("o_custkey", "<=", 50)]
    text = plan(filters.filter_all(orders, conditions).select("o_orderkey"))
    assert "GreaterThan(o_totalprice,100.0)" in text and "LessThanOrEqual(o_custkey,50" in text
    assert "o_orderpriority" not in text


def test_group_aggregate_is_combined_before_the_shuffle(orders):
    text = plan(aggregates.group_agg(orders, "o_orderpriority", "mean", "o_totalprice"))
    assert text.count("HashAggregate") >= 2 and "ReadSchema: struct<o_totalprice:double,o_orderpriority:string>" in text


def test_group_stat_does_not_gather_groups(orders):
    text = plan(columns.add_group_stat(orders, "m", "o_orderpriority", "o_totalprice", "mean"))
    assert "Window" not in text and "BroadcastHashJoin" in text  # the stored group table is small


def test_top_n_is_not_a_full_sort(orders):
    assert "TakeOrderedAndProject" in plan(ordering.top_n(orders, "o_totalprice", rid="o_orderkey"))


def test_full_join_can_be_split(spark, orders):
    customers = spark.read.parquet(f"{FOLDER}/customer.parquet")
    assert "FullOuter" not in plan(joins.join_tables(orders, customers, "o_custkey", "c_custkey", "full"))


def test_no_query_multiplies_rows(spark):
    """No nested loops or cartesian products, except for group rows in one SQL text."""
    for name, query in QUERIES.items():
        if name == "sql_theta_join":
            continue
        text = plan(query(spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_whole_word_check_is_a_subquery(spark, orders):
    text = plan(filters.filter_all(orders, [Condition("o_orderpriority", "==", "urgent")]))
    assert "Subquery" in text and "Join" not in text
