"""The query registry: each operator as a query over the given tables.

A query is a function ``(spark, folder) -> DataFrame``; its check is a DuckDB
SQL text over the same tables. Messy inputs are views derived from the tables
by one SQL text that both engines run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

VIEWS = {
    # typos, blanks, nulls, money as text, padded text
    "dirty_customer": """
        SELECT c_custkey AS _rid, c_name, c_nationkey,
               CASE WHEN c_custkey % 50 = 7 THEN NULL
                    WHEN c_custkey % 50 = 9 THEN ''
                    WHEN c_custkey % 50 = 11 THEN 'None'
                    WHEN c_custkey % 10 = 3 THEN concat(substr(c_mktsegment, 1, 3), substr(c_mktsegment, 5))
                    WHEN c_custkey % 10 = 5 THEN concat('  ', lower(c_mktsegment), ' ')
                    ELSE c_mktsegment END AS segment,
               CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS balance,
               CASE WHEN c_custkey % 29 = 0 THEN 'n/a'
                    WHEN c_custkey % 3 = 0 THEN concat('$', CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS STRING))
                    ELSE CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS STRING) END AS balance_text
        FROM {customer}""",
    # null keys, null group values, a group of only nulls, extreme prices
    "dirty_orders": """
        SELECT o_orderkey AS _rid,
               CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_custkey END AS custkey,
               CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderpriority END AS priority,
               o_orderstatus AS status,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL
                    WHEN o_orderkey % 500 = 1 THEN o_totalprice * 50
                    ELSE o_totalprice END AS price,
               CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_totalprice END AS price_null_group
        FROM {orders}""",
    # exact duplicates, no key on purpose
    "dup_orders": """
        SELECT o_custkey, o_orderstatus, o_orderpriority FROM {orders}
        UNION ALL
        SELECT o_custkey, o_orderstatus, o_orderpriority FROM {orders} WHERE o_orderstatus = 'F'""",
    # a second version of orders: changed cells, removed rows, added rows
    "edited_orders": """
        SELECT o_orderkey AS _rid, o_custkey AS custkey,
               CASE WHEN o_orderkey % 20 = 3 THEN 'X' ELSE o_orderstatus END AS status,
               CASE WHEN o_orderkey % 30 = 4 THEN NULL ELSE o_totalprice END AS price
        FROM {orders} WHERE o_totalprice >= 5000
        UNION ALL
        SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice
        FROM {orders} WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'""",
    "base_orders": """
        SELECT o_orderkey AS _rid, o_custkey AS custkey, o_orderstatus AS status, o_totalprice AS price FROM {orders}""",
    # typed sentences with their expected kind
    "requests": """
        SELECT event_id AS _rid,
               CASE CAST(event_id % 8 AS INT)
                 WHEN 0 THEN concat('show rows where value over ', CAST(user_id * 10 AS STRING), ' and user under ', CAST(user_id + 40 AS STRING))
                 WHEN 1 THEN concat('average value by ', event_type)
                 WHEN 2 THEN concat('replace ', event_type, ' with other and then sort by value descending')
                 WHEN 3 THEN 'find outliers in value; top 5 values'
                 WHEN 4 THEN concat('show everything except ', event_type)
                 WHEN 5 THEN 'count users with value above forty'
                 WHEN 6 THEN 'drop empty rows after that impute missing values'
                 ELSE concat('show ', event_type, ' older than twenty five or over 80k') END AS text,
               CASE CAST(event_id % 8 AS INT)
                 WHEN 0 THEN 'FILTER' WHEN 1 THEN 'GROUP_BY' WHEN 2 THEN 'UPDATE_VALUE' WHEN 3 THEN 'ANOMALY'
                 WHEN 4 THEN 'FILTER' WHEN 5 THEN 'COUNT' WHEN 6 THEN 'DROP_NULLS' ELSE 'FILTER' END AS label,
               value AS latency_ms
        FROM {events}""",
}
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A base table or one of the derived views."""
    if name in TABLES:
        return table(spark, folder, name)
    text = VIEWS[name]
    used = {t: table(spark, folder, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def over(names: str, body: str) -> str:
    """DuckDB SQL with the named views in front as common table expressions."""
    ctes = []
    for name in names.split():
        text = VIEWS[name]
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        ctes.append(f"{name} AS ({text})")
    body = body.strip()
    head = "WITH " + ",\n".join(ctes)
    if body[:5].upper() == "WITH ":
        return head + ",\n" + body[5:]
    return head + "\n" + body


def register(name: str, oracle: str | None = None):
    def keep(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function

    return keep


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def sql_strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


def sql_number(x: str) -> str:
    """DuckDB text of the number parser."""
    text = sql_strip(f"regexp_replace({x}, '[$,]', '', 'g')")
    return f"(CASE WHEN regexp_matches({text}, '{NUMBER}') THEN TRY_CAST({text} AS DOUBLE) END)"
