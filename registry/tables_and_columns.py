"""Sources, sinks and column edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions.values import display_round, display_text
from quillgrid.operators import columns as C
from quillgrid.operators.filters import Condition
from quillgrid.session import scratch_path
from quillgrid.sources import ingest as I
from quillgrid.sources.sqlbox import sql
from registry.base import over, register, sql_number, sql_strip, table, view

_NA = ", ".join(f"'{t}'" for t in I.NA_TOKENS)


@register(
    "csv_scan",
    over(
        "dirty_customer",
        f"""SELECT _rid, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
            CASE WHEN segment NOT IN ({_NA}) THEN segment END AS segment, balance,
            CASE WHEN balance_text NOT IN ({_NA}) THEN balance_text END AS balance_text
            FROM dirty_customer""",
    ),
)
def csv_scan(spark, folder):
    path = I.csv_sink(view(spark, folder, "dirty_customer"), scratch_path(spark, "csv"))
    return I.csv_scan(spark, path)


@register(
    "csv_scan_quoted_breaks",
    f"""SELECT doc_id, CASE WHEN text NOT IN ({_NA}) THEN text END AS text, lang, source, n_chars FROM documents""",
)
def csv_scan_quoted_breaks(spark, folder):
    """Texts with line breaks, quotes and commas inside, written and read back."""
    return I.csv_scan(spark, I.csv_sink(table(spark, folder, "documents"), scratch_path(spark, "csv")))


_IDS = "SELECT o_orderkey + 9007199254740992 AS a, 9223372036854775807 - o_orderkey AS b, o_orderstatus FROM {orders}"


@register("csv_scan_big_id", _IDS.replace("{orders}", "orders"))
def csv_scan_big_id(spark, folder):
    ids = spark.sql(_IDS.replace("9223372036854775807", "9223372036854775807L"), orders=table(spark, folder, "orders"))
    return I.csv_scan(spark, I.csv_sink(ids, scratch_path(spark, "csv")))


@register("csv_sink", "SELECT * FROM orders")
def csv_sink(spark, folder):
    orders = table(spark, folder, "orders")
    path = I.csv_sink(orders, scratch_path(spark, "csv"))
    return I.csv_scan(spark, path, orders.schema)


@register(
    "infer_numeric",
    over(
        "dirty_customer",
        f"""SELECT _rid, c_name, c_nationkey, segment, balance, {sql_number('balance_text')} AS balance_text
            FROM dirty_customer""",
    ),
)
def infer_numeric(spark, folder):
    return I.infer_numeric(view(spark, folder, "dirty_customer"))


def _share(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", round_even(avg(CASE WHEN {c} IS NOT NULL AND {sql_strip(c)} <> '' "
        f"THEN CAST({sql_number(c)} IS NOT NULL AS INT) END), 6) AS share FROM dirty_customer"
    )


@register(
    "infer_numeric_shares",
    over(
        "dirty_customer",
        f"""SELECT "column", share, share >= 0.8 AS is_numeric FROM
            ({_share('c_name')} UNION ALL {_share('segment')} UNION ALL {_share('balance_text')})""",
    ),
)
def infer_numeric_shares(spark, folder):
    return I.number_shares(view(spark, folder, "dirty_customer")).withColumn("share", F.bround("share", 6))


@register(
    "value_dictionary",
    over(
        "dirty_customer",
        f"""SELECT DISTINCT "column", {sql_strip('v')} AS value FROM (
            SELECT 'c_name' AS "column", c_name AS v FROM dirty_customer
            UNION ALL SELECT 'segment', segment FROM dirty_customer
            UNION ALL SELECT 'balance_text', balance_text FROM dirty_customer) WHERE v IS NOT NULL""",
    ),
)
def value_dictionary(spark, folder):
    return I.value_dictionary(view(spark, folder, "dirty_customer"))


@register("preview", over("dirty_customer", "SELECT * FROM dirty_customer ORDER BY _rid LIMIT 10"))
def preview(spark, folder):
    return I.preview(view(spark, folder, "dirty_customer"))


@register(
    "sql_register",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'",
)
def sql_register(spark, folder):
    query = "SELECT o_orderkey, o_totalprice FROM {dataset} WHERE o_totalprice > 400000 AND o_orderstatus = 'F'"
    return sql(spark, query, dataset=table(spark, folder, "orders"))


# Column edits


@register("trim_headers", over("dirty_orders", "SELECT * FROM dirty_orders"))
def trim_headers(spark, folder):
    orders = view(spark, folder, "dirty_orders")
    return C.trim_headers(orders.toDF(" _rid", "custkey  ", "\tpriority ", "status", " price", "price_null_group "))


@register("drop_column", over("dirty_orders", "SELECT * EXCLUDE (price_null_group) FROM dirty_orders"))
def drop_column(spark, folder):
    return C.drop_column(C.drop_column(view(spark, folder, "dirty_orders"), "price_null_group"), "no such column")


@register("rename_column", over("dirty_orders", "SELECT * RENAME (price AS total_price) FROM dirty_orders"))
def rename_column(spark, folder):
    return C.rename_column(view(spark, folder, "dirty_orders"), "price", "total_price")


@register(
    "add_constant",
    over("dirty_orders", "SELECT *, CAST(1250.5 AS DOUBLE) AS bonus, 'new' AS note FROM dirty_orders"),
)
def add_constant(spark, folder):
    return C.add_constant(C.add_constant(view(spark, folder, "dirty_orders"), "bonus", "$1,250.5"), "note", "new")


_FORMULAS = {
    "plus": ("+", f"balance + {sql_number('balance_text')}", "balance_text"),
    "minus": ("minus", f"balance - {sql_number('balance_text')}", "balance_text"),
    "times": ("times", "balance * CAST(0.1 AS DOUBLE)", 0.1),
    "divide": ("/", "balance / nullif(c_nationkey, 0)", "c_nationkey"),
}


def _formula(operation, right):
    def query(spark, folder):
        out = C.add_formula(view(spark, folder, "dirty_customer"), "result", "balance", operation, right)
        return out.select("_rid", "result")

    return query


for _name, (_op, _sql, _right) in _FORMULAS.items():
    register(
        f"add_formula_{_name}",
        over("dirty_customer", f"SELECT _rid, {_sql} AS result FROM dirty_customer"),
    )(_formula(_op, _right))

SQL_STAT = {
    "mean": "avg({x})",
    "sum": "coalesce(sum({x}), 0)",
    "min": "min({x})",
    "max": "max({x})",
    "median": "quantile_cont({x}, 0.5)",
    "count": "CAST(count({x}) AS DOUBLE)",
}


def _group_stat(func):
    def query(spark, folder):
        orders = view(spark, folder, "dirty_orders")
        out = C.add_group_stat(orders, "stat", "priority", "price", func)
        return C.add_group_stat(out, "stat_null_group", "priority", "price_null_group", func)

    return query


def _group_stat_sql(func):
    if func == "mode":
        one = (
            "(SELECT priority, x FROM (SELECT priority, {x} AS x, row_number() OVER "
            "(PARTITION BY priority ORDER BY count(*) DESC, {x}) AS r FROM dirty_orders "
            "WHERE {x} IS NOT NULL GROUP BY priority, {x}) WHERE r = 1)"
        )
        return over(
            "dirty_orders",
            f"""SELECT o.*, round_even(a.x, 2) AS stat, round_even(b.x, 2) AS stat_null_group FROM dirty_orders o
                LEFT JOIN {one.format(x='price')} a ON a.priority IS NOT DISTINCT FROM o.priority
                LEFT JOIN {one.format(x='price_null_group')} b ON b.priority IS NOT DISTINCT FROM o.priority""",
        )
    s = SQL_STAT[func]
    return over(
        "dirty_orders",
        f"""SELECT o.*, a.stat, a.stat_null_group FROM dirty_orders o JOIN (
            SELECT priority, round_even({s.format(x='price')}, 2) AS stat,
            round_even({s.format(x='price_null_group')}, 2) AS stat_null_group
            FROM dirty_orders GROUP BY priority) a ON a.priority IS NOT DISTINCT FROM o.priority""",
    )


for _func in ["mean", "sum", "min", "max", "median", "mode", "count"]:
    register(f"add_group_stat_{_func}", _group_stat_sql(_func))(_group_stat(_func))


@register(
    "verify_derived_column",
    over(
        "dirty_orders",
        """WITH d AS (SELECT price * 1.1 AS b, CASE WHEN _rid % 97 = 0 THEN price ELSE round_even(price * 1.1, 2) END AS a
                      FROM dirty_orders)
           SELECT CAST(count(*) FILTER (WHERE NOT ((a IS NULL AND b IS NULL) OR
             coalesce(abs(a - b) <= 0.005 + 1e-9 * abs(b), false))) AS BIGINT) AS mismatches FROM d""",
    ),
)
def verify_derived_column(spark, folder):
    orders = view(spark, folder, "dirty_orders")
    stored = F.when(F.col("_rid") % 97 == 0, F.col("price")).otherwise(F.bround(F.col("price") * 1.1, 2))
    return C.derived_column_mismatches(orders.withColumn("with_tax", stored), "with_tax", F.col("price") * 1.1)


@register("set_all_values", over("dirty_orders", "SELECT * REPLACE (CAST(0 AS DOUBLE) AS price) FROM dirty_orders"))
def set_all_values(spark, folder):
    return C.set_all_values(view(spark, folder, "dirty_orders"), "price", 0)


@register("set_all_null", over("dirty_orders", "SELECT * REPLACE (CAST(NULL AS DOUBLE) AS price) FROM dirty_orders"))
def set_all_null(spark, folder):
    return C.set_all_values(view(spark, folder, "dirty_orders"), "price", None)


_UPDATES = {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "==", "ne": "!="}


def _update(op):
    def query(spark, folder):
        where = Condition("balance_text", op, 5000)
        return C.update_where(view(spark, folder, "dirty_customer"), "balance", 20, where)

    return query


for _name, _op in _UPDATES.items():
    _x = sql_number("balance_text")
    _test = {"==": f"{_x} = 5000", "!=": f"{_x} IS DISTINCT FROM 5000"}.get(_op, f"{_x} {_op} 5000")
    register(
        f"update_where_{_name}",
        over(
            "dirty_customer",
            f"SELECT * REPLACE (CASE WHEN {_test} THEN CAST(20 AS DOUBLE) ELSE balance END AS balance) FROM dirty_customer",
        ),
    )(_update(_op))


@register(
    "update_where_count",
    over(
        "dirty_orders",
        """SELECT 'price != 0' AS condition, CAST(count(*) AS BIGINT) AS rows_updated FROM dirty_orders WHERE price IS DISTINCT FROM 0
           UNION ALL SELECT 'price > 250000', CAST(count(*) AS BIGINT) FROM dirty_orders WHERE price > 250000""",
    ),
)
def update_where_count(spark, folder):
    orders = view(spark, folder, "dirty_orders")
    parts = [
        C.updated_rows(orders, Condition("price", op, v)).select(F.lit(f"price {op} {v}").alias("condition"), "rows_updated")
        for op, v in (("!=", 0), (">", 250000))
    ]
    return parts[0].unionAll(parts[1])


@register(
    "null_where",
    over(
        "dirty_orders",
        "SELECT * REPLACE (CASE WHEN price >= 400000 THEN NULL ELSE custkey END AS custkey) FROM dirty_orders",
    ),
)
def null_where(spark, folder):
    return C.update_where(view(spark, folder, "dirty_orders"), "custkey", None, Condition("price", ">=", 400000))


@register(
    "replace_value",
    over(
        "dirty_customer",
        f"""SELECT * REPLACE (CASE WHEN lower({sql_strip('segment')}) = 'building' THEN 'Construction' ELSE segment END AS segment)
            FROM dirty_customer""",
    ),
)
def replace_value(spark, folder):
    return C.replace_value(view(spark, folder, "dirty_customer"), "segment", "Building", "Construction")


@register(
    "display_round",
    """SELECT l_returnflag, round_even(avg(l_discount * l_tax), 4) AS shown, round_even(avg(l_tax) FILTER (WHERE l_tax < 0), 4) AS missing,
       coalesce(CAST(round_even(avg(l_tax) FILTER (WHERE l_tax < 0), 4) AS VARCHAR), 'N/A') AS missing_text
       FROM lineitem GROUP BY l_returnflag""",
)
def display_metric(spark, folder):
    metric = table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        F.avg(F.col("l_discount") * F.col("l_tax")).alias("m"),
        F.avg(F.when(F.col("l_tax") < 0, F.col("l_tax"))).alias("none"),
    )
    return metric.select(
        "l_returnflag",
        display_round(F.col("m")).alias("shown"),
        display_round(F.col("none")).alias("missing"),
        display_text(metric, "none").alias("missing_text"),
    )
