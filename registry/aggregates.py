"""Whole-table and grouped aggregates, joins, order, rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import aggregates as D
from quillgrid.operators import joins as E
from quillgrid.operators import ordering as O
from quillgrid.operators import rows as H
from quillgrid.operators.diff import table_diff
from quillgrid.operators.filters import drop_null_rows
from registry.base import over, register, sql_number, table, view

SQL = {
    "sum": "coalesce(sum({x}), 0)",
    "mean": "avg({x})",
    "median": "quantile_cont({x}, 0.5)",
    "min": "min({x})",
    "max": "max({x})",
    "count": "count({x})",
}


def _mode(x: str, source: str, keys: str = "") -> str:
    """DuckDB text: most frequent value of x (smallest on a tie) as one row per key."""
    by = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return (
        f"SELECT {by}v FROM (SELECT {by}{x} AS v, row_number() OVER ({part}ORDER BY count(*) DESC, {x}) AS r "
        f"FROM {source} WHERE {x} IS NOT NULL GROUP BY {by}{x}) WHERE r = 1"
    )


def _scalar(func, x, source):
    return f"({_mode(x, source)})" if func == "mode" else SQL[func].format(x=x)


# Whole-table aggregates over a number column and a money-as-text column.
for _func in D.FUNCTIONS:

    def _aggregate(spark, folder, func=_func):
        customers = view(spark, folder, "dirty_customer")
        number = D.aggregate(customers, func, "balance").select(F.bround(F.col("value").cast("double"), 4).alias("value"))
        text = D.aggregate(customers, func, "balance_text")
        text = text.select(F.bround(F.col("value").cast("double"), 4).alias("value"))
        return number.select(F.lit("balance").alias("column"), "value").unionAll(
            text.select(F.lit("balance_text").alias("column"), "value")
        )

    _x = sql_number("balance_text")
    _values = [_scalar(_func, "balance", "dirty_customer"), _scalar(_func, _x, "dirty_customer")]
    _from = "" if _func == "mode" else "FROM dirty_customer"
    register(
        f"agg_{_func}",
        over(
            "dirty_customer",
            f"""SELECT 'balance' AS "column", round_even(CAST({_values[0]} AS DOUBLE), 4) AS value {_from}
                UNION ALL SELECT 'balance_text', round_even(CAST({_values[1]} AS DOUBLE), 4) {_from}""",
        ),
    )(_aggregate)


@register("row_count", "SELECT count(*) AS value FROM lineitem")
def row_count(spark, folder):
    return D.row_count(table(spark, folder, "lineitem"))


@register("agg_mode_text", over("dirty_customer", _mode("segment", "dirty_customer").replace("SELECT v", "SELECT v AS value", 1)))
def agg_mode_text(spark, folder):
    return D.mode_of_text(view(spark, folder, "dirty_customer"), "segment")


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(
    "agg_all_numeric",
    "SELECT "
    + ", ".join(f"round_even(avg({c}), 4) AS {c}" for c in _LINE)
    + " FROM lineitem",
)
def agg_all_numeric(spark, folder):
    means = D.aggregate_all(table(spark, folder, "lineitem"), "mean", _LINE)
    return means.select(*[F.bround(c, 4).alias(c) for c in _LINE])


@register(
    "agg_all_numeric_median",
    "SELECT " + ", ".join(f"round_even(quantile_cont({c}, 0.5), 4) AS {c}" for c in _LINE) + " FROM lineitem",
)
def agg_all_numeric_median(spark, folder):
    medians = D.aggregate_all(table(spark, folder, "lineitem"), "median", _LINE)
    return medians.select(*[F.bround(c, 4).alias(c) for c in _LINE])


@register(
    "agg_all_numeric_text",
    over(
        "dirty_customer",
        f"""SELECT CAST(max(c_nationkey) AS INTEGER) AS c_nationkey, max(balance) AS balance,
            max({sql_number('balance_text')}) AS balance_text FROM dirty_customer""",
    ),
)
def agg_all_numeric_text(spark, folder):
    """Without a column list, number-like text columns take part."""
    return D.aggregate_all(view(spark, folder, "dirty_customer"), "max")


_MATRIX = ["sum", "mean", "median", "mode", "min", "max", "count"]
_LABEL = {"mean": "mean (average)"}


@register(
    "agg_matrix",
    over(
        "dirty_orders",
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", "
            + ", ".join(
                # sums of this size carry two safe decimals, whatever the order of addition
                f'round_even(CAST({_scalar(f, c, "dirty_orders")} AS DOUBLE), {2 if f == "sum" else 4}) AS "{_LABEL.get(f, f)}"'
                for f in _MATRIX
            )
            + " FROM dirty_orders"
            for c in ("custkey", "price", "price_null_group")
        ),
    ),
)
def agg_matrix(spark, folder):
    out = D.aggregate_matrix(view(spark, folder, "dirty_orders"), _MATRIX, ["custkey", "price", "price_null_group"])
    return out.withColumn("sum", F.bround("sum", 2))


# Grouped aggregates of one column.
for _func in D.FUNCTIONS:
    _alias = "price_null_group_count" if _func == "count" else f"{_func}_price_null_group"

    def _group(spark, folder, func=_func, alias=_alias):
        out = D.group_agg(view(spark, folder, "dirty_orders"), "priority", func, "price_null_group")
        return out if func == "count" else out.select("priority", F.bround(alias, 4).alias(alias))

    if _func == "mode":
        _sql = f"""SELECT k.priority, round_even(v, 4) AS {_alias} FROM (SELECT DISTINCT priority FROM dirty_orders) k
                   LEFT JOIN ({_mode('price_null_group', 'dirty_orders', 'priority')}) m
                   ON m.priority IS NOT DISTINCT FROM k.priority"""
    else:
        _value = SQL[_func].format(x="price_null_group")
        _value = _value if _func == "count" else f"round_even({_value}, 4)"
        _sql = f"SELECT priority, {_value} AS {_alias} FROM dirty_orders GROUP BY priority"
    register(f"group_{_func}", over("dirty_orders", _sql))(_group)


@register("group_row_count", over("dirty_orders", "SELECT priority, count(*) AS row_count FROM dirty_orders GROUP BY priority"))
def group_row_count(spark, folder):
    return D.group_agg(view(spark, folder, "dirty_orders"), "priority", "count")


# Grouped aggregates of all numeric columns.
_NUMBERS = ["custkey", "price", "price_null_group"]
for _func in D.FUNCTIONS:

    def _group_all(spark, folder, func=_func):
        out = D.group_agg_all(view(spark, folder, "dirty_orders"), "priority", func)
        if func == "count":
            return out
        return out.select("priority", *[F.bround(F.col(c).cast("double"), 4).alias(c) for c in _NUMBERS])

    if _func == "mode":
        _joins = " ".join(
            f"LEFT JOIN ({_mode(c, 'dirty_orders', 'priority')}) m{i} ON m{i}.priority IS NOT DISTINCT FROM k.priority"
            for i, c in enumerate(_NUMBERS)
        )
        _cols = ", ".join(f"round_even(CAST(m{i}.v AS DOUBLE), 4) AS {c}" for i, c in enumerate(_NUMBERS))
        _sql = f"SELECT k.priority, {_cols} FROM (SELECT DISTINCT priority FROM dirty_orders) k {_joins}"
    else:
        _cols = ", ".join(
            f"{SQL[_func].format(x=c)} AS {c}"
            if _func == "count"
            else f"round_even(CAST({SQL[_func].format(x=c)} AS DOUBLE), 4) AS {c}"
            for c in _NUMBERS
        )
        _sql = f"SELECT priority, {_cols} FROM dirty_orders GROUP BY priority"
    register(f"group_all_{_func}", over("dirty_orders", _sql))(_group_all)


for _func in ["avg", "sum", "count", "min", "max"]:

    def _fast(spark, folder, func=_func):
        out = D.fast_group_agg(view(spark, folder, "dirty_orders"), "priority", "price_null_group", func)
        alias = f"{func}_price_null_group"
        return out if func == "count" else out.withColumn(alias, F.bround(alias, 4))

    _value = f"{_func}(price_null_group)"
    _value = _value if _func == "count" else f"round_even({_value}, 4)"
    register(
        f"fast_group_{_func}",
        over("dirty_orders", f"SELECT priority, {_value} AS {_func}_price_null_group FROM dirty_orders GROUP BY priority"),
    )(_fast)


def _corr_sql(a, b):
    sa = f"stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END)"
    sb = f"stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END)"
    return f"covar_pop({a}, {b}) / nullif({sa} * {sb}, 0)"


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "flat"]
_LINEITEM = "(SELECT *, CAST(1 AS DOUBLE) AS flat FROM lineitem)"


@register(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round_even({_corr_sql(a, b)}, 3) + 0.0 AS r FROM {_LINEITEM}"
        for a in _CORR
        for b in _CORR
    ),
)
def correlation_matrix(spark, folder):
    items = table(spark, folder, "lineitem").withColumn("flat", F.lit(1.0))
    return D.correlations(items, _CORR)


_DESCRIBE_NUM = ["custkey", "price", "price_null_group"]
_DESCRIBE_TEXT = ["priority", "status"]


def _describe_sql():
    parts = []
    for c in _DESCRIBE_NUM:
        parts.append(
            f"""SELECT '{c}' AS "column", count({c}) AS "count", CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top,
                CAST(NULL AS BIGINT) AS freq, round_even(avg({c}), 4) AS mean, round_even(stddev_samp({c}), 4) AS std,
                CAST(min({c}) AS DOUBLE) AS "min", round_even(quantile_cont({c}, 0.25), 4) AS q25,
                round_even(quantile_cont({c}, 0.5), 4) AS q50, round_even(quantile_cont({c}, 0.75), 4) AS q75,
                CAST(max({c}) AS DOUBLE) AS "max" FROM dirty_orders"""
        )
    for c in _DESCRIBE_TEXT:
        top = _mode(c, "dirty_orders")
        parts.append(
            f"""SELECT '{c}', count({c}), count(DISTINCT {c}), ({top}), count(*) FILTER (WHERE {c} = ({top})),
                NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM dirty_orders"""
        )
    return over("dirty_orders", " UNION ALL ".join(parts))


@register("describe", _describe_sql())
def describe(spark, folder):
    out = D.describe(view(spark, folder, "dirty_orders"))
    return out.withColumns({c: F.bround(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@register(
    "bar_series",
    over(
        "dirty_orders",
        """SELECT priority AS bar, round_even(coalesce(sum(price), 0), 2) AS height FROM dirty_orders GROUP BY priority
           ORDER BY height DESC LIMIT 20""",
    ),
)
def bar_series(spark, folder):
    return D.bar_series(view(spark, folder, "dirty_orders"), "priority", "price").withColumn("height", F.bround("height", 2))


_BARS = "SELECT o_custkey AS bar, round_even(sum(o_totalprice), 2) AS height FROM orders GROUP BY o_custkey"


@register("bar_series_all", _BARS)
def bar_series_all(spark, folder):
    return D.bar_series(table(spark, folder, "orders"), "o_custkey", "o_totalprice").withColumn("height", F.bround("height", 2))


_BIG = "(SELECT o_custkey % 7 AS part, o_custkey + 9007199254740993 AS id FROM orders)"


def _big(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.select((F.col("o_custkey") % 7).alias("part"), (F.col("o_custkey") + F.lit(9007199254740993)).alias("id"))


@register("agg_mode_big_id", f"SELECT id AS value FROM {_BIG} GROUP BY id ORDER BY count(*) DESC, id LIMIT 1")
def agg_mode_big_id(spark, folder):
    return D.aggregate(_big(spark, folder), "mode", "id")


@register(
    "group_mode_big_id",
    f"""SELECT part, id AS mode_id FROM (SELECT part, id, row_number() OVER (PARTITION BY part ORDER BY count(*) DESC, id) AS k
        FROM {_BIG} GROUP BY part, id) WHERE k = 1""",
)
def group_mode_big_id(spark, folder):
    return D.group_agg(_big(spark, folder), "part", "mode", "id")


# Joins

for _how in ["inner", "left", "right", "full"]:

    def _join(spark, folder, how=_how):
        orders = view(spark, folder, "dirty_orders")
        customers = view(spark, folder, "dirty_customer").withColumnRenamed("_rid", "customer")
        # customers with a blank balance keep their row but lose their key
        key = F.when(F.col("balance").isNotNull(), F.col("customer")).alias("customer")
        customers = customers.select(key, "c_name", "segment", F.col("balance").alias("price"))
        return E.join_tables(orders, customers, "custkey", "customer", how)

    register(
        f"join_{_how}",
        over(
            "dirty_orders dirty_customer",
            f"""SELECT a.*, b.c_name, b.segment, b.price AS price_b FROM dirty_orders a {_how.upper()} JOIN
                (SELECT CASE WHEN balance IS NOT NULL THEN _rid END AS customer, c_name, segment, balance AS price
                 FROM dirty_customer) b ON a.custkey = b.customer""",
        ),
    )(_join)


# Order


def _sort(descending):
    def query(spark, folder):
        orders = view(spark, folder, "dirty_orders")
        price = F.col("price").desc_nulls_last() if descending else F.col("price").asc_nulls_last()
        return O.with_position(orders, [price, F.col("_rid").asc()])

    return query


for _key, _direction in {"sort_asc": "ASC", "sort_desc": "DESC"}.items():
    register(
        _key,
        over(
            "dirty_orders",
            f"""SELECT *, row_number() OVER (ORDER BY price {_direction} NULLS LAST, _rid) AS position FROM dirty_orders""",
        ),
    )(_sort(_direction == "DESC"))


@register("sort_rows", over("dirty_customer", "SELECT * FROM dirty_customer"))
def sort_rows(spark, folder):
    return O.sort_by(view(spark, folder, "dirty_customer"), "segment", descending=True)


@register("top_n", over("dirty_orders", "SELECT * FROM dirty_orders ORDER BY price DESC NULLS LAST, _rid LIMIT 5"))
def top_n(spark, folder):
    return O.top_n(view(spark, folder, "dirty_orders"), "price")


@register("bottom_n", over("dirty_orders", "SELECT * FROM dirty_orders ORDER BY price NULLS LAST, _rid LIMIT 7"))
def bottom_n(spark, folder):
    return O.top_n(view(spark, folder, "dirty_orders"), "price", 7, smallest=True)


@register(
    "top_n_text_number",
    over(
        "dirty_customer",
        f"SELECT * FROM dirty_customer ORDER BY {sql_number('balance_text')} DESC NULLS LAST, _rid LIMIT 5",
    ),
)
def top_n_text_number(spark, folder):
    return O.top_n(view(spark, folder, "dirty_customer"), "balance_text")


@register("head_n", over("dirty_orders", "SELECT * FROM dirty_orders ORDER BY _rid LIMIT 5"))
def head_n(spark, folder):
    return O.top_n(view(spark, folder, "dirty_orders"), "priority")


# Rows


@register(
    "append_row",
    over("dirty_orders", "SELECT * FROM dirty_orders UNION ALL SELECT (SELECT max(_rid) + 1 FROM dirty_orders), 7, '1-URGENT', NULL, 1234.5, NULL"),
)
def append_row(spark, folder):
    values = {"custkey": "7", "priority": "1-URGENT", "price": "$1,234.5", "no such column": "x"}
    return H.append_row(view(spark, folder, "dirty_orders"), values)


_BATCH = "SELECT _rid, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, segment, balance_text AS balance FROM dirty_customer"


def _batch(spark, folder):
    customers = view(spark, folder, "dirty_customer")
    rows = customers.select(
        F.col("_rid").cast("string").alias("_rid"),
        "c_name",
        F.col("c_nationkey").cast("string").alias("c_nationkey"),
        "segment",
        F.col("balance_text").alias("balance"),
    )
    return customers, rows


@register(
    "append_rows",
    over(
        "dirty_customer",
        f"""SELECT * FROM dirty_customer UNION ALL
            SELECT _rid, c_name, CAST(c_nationkey AS INTEGER), segment, {sql_number('balance')}, NULL
            FROM ({_BATCH}) WHERE {sql_number('balance')} IS NOT NULL""",
    ),
)
def append_rows(spark, folder):
    return H.append_rows(*_batch(spark, folder))


@register(
    "append_rows_rejected",
    over(
        "dirty_customer",
        f"""SELECT CAST(_rid AS VARCHAR) AS _rid, c_name, c_nationkey, segment, balance
            FROM ({_BATCH}) WHERE {sql_number('balance')} IS NULL""",
    ),
)
def append_rows_rejected(spark, folder):
    return H.split_rows(*_batch(spark, folder))[1]


_TYPED = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '3.7' WHEN o_orderkey % 5 = 1 THEN '4.0'
    WHEN o_orderkey % 5 = 2 THEN '9007199254740993' ELSE CAST(o_custkey AS STRING) END AS o_custkey,
    CASE WHEN o_orderkey % 7 = 0 THEN 'not a date' ELSE '1995-03-04 00:00:00' END AS o_orderdate FROM {orders}"""


def _typed_batch(spark, folder):
    orders = table(spark, folder, "orders")
    batch = spark.sql(_TYPED, orders=orders)
    return orders, batch.select(*[F.col(c).cast("string").alias(c) for c in batch.columns])


_TYPED_SQL = _TYPED.replace("{orders}", "orders").replace("AS STRING", "AS VARCHAR")


@register(
    "append_rows_rejected_types",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_custkey, o_orderdate FROM ({_TYPED_SQL})
        WHERE o_custkey = '3.7' OR o_orderdate = 'not a date'""",
)
def append_rows_rejected_types(spark, folder):
    return H.split_rows(*_typed_batch(spark, folder))[1]


@register(
    "append_rows_types",
    f"""SELECT o_orderkey, o_custkey FROM orders UNION ALL
        SELECT o_orderkey, CAST(CASE WHEN o_custkey = '4.0' THEN '4' ELSE o_custkey END AS BIGINT) FROM ({_TYPED_SQL})
        WHERE o_custkey <> '3.7' AND o_orderdate <> 'not a date'""",
)
def append_rows_types(spark, folder):
    return H.append_rows(*_typed_batch(spark, folder)).select("o_orderkey", "o_custkey")


_FULL_ROW = {"custkey": 7, "priority": "1-URGENT", "status": "O", "price": 10, "price_null_group": 11}


@register(
    "drop_null_rows_after_append",
    over(
        "dirty_orders",
        """SELECT * FROM dirty_orders WHERE custkey IS NOT NULL AND priority IS NOT NULL AND status IS NOT NULL AND price IS NOT NULL
             AND price_null_group IS NOT NULL
           UNION ALL SELECT (SELECT max(_rid) + 1 FROM dirty_orders), 7, '1-URGENT', 'O', 10, 11""",
    ),
)
def drop_null_rows_after_append(spark, folder):
    return drop_null_rows(H.append_row(view(spark, folder, "dirty_orders"), _FULL_ROW))


@register(
    "append_then_diff",
    over(
        "base_orders",
        """SELECT CAST(1 AS BIGINT) AS rows_added, CAST(0 AS BIGINT) AS rows_removed, CAST(1 AS BIGINT) AS net_rows, 0 AS columns_added,
             0 AS columns_removed, CAST(0 AS BIGINT) AS modified_cells, count(*) + 1 AS total_rows_after, 4 AS total_columns_after
           FROM base_orders""",
    ),
)
def append_then_diff(spark, folder):
    orders = view(spark, folder, "base_orders")
    return table_diff(orders, H.append_row(orders, {"custkey": 3, "status": "O"}))


_TWICE = "(SELECT _rid, custkey, status FROM base_orders UNION ALL SELECT _rid + 1000000000, custkey, status FROM base_orders)"


@register(
    "drop_duplicates_with_ids",
    over("base_orders", f"SELECT min(_rid) AS _rid, custkey, status FROM {_TWICE} GROUP BY custkey, status"),
)
def drop_duplicates_with_ids(spark, folder):
    orders = view(spark, folder, "base_orders").select("_rid", "custkey", "status")
    return H.drop_duplicates(orders.unionByName(orders.withColumn("_rid", F.col("_rid") + 1000000000)))


@register("drop_duplicates", over("dup_orders", "SELECT DISTINCT * FROM dup_orders"))
def drop_duplicates(spark, folder):
    return H.drop_duplicates(view(spark, folder, "dup_orders"))
