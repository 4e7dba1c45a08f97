"""Row filters."""

from __future__ import annotations

from quillgrid.operators import filters as C
from quillgrid.operators.filters import Condition
from registry.base import over, register, sql_number, sql_strip, table, view

_FOLDED = f"lower({sql_strip('segment')})"


def _filter(name, where, *conditions):
    def query(spark, folder):
        return C.filter_all(view(spark, folder, name), list(conditions))

    return over(name, f"SELECT * FROM {name} WHERE {where}"), query


def _add(key, name, where, *conditions):
    oracle, query = _filter(name, where, *conditions)
    register(key, oracle)(query)


for _key, _op in {"gt": ">", "ge": ">=", "lt": "<", "le": "<="}.items():
    _add(
        f"filter_{_key}",
        "dirty_orders",
        f"price {_op} 250000 AND custkey {_op} 700",
        Condition("price", _op, 250000),
        Condition("custkey", _op, 700),
    )
    _add(
        f"filter_{_key}_text_number",
        "dirty_customer",
        f"{sql_number('balance_text')} {_op} 5000",
        Condition("balance_text", _op, "5,000"),
    )
_add("filter_not_equal", "dirty_customer", f"{_FOLDED} IS DISTINCT FROM 'building'", Condition("segment", "!=", "Building"))
_add("filter_not_equal_number", "dirty_orders", "custkey IS DISTINCT FROM 40", Condition("custkey", "!=", 40.0))
_add("filter_text_exact", "dirty_customer", f"{_FOLDED} = 'furniture'", Condition("segment", "==", " Furniture", exact=True))
_add("filter_num_equal", "dirty_customer", f"{sql_number('balance_text')} = 4743", Condition("balance_text", "==", 4743))
_add("filter_num_equal_column", "dirty_orders", "custkey = 40", Condition("custkey", "==", 40))
_WORD = r"(^|[^\p{L}\p{N}_])building($|[^\p{L}\p{N}_])"
_add(
    "filter_text_contains",
    "dirty_customer",
    f"regexp_matches(lower(segment), '{_WORD}')",
    Condition("segment", "==", "Building"),
)
_add(
    "filter_text_contains_part",
    "dirty_customer",
    "contains(lower(segment), 'hold')",
    Condition("segment", "==", "hold"),
)
_add(
    "filter_conjunction",
    "dirty_orders",
    "price > 100000 AND price < 400000 AND lower(status) = 'f' AND lower(priority) IS DISTINCT FROM '5-low'",
    Condition("price", ">", 100000),
    Condition("price", "<", 400000),
    Condition("status", "==", "f", exact=True),
    Condition("priority", "!=", "5-LOW"),
)
_add("filter_no_condition", "dirty_orders", "TRUE")


@register("filter_between", over("dirty_orders", "SELECT * FROM dirty_orders WHERE price > 40000 AND price < 60000"))
def filter_between(spark, folder):
    return C.filter_between(view(spark, folder, "dirty_orders"), "price", 40000, 60000)


_BIG = "SELECT o_orderkey + 9007199254740992 AS id, o_custkey FROM {orders}"


@register("filter_big_id", f"SELECT * FROM ({_BIG.replace('{orders}', 'orders')}) WHERE id = 9007199254740993")
def filter_big_id(spark, folder):
    ids = spark.sql(_BIG, orders=table(spark, folder, "orders"))
    return C.filter_all(ids, [C.Condition("id", "==", 9007199254740993), C.Condition("id", "!=", "9007199254740992")])


@register("null_row_count", over("dirty_orders", "SELECT count(*) AS rows_dropped FROM dirty_orders WHERE custkey IS NULL OR priority IS NULL OR status IS NULL OR price IS NULL OR price_null_group IS NULL"))
def null_row_count(spark, folder):
    return C.null_row_count(view(spark, folder, "dirty_orders"))


@register("rows_null_in_column", over("dirty_orders", "SELECT * FROM dirty_orders WHERE price IS NULL"))
def rows_null_in_column(spark, folder):
    return C.rows_with_null(view(spark, folder, "dirty_orders"), "price")


_NULLS = "custkey IS NULL OR priority IS NULL OR status IS NULL OR price IS NULL OR price_null_group IS NULL"


@register("rows_null_any", over("dirty_orders", f"SELECT * FROM dirty_orders WHERE {_NULLS}"))
def rows_null_any(spark, folder):
    return C.rows_with_null(view(spark, folder, "dirty_orders"))


@register("drop_null_rows", over("dirty_orders", f"SELECT * FROM dirty_orders WHERE NOT ({_NULLS})"))
def drop_null_rows(spark, folder):
    return C.drop_null_rows(view(spark, folder, "dirty_orders"))


@register(
    "filter_by_value",
    over("dirty_orders", "SELECT * FROM dirty_orders WHERE lower(priority) = '2-high' AND lower(status) IS DISTINCT FROM 'f'"),
)
def filter_by_value(spark, folder):
    orders = view(spark, folder, "dirty_orders")
    return C.filter_by_value(C.filter_by_value(orders, "show 2-HIGH", ["priority"]), "show everything except F", ["status"])


@register("filter_by_value_word", "SELECT * FROM orders WHERE lower(o_orderpriority) = '4-not specified'")
def filter_by_value_word(spark, folder):
    orders = table(spark, folder, "orders")
    return C.filter_by_value(orders, "show the specified ones", ["o_orderpriority", "o_orderstatus"])
