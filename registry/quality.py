"""Profile and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import insights as J
from quillgrid.operators import profile as P
from registry.base import over, register, table, view

_COLUMNS = ["custkey", "priority", "status", "price", "price_null_group"]


def _nulls_sql(extra=""):
    parts = [
        f"""SELECT '{c}' AS "column", {i} AS ordinal, count(*) - count({c}) AS nulls, count(*) AS "rows",
            round_even(CAST(count(*) - count({c}) AS DOUBLE) / greatest(count(*), 1) * 100, 2) AS null_pct FROM dirty_orders"""
        for i, c in enumerate(_COLUMNS)
    ]
    return " UNION ALL ".join(parts)


@register("null_counts", over("dirty_orders", f'SELECT "column", nulls FROM ({_nulls_sql()})'))
def null_counts(spark, folder):
    return P.null_counts(view(spark, folder, "dirty_orders")).select("column", "nulls")


@register("null_percentages", over("dirty_orders", f'SELECT "column", null_pct FROM ({_nulls_sql()})'))
def null_percentages(spark, folder):
    return P.null_counts(view(spark, folder, "dirty_orders")).select("column", "null_pct")


def _skew(c):
    return (
        f"CASE WHEN count({c}) < 3 THEN NULL WHEN min({c}) = max({c}) THEN 0 ELSE round_even(skewness({c}), 2) + 0.0 END"
    )


_SKEW = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "flat"]
_FLAT = "(SELECT *, CAST(1 AS DOUBLE) AS flat FROM lineitem)"


@register(
    "skewness",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({_skew(c)} AS DOUBLE) AS skewness FROM {_FLAT}" for c in _SKEW),
)
def skewness(spark, folder):
    return P.skewness(table(spark, folder, "lineitem").withColumn("flat", F.lit(1.0)), _SKEW)


_MISSING = " + ".join(f"(count(*) - count({c}))" for c in _COLUMNS)
_SCORE = f"round_even(greatest(0.0, 100 - CAST({_MISSING} AS DOUBLE) / greatest(count(*) * 5, 1) * 100), 1)"


@register(
    "hygiene_score",
    over(
        "dirty_orders",
        f"""SELECT count(*) * 5 AS cells, CAST({_MISSING} AS BIGINT) AS missing_cells, {_SCORE} AS hygiene_score FROM dirty_orders""",
    ),
)
def hygiene_score(spark, folder):
    return P.hygiene_score(view(spark, folder, "dirty_orders"))


@register(
    "duplicate_rows",
    over("dup_orders", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_orders)) AS duplicate_rows FROM dup_orders"),
)
def duplicate_rows(spark, folder):
    return P.duplicate_rows(view(spark, folder, "dup_orders"))


_TYPES = {"custkey": "int64", "priority": "object", "status": "object", "price": "float64", "price_null_group": "float64"}


def _profile_sql():
    parts = []
    for c in _COLUMNS:
        skew = _skew(c) if _TYPES[c] != "object" else "NULL"
        parts.append(
            f"""SELECT '{c}' AS "column", '{_TYPES[c]}' AS type, count(*) - count({c}) AS nulls, CAST({skew} AS DOUBLE) AS skewness,
            round_even(CAST(count(*) - count({c}) AS DOUBLE) / greatest(count(*), 1) * 100, 2) AS null_pct, count(*) AS total_rows,
            5 AS total_columns, CAST({_MISSING} AS BIGINT) AS missing_cells, {_SCORE} AS hygiene_score,
            count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (_rid) FROM dirty_orders)) AS duplicate_rows
            FROM dirty_orders"""
        )
    return over("dirty_orders", " UNION ALL ".join(parts))


@register("table_profile", _profile_sql())
def table_profile(spark, folder):
    return P.table_profile(view(spark, folder, "dirty_orders"))


@register(
    "most_missing_column",
    over(
        "dirty_orders",
        f"""WITH n AS ({_nulls_sql()}) SELECT (SELECT count(*) FROM n WHERE null_pct > 0) AS columns_with_nulls, "column", null_pct
            FROM n ORDER BY null_pct DESC, ordinal LIMIT 1""",
    ),
)
def most_missing_column(spark, folder):
    return J.most_missing_column(view(spark, folder, "dirty_orders"))


_CANDIDATES = """SELECT "column", ordinal, u AS distinct_values FROM (
    SELECT 'c_name' AS "column", 0 AS ordinal, count(DISTINCT c_name) AS u, count(*) AS n FROM dirty_customer
    UNION ALL SELECT 'segment', 1, count(DISTINCT segment), count(*) FROM dirty_customer
    UNION ALL SELECT 'balance_text', 2, count(DISTINCT balance_text), count(*) FROM dirty_customer)
    WHERE u <= greatest(20, n * 0.7) AND u > 1 AND u < greatest(2, n)"""


@register("category_candidates", over("dirty_customer", _CANDIDATES))
def category_candidates(spark, folder):
    return J.category_candidates(view(spark, folder, "dirty_customer"))


@register(
    "dominant_category",
    over(
        "dirty_customer",
        """SELECT 'segment' AS "column", segment AS value, count(*) AS freq,
           round_even(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM dirty_customer) * 100, 1) AS share_pct
           FROM dirty_customer WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1""",
    ),
)
def dominant_category(spark, folder):
    return J.dominant_category(view(spark, folder, "dirty_customer"))


@register(
    "numeric_headline",
    over(
        "dirty_orders",
        f"""SELECT 'price' AS "column", mean, std, skewness, CASE WHEN skewness > 1 THEN 'strongly right-skewed'
            WHEN skewness < -1 THEN 'strongly left-skewed' ELSE 'symmetrical' END AS shape FROM (
            SELECT round_even(avg(price), 2) AS mean, round_even(stddev_samp(price), 2) AS std,
            CAST({_skew('price')} AS DOUBLE) AS skewness FROM dirty_orders)""",
    ),
)
def numeric_headline(spark, folder):
    return J.numeric_headline(view(spark, folder, "dirty_orders"), "price")


_NUMBERS = ["custkey", "price", "price_null_group"]
_FENCES = ", ".join(
    f"""quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_low,
        quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_high"""
    for c in _NUMBERS
)
_OUT = {c: f"({c} < {c}_low OR {c} > {c}_high)" for c in _NUMBERS}
_COUNTS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, count(*) FILTER (WHERE {_OUT[c]}) AS outliers FROM dirty_orders, f"
    for i, c in enumerate(_NUMBERS)
)


@register(
    "iqr_outlier_counts",
    over("dirty_orders", f"WITH f AS (SELECT {_FENCES} FROM dirty_orders) SELECT * FROM ({_COUNTS}) WHERE outliers > 0"),
)
def iqr_outlier_counts(spark, folder):
    return J.iqr_outlier_counts(view(spark, folder, "dirty_orders"))


@register(
    "iqr_outlier_rows",
    over(
        "dirty_orders",
        f"WITH f AS (SELECT {_FENCES} FROM dirty_orders) SELECT dirty_orders.* FROM dirty_orders, f WHERE {' OR '.join(_OUT.values())}",
    ),
)
def iqr_outlier_rows(spark, folder):
    return J.iqr_outlier_rows(view(spark, folder, "dirty_orders"))


@register(
    "top3_outlier_columns",
    over(
        "dirty_orders",
        f"""WITH f AS (SELECT {_FENCES} FROM dirty_orders) SELECT * FROM ({_COUNTS}) WHERE outliers > 0
            ORDER BY outliers DESC, ordinal LIMIT 3""",
    ),
)
def top3_outlier_columns(spark, folder):
    return J.top_outlier_columns(view(spark, folder, "dirty_orders"))


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(
    "strongest_correlation",
    "SELECT col_a, col_b, round_even(abs(r), 2) AS abs_r, round_even(r, 2) AS r FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM lineitem"
        for i, a in enumerate(_LINE)
        for b in _LINE[i + 1 :]
    )
    + ") ORDER BY abs(r) DESC LIMIT 1",
)
def strongest_correlation(spark, folder):
    return J.strongest_correlation(table(spark, folder, "lineitem"), _LINE)


_TOP = """(SELECT priority, count(*) AS n, round_even(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM dirty_orders) * 100, 1) AS share
           FROM dirty_orders WHERE priority IS NOT NULL GROUP BY priority ORDER BY n DESC, priority LIMIT 1)"""
_INSIGHTS = f"""
WITH n AS ({_nulls_sql()}), f AS (SELECT {_FENCES} FROM dirty_orders), o AS (SELECT * FROM ({_COUNTS}) WHERE outliers > 0),
s AS (SELECT {_SCORE} AS score, count(*) AS total FROM dirty_orders),
worst AS (SELECT "column", null_pct, (SELECT count(*) FROM n WHERE null_pct > 0) AS gaps FROM n ORDER BY null_pct DESC, ordinal LIMIT 1),
head AS (SELECT round_even(avg(custkey), 2) AS m, round_even(stddev_samp(custkey), 2) AS d, CAST({_skew('custkey')} AS DOUBLE) AS k FROM dirty_orders),
r AS (SELECT * FROM (SELECT 'custkey' AS a, 'price' AS b, corr(custkey, price) AS r FROM dirty_orders
      UNION ALL SELECT 'custkey', 'price_null_group', corr(custkey, price_null_group) FROM dirty_orders
      UNION ALL SELECT 'price', 'price_null_group', corr(price, price_null_group) FROM dirty_orders) ORDER BY abs(r) DESC LIMIT 1)
SELECT 1 AS rank, 'overview' AS kind, CAST(NULL AS VARCHAR) AS "column", score AS value,
  format('{{:,}}', total) || ' rows, 5 columns, ' || score || '% of cells filled' AS text FROM s
UNION ALL SELECT 2, 'missing', "column", null_pct, gaps || ' columns have gaps, most in ' || "column" || ' (' || null_pct || '%)' FROM worst
UNION ALL SELECT 3, 'category', 'priority', share, 'priority is mostly ' || priority || ': ' || format('{{:,}}', n) || ' rows (' || share || '%)' FROM {_TOP}
UNION ALL SELECT 4, 'distribution', 'custkey', m, 'custkey averages ' || m || ' (std ' || d || '), ' ||
  CASE WHEN k > 1 THEN 'strongly right-skewed' WHEN k < -1 THEN 'strongly left-skewed' ELSE 'symmetrical' END || ' (skewness ' || k || ')' FROM head
UNION ALL SELECT 5, 'outliers', "column", CAST(outliers AS DOUBLE),
  "column" || ' has ' || format('{{:,}}', outliers) || ' values outside the interquartile fences' FROM (SELECT * FROM o ORDER BY outliers DESC, ordinal LIMIT 3)
UNION ALL SELECT 6, 'correlation', a || ' ~ ' || b, round_even(r, 2), a || ' and ' || b || ' move together most (r = ' || round_even(r, 2) || ')' FROM r"""


@register(
    "table_profile_underscore",
    """WITH t AS (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS d FROM orders)
       SELECT c AS "column", k AS type, CASE WHEN c = '_score' THEN n ELSE 0 END AS nulls, CAST(NULL AS DOUBLE) AS skewness,
         CASE WHEN c = '_score' THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS null_pct, n AS total_rows, 2 AS total_columns,
         n AS missing_cells, CAST(50 AS DOUBLE) AS hygiene_score, n - d AS duplicate_rows
       FROM t, (VALUES ('o_orderstatus', 'object'), ('_score', 'float64')) v(c, k)""",
)
def table_profile_underscore(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderstatus", F.lit(None).cast("double").alias("_score"))
    return P.table_profile(orders)


@register("insight_table", over("dirty_orders", _INSIGHTS))
def insight_table(spark, folder):
    return J.insight_table(view(spark, folder, "dirty_orders"))
