"""Cleaning, imputation, encoding, outliers, versions, steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import cleaning as I
from quillgrid.operators import columns as C
from quillgrid.operators import diff as L
from quillgrid.operators import encode as K
from quillgrid.operators.aggregates import group_agg
from quillgrid.operators.filters import Condition
from quillgrid.operators.impute import impute_knn, impute_median, impute_mice, impute_mode
from quillgrid.operators.joins import join_tables
from quillgrid.operators.ordering import top_n
from quillgrid.operators.outliers import isolation_outliers
from quillgrid.plans.steps import run_steps
from quillgrid.session import scratch_path
from quillgrid.sources.versions import VersionedTable
from registry.base import over, register, sql_strip, table, view

# Cleaning


def _normal(c: str) -> str:
    return f"CASE WHEN {sql_strip(c)} NOT IN ('nan', 'None', '') THEN {sql_strip(c)} END"


@register(
    "normalize_text",
    over(
        "dirty_customer",
        f"""SELECT * REPLACE ({_normal('c_name')} AS c_name, {_normal('segment')} AS segment, {_normal('balance_text')} AS balance_text)
            FROM dirty_customer""",
    ),
)
def normalize_text(spark, folder):
    return I.normalize_text(view(spark, folder, "dirty_customer"))


@register(
    "value_counts",
    over("dirty_customer", 'SELECT segment AS value, count(*) AS "count" FROM dirty_customer WHERE segment IS NOT NULL GROUP BY segment'),
)
def value_counts(spark, folder):
    return I.value_counts(view(spark, folder, "dirty_customer"), "segment")


def _fuzzy(source: str, column: str, tag: str = "") -> str:
    """CTEs ending in ``fix(value, canonical)``, all names with a tag behind them."""
    return f"""counts{tag} AS (SELECT {column} AS value, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY {column}),
    near{tag} AS (SELECT a.value, b.value AS other, b.n, 100.0 * (1.0 - levenshtein(a.value, b.value) /
               CAST(greatest(length(a.value), length(b.value)) AS DOUBLE)) AS s
             FROM counts{tag} a, counts{tag} b WHERE length(a.value) >= 3
             AND levenshtein(a.value, b.value) * 100 <= 20 * greatest(length(a.value), length(b.value))),
    top{tag} AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY s DESC, n DESC, other) AS r FROM near{tag}),
    pick{tag} AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY n DESC, length(other) DESC, s DESC, other) AS q FROM top{tag} WHERE r <= 5),
    fix{tag} AS (SELECT value, other AS canonical FROM pick{tag} WHERE q = 1 AND other <> value)"""


_TYPO_PARTS = """typo_parts AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 9 = 4 THEN replace(p_name, 'l', '')
    WHEN p_partkey % 11 = 5 THEN concat(p_name, 's') ELSE p_name END AS name FROM part)"""


@register(
    "fuzzy_canonicalize",
    over(
        "dirty_customer",
        f"""WITH {_fuzzy('dirty_customer', 'segment')}
            SELECT * REPLACE (coalesce(canonical, segment) AS segment) FROM
            (SELECT d.*, fix.canonical FROM dirty_customer d LEFT JOIN fix ON d.segment = fix.value)""",
    ).replace("SELECT * REPLACE (coalesce(canonical, segment) AS segment) FROM", "SELECT * EXCLUDE (canonical) REPLACE (coalesce(canonical, segment) AS segment) FROM"),
)
def fuzzy_canonicalize(spark, folder):
    return I.fuzzy_canonicalize(view(spark, folder, "dirty_customer"), ["segment"])


@register(
    "fuzzy_canonicalize_parts",
    f"""WITH {_TYPO_PARTS}, {_fuzzy('typo_parts', 'name')}
        SELECT p_partkey, p_type, coalesce(canonical, name) AS name FROM typo_parts LEFT JOIN fix ON name = value""",
)
def fuzzy_canonicalize_parts(spark, folder):
    name = F.col("p_name")
    typo = (
        F.when(F.col("p_partkey") % 9 == 4, F.replace(name, F.lit("l"), F.lit("")))
        .when(F.col("p_partkey") % 11 == 5, F.concat(name, F.lit("s")))
        .otherwise(name)
    )
    parts = table(spark, folder, "part").select("p_partkey", "p_type", typo.alias("name"))
    return I.fuzzy_canonicalize(parts, ["name"])


_TEXTS = ["c_name", "segment", "balance_text"]


@register(
    "clean_table",
    over(
        "dirty_customer",
        f"""WITH normal AS (SELECT _rid, c_nationkey, balance, {", ".join(f"{_normal(c)} AS {c}" for c in _TEXTS)} FROM dirty_customer),
            {", ".join(_fuzzy("normal", c, f"_{c}") for c in _TEXTS)}
            SELECT min(_rid) AS _rid, {", ".join(f"coalesce(fix_{c}.canonical, normal.{c}) AS {c}" for c in _TEXTS)}, c_nationkey, balance
            FROM normal {" ".join(f"LEFT JOIN fix_{c} ON fix_{c}.value = normal.{c}" for c in _TEXTS)} GROUP BY ALL""",
    ),
)
def clean_table(spark, folder):
    """All six columns; spelling is repaired in the three of text."""
    messy = view(spark, folder, "dirty_customer")
    return I.clean_table(messy.withColumnsRenamed({"c_nationkey": "c_nationkey ", "segment": " segment"}))


@register(
    "clean_table_with_ids",
    over(
        "dirty_customer",
        f"""WITH twice AS (SELECT * FROM dirty_customer UNION ALL SELECT * REPLACE (_rid + 1000000000 AS _rid) FROM dirty_customer),
            normal AS (SELECT _rid, {_normal('c_name')} AS c_name, c_nationkey, {_normal('segment')} AS segment, balance,
                         {_normal('balance_text')} AS balance_text FROM twice),
            {_fuzzy('normal', 'segment')}
            SELECT min(_rid) AS _rid, c_name, c_nationkey, coalesce(canonical, segment) AS segment, balance, balance_text
            FROM normal LEFT JOIN fix ON segment = value GROUP BY ALL""",
    ),
)
def clean_table_with_ids(spark, folder):
    messy = view(spark, folder, "dirty_customer")
    return I.clean_table(messy.unionByName(messy.withColumn("_rid", F.col("_rid") + 1000000000)), ["segment"])


# Imputation


@register(
    "impute_median",
    over(
        "dirty_orders",
        """SELECT * REPLACE (coalesce(CAST(custkey AS DOUBLE), (SELECT quantile_cont(custkey, 0.5) FROM dirty_orders)) AS custkey,
             round_even(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM dirty_orders)), 4) AS price,
             round_even(coalesce(price_null_group, (SELECT quantile_cont(price_null_group, 0.5) FROM dirty_orders)), 4) AS price_null_group)
           FROM dirty_orders""",
    ),
)
def median_imputation(spark, folder):
    filled = impute_median(view(spark, folder, "dirty_orders"))
    return filled.withColumns({c: F.bround(c, 4) for c in ("price", "price_null_group")})


_MODE = "(SELECT {c} FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@register(
    "impute_mode",
    over(
        "dirty_orders",
        f"""SELECT * REPLACE (coalesce(priority, {_MODE.format(c='priority')}) AS priority), 'Unknown' AS nothing FROM dirty_orders""",
    ),
)
def mode_imputation(spark, folder):
    orders = view(spark, folder, "dirty_orders").withColumn("nothing", F.lit(None).cast("string"))
    return impute_mode(orders)


def _knn_sql(source, rid, cols):
    p = len(cols)
    squares = " + ".join(f"CASE WHEN r.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN (r.{c} - d.{c}) * (r.{c} - d.{c}) ELSE 0.0 END" for c in cols)
    shared = " + ".join(f"CASE WHEN r.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in cols)
    fills = ", ".join(
        f"""fill_{c} AS (SELECT id, avg(v) AS f FROM (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY dist, donor) AS k FROM (
              SELECT r.{rid} AS id, d.{rid} AS donor, d.{c} AS v, ({squares}) * (CAST({p} AS DOUBLE) / ({shared})) AS dist
              FROM n r, n d WHERE r.{c} IS NULL AND d.{c} IS NOT NULL AND ({shared}) > 0)) WHERE k <= 5 GROUP BY id)"""
        for c in cols
    )
    joins = " ".join(f"LEFT JOIN fill_{c} ON fill_{c}.id = n.{rid}" for c in cols)
    out = ", ".join(f"round_even(coalesce(n.{c}, fill_{c}.f, (SELECT avg({c}) FROM n)), 4) AS {c}" for c in cols)
    doubles = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return f"""WITH n AS (SELECT {rid}, {doubles} FROM {source}), {fills}
               SELECT n.{rid}, {out} FROM n {joins}"""


_ORDERS = ["custkey", "price", "price_null_group"]


@register("impute_knn", over("dirty_orders", _knn_sql("dirty_orders", "_rid", _ORDERS)))
def knn_imputation(spark, folder):
    """All numeric columns of the orders."""
    orders = view(spark, folder, "dirty_orders").select("_rid", *_ORDERS)
    return impute_knn(orders).withColumns({c: F.bround(c, 4) for c in _ORDERS})


@register("impute_knn_customers", over("dirty_customer", _knn_sql("dirty_customer", "_rid", ["c_nationkey", "balance"])))
def knn_imputation_customers(spark, folder):
    customers = view(spark, folder, "dirty_customer").select("_rid", "c_nationkey", "balance")
    filled = impute_knn(customers)
    return filled.withColumns({c: F.bround(c, 4) for c in ("c_nationkey", "balance")})


@register("impute_mice")
def mice_imputation(spark, folder):
    return impute_mice(view(spark, folder, "dirty_orders"))


_LINEAR = """SELECT o_orderkey AS _rid, CAST(o_custkey AS DOUBLE) AS a, o_orderkey % 97 AS b,
    CASE WHEN o_orderkey % 7 <> 3 THEN 2 * o_custkey - 3 * (o_orderkey % 97) + 5 END AS c FROM {orders}"""


@register(
    "impute_mice_linear",
    "SELECT o_orderkey AS _rid, CAST(2 * o_custkey - 3 * (o_orderkey % 97) + 5 AS DOUBLE) AS c FROM orders",
)
def mice_linear(spark, folder):
    """Gaps in a column that is a linear function of two others: the truth comes back."""
    filled = impute_mice(spark.sql(_LINEAR, orders=table(spark, folder, "orders")))
    return filled.select("_rid", F.bround("c", 2).alias("c"))


_EIGHT = [f"CASE WHEN l_orderkey % {7 + i} <> {i} THEN l_quantity * {i + 1} + l_discount * {100 + 7 * i} + l_tax * {50 - 3 * i} END AS v{i}" for i in range(8)]


@register("impute_mice_eight")
def mice_eight(spark, folder):
    """Eight columns with gaps."""
    lines = table(spark, folder, "lineitem")
    return impute_mice(lines.selectExpr("l_orderkey AS _rid", *_EIGHT))


# Encoding



@register(
    "encode_onehot",
    over(
        "dirty_orders",
        "SELECT _rid, custkey, price, "
        + ", ".join(
            f"CAST(coalesce(priority = '{v}', FALSE) AS INTEGER) AS \"priority_{v}\""
            for v in ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
        )
        + ", "
        + ", ".join(f"CAST(coalesce(status = '{v}', FALSE) AS INTEGER) AS status_{v}" for v in "OP")
        + " FROM dirty_orders",
    ),
)
def encode_onehot(spark, folder):
    return K.encode(view(spark, folder, "dirty_orders").drop("price_null_group"), "onehot")


_VALUES = "SELECT _rid, 'c_name' AS \"column\", c_name AS value FROM dirty_customer UNION ALL SELECT _rid, 'segment', segment FROM dirty_customer"


@register(
    "encode_onehot_wide",
    over(
        "dirty_customer",
        f"""WITH v AS (SELECT * FROM ({_VALUES}) WHERE value IS NOT NULL)
            SELECT * FROM (SELECT _rid, "column", value, dense_rank() OVER (PARTITION BY "column" ORDER BY value) - 1 AS place FROM v)
            WHERE place > 0""",
    ),
)
def encode_onehot_wide(spark, folder):
    return K.encode_onehot_long(view(spark, folder, "dirty_customer"), ["c_name", "segment"])


@register(
    "encode_label",
    over(
        "dirty_customer",
        """WITH d AS (SELECT *, coalesce(segment, 'nan') AS s FROM dirty_customer)
           SELECT _rid, c_nationkey, balance, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name,
             dense_rank() OVER (ORDER BY s) - 1 AS segment, dense_rank() OVER (ORDER BY balance_text) - 1 AS balance_text FROM d""",
    ),
)
def encode_label(spark, folder):
    return K.encode(view(spark, folder, "dirty_customer"), "label")


@register("isolation_outliers")
def outliers(spark, folder):
    return isolation_outliers(view(spark, folder, "dirty_orders"), "price")


@register("isolation_outliers_found", "SELECT TRUE AS share_near_contamination, TRUE AS all_extremes_flagged")
def outliers_found(spark, folder):
    """The share of flagged rows, and whether injected extremes are among them."""
    orders = view(spark, folder, "base_orders")
    extreme = orders.where("_rid % 1000 = 1").withColumn("_rid", -F.col("_rid") - 1).withColumn("price", F.col("price") + 1e9)
    flagged = isolation_outliers(orders.unionByName(extreme), "price")
    n, x = orders.agg(F.count("*")).scalar(), extreme.agg(F.count("*")).scalar()
    found = flagged.agg(F.count("*").alias("f"), F.count_if(F.col("_rid") < 0).alias("e"))
    return found.select(
        (F.col("f") <= 0.051 * (n + x)).alias("share_near_contamination"), (F.col("e") == x).alias("all_extremes_flagged")
    )


# Versions


_PAIRED = "base_orders a FULL JOIN edited_orders b ON a._rid = b._rid"
_CELLS = " + ".join(f"CAST(a.{c} IS DISTINCT FROM b.{c} AS INT)" for c in ("custkey", "status", "price"))


@register(
    "table_diff",
    over(
        "base_orders edited_orders",
        f"""SELECT count(*) FILTER (WHERE a._rid IS NULL) AS rows_added, count(*) FILTER (WHERE b._rid IS NULL) AS rows_removed,
              count(*) FILTER (WHERE a._rid IS NULL) - count(*) FILTER (WHERE b._rid IS NULL) AS net_rows,
              1 AS columns_added, 0 AS columns_removed,
              CAST(coalesce(sum(CASE WHEN a._rid IS NOT NULL AND b._rid IS NOT NULL THEN {_CELLS} END), 0) AS BIGINT) AS modified_cells,
              count(b._rid) AS total_rows_after, 5 AS total_columns_after FROM {_PAIRED}""",
    ),
)
def table_diff(spark, folder):
    edited = view(spark, folder, "edited_orders").withColumn("checked", F.lit(True))
    return L.table_diff(view(spark, folder, "base_orders"), edited)


@register(
    "table_diff_ranges",
    over(
        "base_orders edited_orders",
        f"""SELECT count(*) FILTER (WHERE a._rid IS NULL) AS rows_added, count(*) FILTER (WHERE b._rid IS NULL) AS rows_removed,
              count(*) FILTER (WHERE a._rid IS NULL) - count(*) FILTER (WHERE b._rid IS NULL) AS net_rows,
              1 AS columns_added, 0 AS columns_removed,
              CAST(coalesce(sum(CASE WHEN a._rid IS NOT NULL AND b._rid IS NOT NULL THEN {_CELLS} END), 0) AS BIGINT) AS modified_cells,
              count(b._rid) AS total_rows_after, 5 AS total_columns_after FROM {_PAIRED}""",
    ),
)
def table_diff_ranges(spark, folder):
    """Rows meet only in ranges of ids whose digests differ."""
    edited = view(spark, folder, "edited_orders").withColumn("checked", F.lit(True))
    return L.table_diff_ranges(view(spark, folder, "base_orders"), edited)


@register(
    "cell_changes",
    over(
        "base_orders edited_orders",
        """SELECT a._rid, 'status' AS "column", a.status AS old, b.status AS new FROM base_orders a JOIN edited_orders b ON a._rid = b._rid
             WHERE a.status IS DISTINCT FROM b.status
           UNION ALL SELECT a._rid, 'price', CAST(a.price AS VARCHAR), CAST(b.price AS VARCHAR)
             FROM base_orders a JOIN edited_orders b ON a._rid = b._rid WHERE a.price IS DISTINCT FROM b.price""",
    ),
)
def cell_changes(spark, folder):
    return L.cell_changes(view(spark, folder, "base_orders"), view(spark, folder, "edited_orders"))


def _versions(spark, folder):
    versions = VersionedTable(spark, scratch_path(spark, "versions"))
    versions.commit(view(spark, folder, "base_orders"), "first load", "INGEST")
    versions.commit(view(spark, folder, "edited_orders"), "edits", "UPDATE_VALUE")
    return versions


@register(
    "snapshot_commit",
    over("base_orders edited_orders", "SELECT * FROM edited_orders"),
)
def snapshot_commit(spark, folder):
    return _versions(spark, folder).current()


@register(
    "draft_confirm",
    over("base_orders edited_orders", "SELECT * FROM edited_orders"),
)
def draft_confirm(spark, folder):
    return _draft(spark, folder).confirm()


@register("draft_discard", over("base_orders", "SELECT * FROM base_orders"))
def draft_discard(spark, folder):
    return _draft(spark, folder).discard()


@register(
    "draft_diff",
    over(
        "base_orders edited_orders",
        f"""SELECT count(*) FILTER (WHERE a._rid IS NULL) AS rows_added, count(*) FILTER (WHERE b._rid IS NULL) AS rows_removed,
              CAST(coalesce(sum(CASE WHEN a._rid IS NOT NULL AND b._rid IS NOT NULL THEN {_CELLS} END), 0) AS BIGINT) AS modified_cells,
              CAST(1 AS BIGINT) AS active_version FROM {_PAIRED}""",
    ),
)
def draft_diff(spark, folder):
    return _draft(spark, folder).diff().select("rows_added", "rows_removed", "modified_cells", "active_version")


def _draft(spark, folder):
    versions = VersionedTable(spark, scratch_path(spark, "versions"))
    versions.commit(view(spark, folder, "base_orders"), "first", "INGEST")
    return versions.draft(view(spark, folder, "edited_orders"), "edited", "EDIT")


@register("rollback", over("base_orders", "SELECT * FROM base_orders"))
def rollback(spark, folder):
    versions = _versions(spark, folder)
    versions.rollback(7)
    return versions.undo()


@register(
    "history",
    over(
        "base_orders edited_orders",
        """SELECT CAST(0 AS BIGINT) AS "index", CAST(1 AS BIGINT) AS version, 'v1_initial' AS tag, 'INGEST' AS kind,
             (SELECT count(*) FROM base_orders) AS row_count, CAST(4 AS BIGINT) AS column_count, FALSE AS active
           UNION ALL SELECT 1, 3, 'v3_drop_col', 'DROP_COL', (SELECT count(*) FROM base_orders), 3, TRUE""",
    ),
)
def history(spark, folder):
    versions = _versions(spark, folder)
    first = versions.reset()
    versions.commit(C.drop_column(first, "price"), "no price", "DROP_COL")
    return versions.history().select("index", "version", "tag", "kind", "row_count", "column_count", "active")


# Steps


def _messy_sales(spark, folder):
    customers = view(spark, folder, "dirty_customer").withColumnRenamed("_rid", "customer")
    return join_tables(view(spark, folder, "dirty_orders"), customers, "custkey", "customer", "left")


@register(
    "chained_steps",
    over(
        "dirty_orders dirty_customer",
        f"""WITH sales AS (SELECT o._rid, o.price, {_normal('c.segment')} AS segment FROM dirty_orders o LEFT JOIN dirty_customer c ON o.custkey = c._rid),
            {_fuzzy('sales', 'segment')},
            clean AS (SELECT _rid, CASE WHEN price > 1000000 THEN NULL ELSE price END AS price, coalesce(canonical, segment) AS segment
                      FROM sales LEFT JOIN fix ON segment = value)
            SELECT segment, round_even(avg(price), 2) AS mean_price FROM clean GROUP BY segment
            ORDER BY mean_price DESC NULLS LAST, segment LIMIT 5""",
    ),
)
def chained_steps(spark, folder):
    outcome = run_steps(
        _messy_sales(spark, folder),
        [
            lambda t: I.normalize_text(t, ["segment"]),
            lambda t: I.fuzzy_canonicalize(t, ["segment"]),
            lambda t: C.update_where(t, "price", None, Condition("price", ">", 1_000_000)),
            lambda t: group_agg(t, "segment", "mean", "price"),
            lambda t: t.withColumn("mean_price", F.bround("mean_price", 2)),
            lambda t: top_n(t, "mean_price", 5, rid="segment"),
        ],
    )
    if outcome.failed_step:
        raise ValueError(outcome.message)
    return outcome.table


@register(
    "chained_steps_keep_input",
    over("dirty_orders", "SELECT * FROM dirty_orders"),
)
def chained_steps_keep_input(spark, folder):
    """The second step names a missing column: the input comes back unchanged."""
    steps = [lambda t: C.drop_column(t, "price"), lambda t: C.rename_column(t, "price", "cost")]
    return run_steps(view(spark, folder, "dirty_orders"), steps).table


@register("chained_steps_keep_input_at_run_time", over("dirty_orders", "SELECT *, CAST(2 AS INTEGER) AS failed_step FROM dirty_orders"))
def chained_steps_keep_input_at_run_time(spark, folder):
    """The second step fails on a value when it runs: the input comes back unchanged."""
    steps = [
        lambda t: C.drop_column(t, "price_null_group"),
        lambda t: t.withColumn("priority", F.col("priority").cast("int")),
        lambda t: C.drop_column(t, "price"),
    ]
    outcome = run_steps(view(spark, folder, "dirty_orders"), steps, run=True)
    return outcome.table.withColumn("failed_step", F.lit(outcome.failed_step))
