"""Automatic findings about a table, as rows instead of sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.values import any_of, data_columns, numeric_columns, other_columns
from quillgrid.operators.aggregates import correlations
from quillgrid.operators.profile import null_counts, skew
from quillgrid.operators.quantiles import exact_quantiles, long_form

# Name parts that mark an identifier, and the limits used below.
IDENTIFIER_PARTS = {"id", "uuid", "key", "identifier"}
SKEW_LIMIT = 1.0
IQR_FACTOR = 1.5


def most_missing_column(df: DataFrame) -> DataFrame:
    """One row: columns with nulls, and the worst one (first on a tie)."""
    per_column = null_counts(df)
    return per_column.groupBy().agg(
        F.count_if(F.col("null_pct") > 0).alias("columns_with_nulls"),
        F.min_by("column", F.struct(-F.col("null_pct"), F.col("ordinal"))).alias("column"),
        F.max("null_pct").alias("null_pct"),
    )


def _not_an_id(name: str) -> bool:
    parts = re.split(r"[^a-z0-9]+", name.lower())
    return not IDENTIFIER_PARTS.intersection(parts)


def category_candidates(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Text columns worth reporting on, in table order, with their distinct count.

    Out: identifier-like names, nearly unique columns, and constant columns.
    Distinct counts of all columns come from one grouped count of the distinct
    (column, value) pairs, which is spread by value.
    """
    found = _categories(df, columns, approx)
    if found is None:
        return df.sparkSession.createDataFrame([], "column string, ordinal int, distinct_values long")
    return found.select("column", "ordinal", "distinct_values")


def _categories(df: DataFrame, columns: list[str] | None, approx: bool = False) -> DataFrame | None:
    """``column, ordinal, distinct_values, rows, best``: the candidates, and (not ``approx``) their
    most frequent value with minus its count; one pass over all columns."""
    names = [c for c in (columns or other_columns(df)) if _not_an_id(c)]
    if not names:
        return None
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("column"), F.lit(i).alias("ordinal"), F.col(f"`{n}`").cast("string").alias("v"))
            for i, n in enumerate(names)
        ]
    )
    long = df.select(F.explode(cells).alias("_c")).select("_c.*")
    if approx:
        found = long.groupBy("column", "ordinal").agg(F.approx_count_distinct("v").alias("distinct_values"), F.count("*").alias("rows"))
    else:
        pairs = long.groupBy("column", "ordinal", "v").agg(F.count("*").alias("_n"))
        best = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("v").alias("v"))))
        found = pairs.groupBy("column", "ordinal").agg(F.count("v").alias("distinct_values"), F.sum("_n").alias("rows"), best.alias("best"))
    u, rows = F.col("distinct_values"), F.col("rows")
    return found.where((u <= F.greatest(F.lit(20.0), rows * 0.7)) & (u > 1) & (u < F.greatest(F.lit(2), rows)))


def dominant_category(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: the most common value of the first category column and its share."""
    found = _categories(df, columns)
    if found is None:
        return df.sparkSession.createDataFrame([], "column string, value string, freq long, share_pct double")
    freq = -F.col("best.n")
    return found.orderBy("ordinal").limit(1).select(
        "column",
        F.col("best.v").alias("value"),
        freq.alias("freq"),
        F.bround(freq / F.greatest("rows", F.lit(1)) * 100, 1).alias("share_pct"),
    )


def numeric_headline(df: DataFrame, column: str | None = None) -> DataFrame:
    """One row: mean, spread and shape of the first numeric column."""
    name = column or numeric_columns(df)[0]
    c = F.col(f"`{name}`").cast("double")
    return df.agg(
        F.bround(F.avg(c), 2).alias("mean"),
        F.bround(F.stddev_samp(c), 2).alias("std"),
        F.bround(skew(c), 2).alias("skewness"),
    ).select(F.lit(name).alias("column"), "mean", "std", "skewness", _shape(F.col("skewness")).alias("shape"))


# The names of shapes.
RIGHT, LEFT, EVEN = "strongly right-skewed", "strongly left-skewed", "symmetrical"


def _shape(s: Column) -> Column:
    return F.when(s > SKEW_LIMIT, RIGHT).when(s < -SKEW_LIMIT, LEFT).otherwise(EVEN)


def iqr_bounds(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column the fences of the interquartile rule (exact quartiles).

    Columns with fewer than four values or no spread have no fences.
    """
    columns = columns or numeric_columns(df)
    long = long_form(df, [], {c: F.col(f"`{c}`") for c in columns})
    q1, q3 = F.col("quantiles")[0], F.col("quantiles")[1]
    return (
        exact_quantiles(long, ["column"], [0.25, 0.75])
        .where((F.col("n") >= 4) & (q3 > q1))
        .select("column", (q1 - IQR_FACTOR * (q3 - q1)).alias("low"), (q3 + IQR_FACTOR * (q3 - q1)).alias("high"))
    )


def _fences(df: DataFrame, columns: list[str] | None) -> dict[str, tuple[float, float]]:
    """The fences as numbers: at most one row per numeric column."""
    return {r["column"]: (r["low"], r["high"]) for r in iqr_bounds(df, columns).collect()}


def iqr_outlier_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column the number of values outside the fences (only where any)."""
    fences = _fences(df, columns)
    if not fences:
        return df.sparkSession.createDataFrame([], "column string, ordinal int, outliers long")
    order = {c: i for i, c in enumerate(columns or numeric_columns(df))}
    one = df.agg(*[F.count_if(_outside(c, *b)).alias(c) for c, b in fences.items()])
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(order[c]).alias("ordinal"), F.col(f"`{c}`").alias("outliers"))
        for c in fences
    ]
    return one.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*").where("outliers > 0")


def _outside(name: str, low: float, high: float):
    c = F.col(f"`{name}`")
    return (c < low) | (c > high)


def iqr_outlier_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows with at least one value outside its column's fences."""
    fences = _fences(df, columns)
    return df.where(any_of([F.lit(False)] + [_outside(c, *b) for c, b in fences.items()]))


def top_outlier_columns(df: DataFrame, columns: list[str] | None = None, n: int = 3) -> DataFrame:
    """The columns with most outliers, in table order on a tie."""
    return iqr_outlier_counts(df, columns).orderBy(F.col("outliers").desc(), "ordinal").limit(n)


def strongest_correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: the pair of columns with the largest absolute correlation."""
    columns = columns or numeric_columns(df)
    order = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    pairs = correlations(df, columns, digits=None).where(
        F.try_element_at(order, F.col("col_a")) < F.try_element_at(order, F.col("col_b"))
    )
    strength = F.abs("r")
    return (
        pairs.where(F.col("r").isNotNull())
        .orderBy(strength.desc(), F.try_element_at(order, F.col("col_a")), F.try_element_at(order, F.col("col_b")))
        .limit(1)
        .select("col_a", "col_b", F.bround(strength, 2).alias("abs_r"), F.bround("r", 2).alias("r"))
    )


def _overview(df: DataFrame, numbers: list[str], names: list[str]) -> DataFrame:
    """The findings that one aggregate over the table gives: overview, gaps, and the first numeric column."""
    n = max(len(names), 1)
    first = F.col(f"`{numbers[0]}`").cast("double") if numbers else F.lit(None).cast("double")
    one = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(names)],
        F.avg(first).alias("mean"), F.stddev_samp(first).alias("std"), skew(first).alias("skewness"),
    )
    rows = F.greatest(F.col("rows"), F.lit(1))
    percent = [F.bround(F.col(f"n{i}") / rows * 100, 2) for i in range(len(names))]
    missing = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0))
    share = missing / F.greatest(F.col("rows") * n, F.lit(1)) * 100
    worst = F.array_min(F.array(*[F.struct(-p, F.lit(i), F.lit(c)) for i, (p, c) in enumerate(zip(percent, names))]))
    one = one.select(
        "*",
        F.bround(F.greatest(F.lit(0.0), 100 - share), 1).alias("score"),
        sum(((p > 0).cast("long") for p in percent), F.lit(0).cast("long")).alias("with_gaps"),
        (-worst["col1"]).alias("worst_pct"), worst["col3"].alias("worst"),
    ).withColumns({c: F.bround(c, 2) for c in ("mean", "std", "skewness")})
    gaps = F.col("worst_pct") > 0
    found = [
        _finding(
            1, "overview", F.lit(None), F.col("score"),
            F.format_string("%,d rows, %d columns, %s%% of cells filled", "rows", F.lit(len(names)), "score"),
        ),
        _finding(
            2, "missing", F.when(gaps, F.col("worst")), F.col("worst_pct"),
            F.when(gaps, F.format_string("%d columns have gaps, most in %s (%s%%)", "with_gaps", "worst", "worst_pct")).otherwise("no missing cells"),
        ),
    ]
    if numbers:
        found.append(
            _finding(
                4, "distribution", F.lit(numbers[0]), F.col("mean"),
                F.format_string("%s averages %s (std %s), %s (skewness %s)", F.lit(numbers[0]), "mean", "std", _shape(F.col("skewness")), "skewness"),
            )
        )
    return one.select(F.explode(F.array(*found)).alias("_f")).select("_f.*")


def _finding(rank: int, kind: str, column: Column, value: Column, text: Column) -> Column:
    return F.struct(
        F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), column.cast("string").alias("column"),
        value.cast("double").alias("value"), text.alias("text"),
    )


def insight_table(df: DataFrame) -> DataFrame:
    """All findings in reading order: ``(rank, kind, column, value, text)``.

    One aggregate gives the overview, the gaps and the first numeric column, one
    count of values the category, one pass the correlations; the quartile rule
    needs three.
    """
    numbers, others = numeric_columns(df), other_columns(df)
    out = _overview(df, numbers, data_columns(df))
    add = lambda found, *finding: out.unionByName(found.select(_finding(*finding).alias("_f")).select("_f.*"))
    if others:
        out = add(
            dominant_category(df), 3, "category", F.col("column"), F.col("share_pct"),
            F.format_string("%s is mostly %s: %,d rows (%s%%)", "column", "value", "freq", "share_pct"),
        )
    if numbers:
        out = add(
            top_outlier_columns(df), 5, "outliers", F.col("column"), F.col("outliers"),
            F.format_string("%s has %,d values outside the interquartile fences", "column", "outliers"),
        )
    if len(numbers) >= 2:
        out = add(
            strongest_correlation(df), 6, "correlation", F.concat_ws(" ~ ", "col_a", "col_b"), F.col("r"),
            F.format_string("%s and %s move together most (r = %s)", "col_a", "col_b", "r"),
        )
    return out
