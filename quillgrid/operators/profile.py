"""Data-quality profile of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.values import ROW_ID, data_columns, numeric_columns


def _explode(one_row: DataFrame, cells: list[Column]) -> DataFrame:
    return one_row.select("*", F.explode(F.array(*cells)).alias("_c"))


def null_counts(df: DataFrame, rid: str = ROW_ID) -> DataFrame:
    """Per column: position, nulls, rows and null percentage. One aggregate."""
    names = data_columns(df, rid)
    one = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(f"`{n}`").isNull()).alias(f"n{i}") for i, n in enumerate(names)],
    )
    cells = [
        F.struct(F.lit(n).alias("column"), F.lit(i).alias("ordinal"), F.col(f"n{i}").alias("nulls"))
        for i, n in enumerate(names)
    ]
    percent = F.bround(F.col("nulls") / F.greatest(F.col("rows"), F.lit(1)) * 100, 2)
    return _explode(one, cells).select("_c.*", "rows").withColumn("null_pct", percent)


def skew(col: Column) -> Column:
    """Bias-corrected sample skewness; 0 for a constant, null below 3 values."""
    n = F.count(col).cast("double")
    corrected = F.skewness(col) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n < 3, F.lit(None)).when(F.min(col) == F.max(col), F.lit(0.0)).otherwise(corrected)


def skewness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or numeric_columns(df)
    one = df.agg(*[skew(F.col(f"`{n}`").cast("double")).alias(f"s{i}") for i, n in enumerate(columns)])
    cells = [
        F.struct(F.lit(n).alias("column"), F.bround(F.col(f"s{i}"), 2).alias("skewness")) for i, n in enumerate(columns)
    ]
    return _explode(one, cells).select("_c.*")


def hygiene_score(df: DataFrame, rid: str = ROW_ID) -> DataFrame:
    """One row: cells, missing cells and the share of filled cells in percent."""
    names = data_columns(df, rid)
    nulls = sum((F.col(f"`{n}`").isNull().cast("long") for n in names), F.lit(0).cast("long"))
    one = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("missing_cells"))
    cells = F.col("rows") * max(len(names), 1)
    share = F.col("missing_cells") / F.greatest(cells, F.lit(1)) * 100
    return one.select(
        cells.alias("cells"),
        "missing_cells",
        F.bround(F.greatest(F.lit(0.0), 100 - share), 1).alias("hygiene_score"),
    )


def duplicate_rows(df: DataFrame, rid: str = ROW_ID) -> DataFrame:
    """One row: how many rows repeat an earlier one. Row ids are left out.

    Copies are counted on the map side, so a group of identical rows reaches
    its reducer as one row per task.
    """
    names = data_columns(df, rid)
    groups = df.groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.count("*").alias("_copies"))
    return groups.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"))


# Type names shown in a profile.
def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "int64"
    if isinstance(kind, T.NumericType):
        return "float64"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime64"
    return "object"


def table_profile(df: DataFrame, rid: str = ROW_ID) -> DataFrame:
    """One row per column with the table's totals repeated.

    Everything except the duplicate count comes from one aggregate over the
    table; the duplicate count needs the one shuffle of whole rows and is
    attached as a scalar subquery.
    """
    names = data_columns(df, rid)
    numbers = set(numeric_columns(df, rid))
    kinds = {f.name: type_name(f.dataType) for f in df.schema.fields}
    aggregates = [F.count("*").alias("total_rows")]
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        aggregates.append(F.count_if(c.isNull()).alias(f"n{i}"))
        if n in numbers:
            aggregates.append(skew(c.cast("double")).alias(f"s{i}"))
    one = df.agg(*aggregates)
    missing = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0))
    cells = [
        F.struct(
            F.lit(n).alias("column"),
            F.lit(kinds[n]).alias("type"),
            F.col(f"n{i}").alias("nulls"),
            (F.bround(F.col(f"s{i}"), 2) if n in numbers else F.lit(None).cast("double")).alias("skewness"),
        )
        for i, n in enumerate(names)
    ]
    rows = F.greatest(F.col("total_rows"), F.lit(1))
    return (
        one.withColumn("missing_cells", missing)
        .select("total_rows", "missing_cells", F.explode(F.array(*cells)).alias("_c"))
        .select(
            "_c.*",
            F.bround(F.col("_c.nulls") / rows * 100, 2).alias("null_pct"),
            "total_rows",
            F.lit(len(names)).alias("total_columns"),
            "missing_cells",
            F.bround(
                F.greatest(F.lit(0.0), 100 - F.col("missing_cells") / (rows * max(len(names), 1)) * 100), 1
            ).alias("hygiene_score"),
            duplicate_rows(df, rid).scalar().alias("duplicate_rows"),
        )
    )
