"""Sorting and taking the first rows. Nulls sort last in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.values import as_number, is_numeric
from quillgrid.session import materialize
from quillgrid.sources.ingest import number_like_columns


def _order(column: Column, descending: bool, rid: str | None) -> list[Column]:
    first = column.desc_nulls_last() if descending else column.asc_nulls_last()
    return [first, F.col(f"`{rid}`").asc()] if rid else [first]


def sort_by(df: DataFrame, column: str, descending: bool = False, rid: str | None = "_rid") -> DataFrame:
    """The table sorted by one column; equal values keep row-id order."""
    return df.orderBy(*_order(F.col(f"`{column}`"), descending, rid if rid in df.columns else None))


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Number rows 1..n in a total order without a one-task window.

    Spark's range-partitioned sort puts each row into an ordered partition; the
    row's place there is written down with the row, and the partition sizes (one
    row per partition) give each partition its offset. A hot sort value is
    spread over partitions as long as ``order`` ends in a unique column.
    """
    placed = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
    )
    in_part = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.withColumn("_part", part).join(offsets, "_part")
    return numbered.withColumn(name, in_part + F.col("_before") + 1).drop("_part", "_at", "_rows", "_before")


def top_n(df: DataFrame, column: str, n: int = 5, smallest: bool = False, rid: str = "_rid") -> DataFrame:
    """The n largest (or smallest) rows; for a text column the first n rows."""
    if not is_numeric(df, column) and column not in number_like_columns(df, [column]):
        return head_n(df, n, rid)
    return df.orderBy(*_order(as_number(df, column), not smallest, rid)).limit(n)


def head_n(df: DataFrame, n: int, rid: str = "_rid") -> DataFrame:
    """The first n rows in table order."""
    return df.orderBy(F.col(f"`{rid}`")).limit(n)
