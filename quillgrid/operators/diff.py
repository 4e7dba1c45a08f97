"""Comparing two versions of a table by row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.values import quoted
from quillgrid.session import materialize


def _common(old: DataFrame, new: DataFrame, key: str) -> list[str]:
    return [c for c in old.columns if c in new.columns and c != key]


def _paired(old: DataFrame, new: DataFrame, key: str, how: str) -> tuple[DataFrame, list[str]]:
    common = _common(old, new, key)
    a = old.select(F.lit(True).alias("_in_old"), F.col(f"`{key}`").alias("_old_key"), *[F.col(f"`{c}`").alias(f"_old_{i}") for i, c in enumerate(common)])
    b = new.select(F.lit(True).alias("_in_new"), F.col(f"`{key}`").alias("_new_key"), *[F.col(f"`{c}`").alias(f"_new_{i}") for i, c in enumerate(common)])
    return a.join(b, F.col("_old_key") == F.col("_new_key"), how), common


def _changed(i: int) -> Column:
    return ~F.col(f"_old_{i}").eqNullSafe(F.col(f"_new_{i}"))


def table_diff(old: DataFrame, new: DataFrame, key: str = "_rid") -> DataFrame:
    """One row: rows and columns added and removed, cells modified, totals after.

    Rows are matched by id, so a removed row is one removed row and not a shift
    of all rows below it. Ids are unique, so the join has no hot keys. Missing
    equals missing. Rows without id match nothing: they count as removed and added.
    """
    both, common = _paired(old, new, key, "full")
    is_new, is_old = F.col("_in_old").isNull(), F.col("_in_new").isNull()
    cells = sum((_changed(i).cast("long") for i in range(len(common))), F.lit(0).cast("long"))
    return both.agg(
        F.count_if(is_new).alias("rows_added"),
        F.count_if(is_old).alias("rows_removed"),
        F.coalesce(F.sum(F.when(~is_new & ~is_old, cells)), F.lit(0)).alias("modified_cells"),
        F.count("_in_new").alias("total_rows_after"),
    ).select(
        "rows_added",
        "rows_removed",
        (F.col("rows_added") - F.col("rows_removed")).alias("net_rows"),
        F.lit(len(set(new.columns) - set(old.columns))).alias("columns_added"),
        F.lit(len(set(old.columns) - set(new.columns))).alias("columns_removed"),
        "modified_cells",
        "total_rows_after",
        F.lit(len(new.columns)).alias("total_columns_after"),
    )


def cell_changes(old: DataFrame, new: DataFrame, key: str = "_rid") -> DataFrame:
    """``key, column, old, new`` (as text) of every modified cell."""
    both, common = _paired(old, new, key, "inner")
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"_old_{i}").cast("string").alias("old"),
                F.col(f"_new_{i}").cast("string").alias("new"),
                _changed(i).alias("changed"),
            )
            for i, c in enumerate(common)
        ]
    )
    changed = F.filter(cells, lambda c: c["changed"])
    return both.select(F.col("_new_key").alias(key), F.explode(changed).alias("_c")).select(
        key, "_c.column", "_c.old", "_c.new"
    )


# --- by digests of ranges

RANGE_IDS = 256  # neighbouring ids that share a digest


def _range_of(key: Column, kind: T.DataType, width: int) -> Column:
    """Neighbouring whole numbers share a range; other ids are spread by their hash."""
    if isinstance(kind, T.IntegralType):
        return F.floor(key / F.lit(width)).cast("bigint")
    return F.shiftright(F.xxhash64(key), 20)


def _digests(df: DataFrame, key: str, common: list[str], kinds: list[T.DataType], width: int, side: str) -> DataFrame:
    """Per range the number of rows and, for the ids and each column, a digest that doesn't depend on order."""
    own = F.col(f"`{key}`")
    cells = [own.cast("string"), *[F.col(f"`{c}`").cast(k) for c, k in zip(common, kinds)]]
    hashed = [F.xxhash64(own, F.lit(i), F.coalesce(c.isNull(), F.lit(True)), c) for i, c in enumerate(cells)]
    rows = df.where(own.isNotNull()).select(_range_of(own, df.schema[key].dataType, width).alias("_range"), *[h.alias(f"_h{i}") for i, h in enumerate(hashed)])
    # two sums over different bits: changes that cancel in one don't in the other
    sums = [F.struct(F.bit_xor(f"_h{i}").alias("x"), F.sum(F.shiftright(f"_h{i}", 20)).alias("s")).alias(f"{side}{i}") for i in range(len(cells))]
    return rows.groupBy("_range").agg(F.count(F.lit(1)).alias(f"{side}_rows"), *sums)


def changed_ranges(old: DataFrame, new: DataFrame, key: str = "_rid", width: int = RANGE_IDS) -> DataFrame:
    """``_range, _columns``: ranges of ids in which rows or cells differ, with the numbers of the columns that do.

    One aggregate over each side; what is joined is a row for each range.
    """
    common = _common(old, new, key)
    kinds = [old.schema[c].dataType for c in common]
    a, b = _digests(old, key, common, kinds, width, "a"), _digests(new, key, common, kinds, width, "b")
    both = a.join(b, "_range", "full")
    differ = [~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) for i in range(len(common) + 1)]
    found = both.select("_range", F.array(*differ).alias("_d"), "a_rows", "b_rows")
    numbers = F.filter(F.sequence(F.lit(1), F.lit(len(common))), lambda i: F.get("_d", i)) if common else F.array().cast("array<int>")
    return found.where(F.exists("_d", lambda d: d)).select("_range", numbers.alias("_columns"))


def rows_in_ranges(df: DataFrame, ranges: DataFrame, key: str, width: int = RANGE_IDS) -> DataFrame:
    """The rows whose id lies in one of the ranges."""
    own = _range_of(F.col(f"`{key}`"), df.schema[key].dataType, width)
    return df.withColumn("_range", own).join(ranges.select("_range"), "_range", "left_semi").drop("_range")


def table_diff_ranges(old: DataFrame, new: DataFrame, key: str = "_rid", width: int = RANGE_IDS) -> DataFrame:
    """As ``table_diff``, but rows meet only where something differs.

    Both tables are aggregated to digests of ranges of ids; rows of ranges that
    agree, and columns that agree everywhere, are not joined. Rows without id
    match nothing. Ids are of one type on both sides.
    """
    common = _common(old, new, key)
    ranges = materialize(changed_ranges(old, new, key, width), "changed-ranges")
    touched = {i for r in ranges.select(F.explode("_columns").alias("i")).distinct().collect() for i in [r["i"]]}  # column numbers
    names = [c for i, c in enumerate(common, 1) if i in touched]
    parts = [rows_in_ranges(t.where(F.col(f"`{key}`").isNotNull()).select(*quoted([key, *names])), ranges, key, width) for t in (old, new)]
    inside = table_diff(*parts, key).select("rows_added", "rows_removed", "modified_cells")
    lone = [t.agg(F.count_if(F.col(f"`{key}`").isNull()).alias("n"), F.count(F.lit(1)).alias("rows")).first() for t in (old, new)]
    added = F.col("rows_added") + F.lit(lone[1]["n"])
    removed = F.col("rows_removed") + F.lit(lone[0]["n"])
    return inside.select(
        added.alias("rows_added"),
        removed.alias("rows_removed"),
        (added - removed).alias("net_rows"),
        F.lit(len(set(new.columns) - set(old.columns))).alias("columns_added"),
        F.lit(len(set(old.columns) - set(new.columns))).alias("columns_removed"),
        "modified_cells",
        F.lit(lone[1]["rows"]).cast("bigint").alias("total_rows_after"),
        F.lit(len(new.columns)).alias("total_columns_after"),
    )
