"""Whole-table and grouped aggregates.

Seven functions: sum, mean, median, mode, min, max, count. Nulls are skipped,
the sum of nothing is 0, a tied mode is the smallest value, null is a group.
All plain aggregates of a call share one pass with map-side combining.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.values import any_of, as_number, numeric_columns, other_columns, same_rows
from quillgrid.operators.quantiles import exact_modes, exact_quantiles, long_form
from quillgrid.sources.ingest import number_like_columns

# Functions sent to the workers travel by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Function names and their other spellings.
FUNCTIONS = ["sum", "mean", "median", "mode", "min", "max", "count"]
ALIASES = {"avg": "mean", "average": "mean", "total": "sum", "minimum": "min", "maximum": "max"}


def function_name(name: str) -> str:
    found = ALIASES.get(name.lower(), name.lower())
    if found not in FUNCTIONS:
        raise ValueError(f"unknown function {name!r}")
    return found


def _plain(func: str, col: Column) -> Column:
    return {
        "sum": lambda: F.coalesce(F.sum(col), F.lit(0)),
        "mean": lambda: F.avg(col),
        "min": lambda: F.min(col),
        "max": lambda: F.max(col),
        "count": lambda: F.count(col),
    }[func]()


def summarize(df: DataFrame, keys: list[str], specs: list[tuple[str, str, str]], approx: bool = False) -> DataFrame:
    """``keys`` + one column per ``(function, column, alias)``.

    ``approx=True`` takes medians from a sketch in the same pass.
    """
    specs = [(function_name(f), c, a) for f, c, a in specs]
    plain = [(f, c, a) for f, c, a in specs if f not in ("median", "mode")]
    ranked = [(f, c, a) for f, c, a in specs if f in ("median", "mode")]
    aggregates = [_plain(f, as_number(df, c)).alias(a) for f, c, a in plain]
    if approx:
        aggregates += [
            F.percentile_approx(as_number(df, c).cast("double"), 0.5).alias(a) for f, c, a in ranked if f == "median"
        ]
        ranked = [r for r in ranked if r[0] == "mode"]
    groups = [F.col(f"`{k}`") for k in keys]
    order = [F.col(f"`{c}`") for c in [*keys, *[a for _, _, a in specs]]]
    if not ranked:
        return df.groupBy(*groups).agg(*aggregates).select(*order)

    # Ranked functions need a key to be spread by; whole-table calls get one.
    # Keys get names of their own, apart from all other columns.
    own = [f"_key{i}" for i in range(len(keys))]
    table = df.withColumns(dict(zip(own, groups))) if keys else df.withColumn("_all", F.lit(0))
    by = own or ["_all"]
    parts = [table.groupBy(*own).agg(*aggregates, F.count("*").alias("_rows"))]
    # whole numbers are counted as such: as doubles, neighbours beyond 2 ** 53 would meet
    whole = lambda c: isinstance(df.schema[c].dataType, T.IntegralType)
    for func, kind in (("median", "double"), ("mode", "double"), ("mode", "bigint")):
        wanted = [(c, a) for f, c, a in ranked if f == func and (func == "median" or whole(c) == (kind == "bigint"))]
        if not wanted:
            continue
        long = long_form(table, by, {c: as_number(df, c) for c in sorted({c for c, _ in wanted})}, kind)
        if func == "median":
            found = exact_quantiles(long, [*by, "column"], [0.5])
            answer = F.col("quantiles")[0]
        else:
            found, answer = exact_modes(long, [*by, "column"]), F.col("mode")
        picked = [F.max(F.when(F.col("column") == c, _as_type(df, c, func, answer))).alias(a) for c, a in wanted]
        parts.append(found.groupBy(*own).agg(*picked))
    out = parts[0]
    for part in parts[1:]:
        if keys:
            out = same_rows(out, part, own, "left")
        else:
            out = out.unionByName(part, allowMissingColumns=True)
    if not keys:  # one row per part, each with its own columns
        out = out.agg(*[F.max(f"`{a}`").alias(a) for _, _, a in specs])
    return out.withColumnsRenamed(dict(zip(own, keys))).select(*order)


def _as_type(df: DataFrame, name: str, func: str, value: Column) -> Column:
    """The mode of a whole-number column is a whole number."""
    kind = df.schema[name].dataType
    return value.cast(kind) if func == "mode" and isinstance(kind, T.IntegralType) else value


def aggregate(df: DataFrame, func: str, column: str, approx: bool = False) -> DataFrame:
    """One row, column ``value``."""
    return summarize(df, [], [(func, column, "value")], approx)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("value"))


def mode_of_text(df: DataFrame, column: str) -> DataFrame:
    """One row, column ``value``: the most frequent text, smallest on a tie."""
    pairs = df.select(F.lit(0).alias("_all"), F.col(f"`{column}`").alias("value"))
    return exact_modes(pairs, ["_all"]).select(F.col("mode").alias("value"))


def _all_numbers(df: DataFrame) -> list[str]:
    """Numeric columns, then text columns that read as numbers."""
    return numeric_columns(df) + number_like_columns(df)


def aggregate_all(df: DataFrame, func: str, columns: list[str] | None = None) -> DataFrame:
    """One function over every numeric column: one wide row."""
    return summarize(df, [], [(func, c, c) for c in columns or _all_numbers(df)])


def aggregate_matrix(df: DataFrame, funcs: list[str], columns: list[str] | None = None) -> DataFrame:
    """Several functions over every numeric column: one row per column."""
    columns = columns or _all_numbers(df)
    funcs = [function_name(f) for f in funcs]
    wide = summarize(df, [], [(f, c, f"{i}_{f}") for i, c in enumerate(columns) for f in funcs])
    labels = {"mean": "mean (average)"}
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                *[F.bround(F.col(f"`{i}_{f}`").cast("double"), 4).alias(labels.get(f, f)) for f in funcs],
            )
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.explode(rows).alias("_r")).select("_r.*")


def group_agg(df: DataFrame, key: str, func: str, column: str | None = None, approx: bool = False) -> DataFrame:
    """One function of one column per group; ``count`` without column counts rows."""
    func = function_name(func)
    if column is None:
        if func != "count":
            raise ValueError("name the column to calculate")
        return df.groupBy(F.col(f"`{key}`")).agg(F.count("*").alias("row_count"))
    alias = f"{column}_count" if func == "count" else f"{func}_{column}"
    return summarize(df, [key], [(func, column, alias)], approx)


def group_agg_all(df: DataFrame, key: str, func: str, columns: list[str] | None = None) -> DataFrame:
    """One function of every numeric column per group."""
    columns = columns or [c for c in _all_numbers(df) if c != key]
    return summarize(df, [key], [(func, c, c) for c in columns])


def fast_group_agg(df: DataFrame, key: str, column: str, func: str = "avg") -> DataFrame:
    """SQL-style grouped aggregate, largest first; an unknown function is AVG.

    Here the sum of an all-null group stays null.
    """
    # The functions accepted by name.
    known = {"avg": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    name = func.lower() if func.lower() in known else "avg"
    alias = f"{name}_{column}"
    grouped = df.groupBy(F.col(f"`{key}`")).agg(known[name](F.col(f"`{column}`")).alias(alias))
    return grouped.orderBy(F.col(f"`{alias}`").desc_nulls_last())


def correlations(df: DataFrame, columns: list[str] | None = None, digits: int | None = 3) -> DataFrame:
    """Pearson matrix as rows ``(col_a, col_b, r)`` over rows where both are present.

    Null for a constant column. One pass: each task keeps counts, means and
    co-moments of its batches, taken from a middle value of each batch, and
    merges them pairwise (Chan et al., 1979), so nothing cancels however large
    the values are. A task sends one record per pair of columns; rows are never
    multiplied by the number of pairs.
    """
    columns = columns or numeric_columns(df)
    p = len(columns)
    values = df.select(*[as_number(df, c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])

    def run(batches):
        from pyspark import TaskContext

        n, mean, square, product = np.zeros((4, p, p))  # of column i over the rows that have i and j
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([pc.fill_null(c, float("nan")).to_numpy(zero_copy_only=False) for c in batch.columns])
            there = ~np.isnan(x)
            middle = np.array([np.partition(v[t], t.sum() // 2)[t.sum() // 2] if t.any() else 0.0 for v, t in zip(x.T, there.T)])
            x, there = np.where(there, x - middle, 0.0), there.astype(float)
            count = there.T @ there
            own = np.divide(x.T @ there, count, out=np.zeros((p, p)), where=count > 0)
            squares = (x * x).T @ there
            spread = squares - count * own * own
            spread[spread <= 1e-13 * squares] = 0.0
            both = x.T @ x - count * own * own.T
            total = n + count
            share = np.divide(count, total, out=np.zeros((p, p)), where=total > 0)
            apart = np.where(n > 0, own + middle[:, None] - mean, 0.0)
            square += spread + apart * apart * n * share
            product += both + apart * apart.T * n * share
            mean, n = np.where(n > 0, mean + apart * share, own + middle[:, None]), total
        i, j = np.triu_indices(p)
        lane = np.full(len(i), TaskContext.get().partitionId() % 64, np.int32)
        parts = [i.astype(np.int32), j.astype(np.int32), lane, n[i, j], mean[i, j], mean[j, i], square[i, j], square[j, i], product[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in parts], names=["i", "j", "lane", *_MOMENTS])

    def merged(a: Column, b: Column) -> Column:
        total = a["n"] + b["n"]
        share = F.when(total > 0, b["n"] / total).otherwise(0.0)
        x, y = (F.when(a["n"] > 0, b[m] - a[m]).otherwise(0.0) for m in ("mx", "my"))
        first = lambda m, d: F.when(a["n"] > 0, a[m] + d * share).otherwise(b[m]).alias(m)
        weight = a["n"] * share
        return F.struct(
            total.alias("n"), first("mx", x), first("my", y), (a["xx"] + b["xx"] + x * x * weight).alias("xx"),
            (a["yy"] + b["yy"] + y * y * weight).alias("yy"), (a["xy"] + b["xy"] + x * y * weight).alias("xy"),
        )

    moments = values.mapInArrow(run, "i int, j int, lane int, " + ", ".join(f"{m} double" for m in _MOMENTS))
    nothing = F.struct(*[F.lit(0.0).alias(m) for m in _MOMENTS])
    for keys in (["i", "j", "lane"], ["i", "j"]):  # tasks by lane, then the lanes
        lists = moments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_MOMENTS))).alias("_all"))
        moments = lists.select(*keys, F.aggregate("_all", nothing, merged).alias("_m")).select(*keys, "_m.*")
    total = moments
    flat = any_of([F.col(s) <= F.pow(F.lit(1e-14) * F.col(m), 2) * F.col("n") for s, m in (("xx", "mx"), ("yy", "my"))])
    r = F.when(~flat, F.col("xy") / (F.sqrt("xx") * F.sqrt("yy")))
    names = F.array(*[F.lit(c) for c in columns])
    inside = F.when(r > 1, F.lit(1.0)).when(r < -1, F.lit(-1.0)).otherwise(r)
    r = F.when(F.col("i") == F.col("j"), F.when(~flat, F.lit(1.0))).otherwise(inside)
    shown = r if digits is None else F.bround(r, digits)
    a, b = F.get(names, F.col("i")), F.get(names, F.col("j"))
    pair = F.when(
        F.col("i") == F.col("j"), F.array(F.struct(a.alias("col_a"), b.alias("col_b")))
    ).otherwise(F.array(F.struct(a.alias("col_a"), b.alias("col_b")), F.struct(b.alias("col_a"), a.alias("col_b"))))
    return total.select(F.explode(pair).alias("_c"), shown.alias("r")).select("_c.*", "r")


_MOMENTS = ["n", "mx", "my", "xx", "yy", "xy"]


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: counts, most frequent value, moments and quartiles.

    Text columns fill ``unique``, ``top`` and ``freq``; numeric columns the rest.
    """
    numbers = [c for c in numeric_columns(df) if columns is None or c in columns]
    texts = [c for c in other_columns(df) if columns is None or c in columns]
    parts = []
    if numbers:
        long = long_form(df, [], {c: F.col(f"`{c}`") for c in numbers})
        moments = long.groupBy("column").agg(
            F.count("value").alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
        quartiles = exact_quantiles(long, ["column"], [0.25, 0.5, 0.75])
        q = F.col("quantiles")
        parts.append(
            same_rows(moments, quartiles, ["column"], "left").select(
                "column",
                "count",
                F.lit(None).cast("long").alias("unique"),
                F.lit(None).cast("string").alias("top"),
                F.lit(None).cast("long").alias("freq"),
                "mean",
                "std",
                "min",
                q[0].alias("q25"),
                q[1].alias("q50"),
                q[2].alias("q75"),
                "max",
            )
        )
    if texts:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in texts])
        counts = (
            df.select(F.explode(cells).alias("_c"))
            .select("_c.*")
            .groupBy("column", "v")
            .agg(F.count("v").alias("c"))
        )
        best = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("c")).alias("c"), F.col("v").alias("v"))))
        none = F.lit(None).cast("double")
        parts.append(
            counts.groupBy("column")
            .agg(F.sum("c").alias("count"), F.count("v").alias("unique"), best.alias("_b"))
            .select(
                "column",
                "count",
                "unique",
                F.col("_b.v").alias("top"),
                (-F.col("_b.c")).alias("freq"),
                *[none.alias(n) for n in ("mean", "std", "min", "q25", "q50", "q75", "max")],
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bar_series(df: DataFrame, x: str | None = None, y: str | None = None, bars: int | None = None) -> DataFrame:
    """Data of a bar chart: total of ``y`` per category ``x``, tallest first.

    All categories, or the ``bars`` tallest if a number is given.
    """
    x = x or (other_columns(df) or df.columns)[0]
    y = y or (numeric_columns(df) or df.columns)[0]
    total = F.coalesce(F.sum(as_number(df, y)), F.lit(0)).alias("height")
    out = (
        df.groupBy(F.col(f"`{x}`").alias("bar"))
        .agg(total)
        .orderBy(F.col("height").desc_nulls_last(), F.col("bar").asc_nulls_last())
    )
    return out if bars is None else out.limit(bars)
