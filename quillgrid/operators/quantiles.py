"""Exact quantiles and modes that never gather a group into one task.

``percentile``/``median``/``mode`` in Spark keep one map of all distinct values
per group in a single aggregation buffer, which fails for a group with a third
of a huge table. Here the work is split, in the same way for groups of any size:

quantiles
  1. a sketch per group brackets each wanted rank by two values;
  2. values outside the brackets are only counted, those inside are counted one
     by one (all combined before the shuffle);
  3. the pieces of brackets that hold the ranks are found from their sizes, and
     only their values are ranked.

modes
  count each (group, value) pair, then take the best pair per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.values import any_of, same_rows
from quillgrid.session import materialize

_PIECES = 256  # of a bracket


def long_form(df: DataFrame, keys: list[str], values: dict[str, Column], kind: str = "double") -> DataFrame:
    """One row per (row, column): ``keys``, ``column``, ``value`` (of one type, not null)."""
    cells = F.array(*[F.struct(F.lit(n).alias("column"), c.cast(kind).alias("value")) for n, c in values.items()])
    return (
        df.select(*keys, F.explode(cells).alias("_cell"))
        .select(*keys, "_cell.column", "_cell.value")
        .where(F.col("value").isNotNull())
    )


def exact_quantiles(
    long: DataFrame, keys: list[str], probs: list[float], value: str = "value", accuracy: int = 4000
) -> DataFrame:
    """``keys`` + ``n`` + ``quantiles`` (array, linear interpolation), exact.

    ``keys`` must not be empty, and not literals alone (a join on them would be
    none): ``long_form`` gives whole columns a key. One way for groups of any size: a sketch, whose
    error is at most ``1 / accuracy`` of a group, brackets each wanted rank by two
    values; a second pass counts what lies outside the brackets and keeps apart
    only the values inside. Two scans of ``long``; what travels is a count for
    each gap between brackets and about ``4 / accuracy`` of the distinct values.
    """
    probs_up = sorted(set(probs))
    rows = long.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    # how far a bracket reaches beyond its rank, as a share: the error and two rows more
    reach = [2.0 / accuracy, 0.01, 0.1]
    marks = [min(1.0, max(0.0, p + side * d)) for p in probs_up for d in reach for side in (-1, 1)]
    sketch = materialize(
        rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", marks, accuracy).alias("_marks")),
        "quantile-marks",
    )
    width = sum(((F.col("_n") * (d - 1.0 / accuracy) < 2).cast("int") for d in reach), F.lit(0))  # of groups too small for a reach
    ends = []
    for i in range(len(probs_up)):
        at = 2 * len(reach) * i + 2 * width
        low = F.coalesce(F.get("_marks", at), F.lit(float("-inf")))
        high = F.coalesce(F.get("_marks", at + 1), F.lit(float("inf")))
        whole = width >= len(reach)  # a few rows: all are inside
        ends.append(
            F.struct(
                F.when(whole, F.lit(float("-inf"))).otherwise(low).alias("low"), F.when(whole, F.lit(float("inf"))).otherwise(high).alias("high")
            )
        )
    brackets = sketch.select(*keys, "_n", *[e.alias(f"_b{i}") for i, e in enumerate(ends)])
    # a value's gap is the number of brackets below it; rows of a gap stand before the values of its bracket
    gap = sum(((F.col(f"_b{i}.high") < F.col("_v")).cast("int") for i in range(len(ends))), F.lit(0))
    inside = any_of([F.col("_v").between(F.col(f"_b{i}.low"), F.col(f"_b{i}.high")) for i in range(len(ends))])
    placed = same_rows(rows, brackets, keys).select(*keys, "_n", gap.alias("_gap"), F.when(inside, F.col("_v")).alias("_v"), *[f"_b{i}" for i in range(len(ends))])
    # values of a bracket are ranked inside one of its pieces, so that a bracket of a huge group is not one list
    piece = F.lit(-1)
    for i in reversed(range(len(ends))):
        low, high = F.col(f"_b{i}.low"), F.col(f"_b{i}.high")
        share = F.floor((F.col("_v") - low) / (high - low) * _PIECES).cast("int")
        share = F.when((high > low) & (high - low < float("inf")), F.least(share, F.lit(_PIECES - 1))).otherwise(0)
        piece = F.when(F.col("_v").between(low, high) & (F.col("_gap") == i), share).otherwise(piece)
    counted = placed.groupBy(*keys, "_n", "_gap", piece.alias("_piece"), "_v").agg(F.count(F.lit(1)).alias("_c"))
    pieces = counted.groupBy(*keys, "_n", "_gap", "_piece").agg(
        F.sum("_c").alias("_size"), F.collect_list(F.struct("_v", "_c")).alias("_values")
    )
    before = Window.partitionBy(*keys).orderBy("_gap", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))

    def rank(p: float, step: int) -> Column:
        position = (F.col("_n") - 1) * F.lit(p)
        return (F.floor(position) if step == 0 else F.ceil(position)).cast("long")

    ranks = [rank(p, s) for p in probs_up for s in (0, 1)]
    here = [(r >= F.col("_before")) & (r < F.col("_before") + F.col("_size")) for r in ranks]
    ranked = pieces.where(any_of(here)).withColumn("_values", F.array_sort("_values"))

    def value_at(index: Column, inside: Column) -> Column:
        """The value behind whose run of equal ones more than ``index`` rows stand."""
        start = F.struct(F.col("_before").alias("end"), F.lit(None).cast("double").alias("v"))
        walked = F.aggregate(
            "_values",
            start,
            lambda acc, x: F.struct(
                (acc["end"] + x["_c"]).alias("end"), F.when(acc["end"] <= index, x["_v"]).otherwise(acc["v"]).alias("v")
            ),
        )
        return F.max(F.when(inside, walked["v"]))

    out = ranked.groupBy(*keys, "_n").agg(
        *[value_at(r, w).alias(f"_{k % 2}_{k // 2}") for k, (r, w) in enumerate(zip(ranks, here, strict=True))]
    )
    answers = []
    for p in probs:
        i = probs_up.index(p)
        position = (F.col("_n") - 1) * F.lit(p)
        lo, hi = F.col(f"_0_{i}"), F.col(f"_1_{i}")
        answers.append(lo + (hi - lo) * (position - F.floor(position)))
    return out.select(*keys, F.col("_n").alias("n"), F.array(*answers).alias("quantiles"))


def exact_modes(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``keys`` + ``mode`` + ``freq``: most frequent value, smallest on a tie."""
    counts = (
        long.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_c")).alias("c"), F.col("_v").alias("v"))).alias("_b"))
    return best.select(*keys, F.col("_b.v").alias("mode"), (-F.col("_b.c")).alias("freq"))
