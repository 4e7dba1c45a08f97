"""One-column isolation forest.

In one dimension a tree is a step function of the value, and so is the average
depth over all trees. The forest is therefore a short sorted list of cuts: the
trees grow from bounded samples, one task per tree, and the table is scored by
looking values up in that list.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.values import is_numeric
from quillgrid.operators.quantiles import exact_quantiles, long_form

# Functions sent to the workers travel by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Share of rows to flag, seed, trees, rows per tree.
CONTAMINATION = 0.05
SEED = 42
TREES = 100
SAMPLE = 256


def _average_depth(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of an unsuccessful search among n values (Liu et al., 2008)."""
    n = np.asarray(n, dtype=np.float64)
    many = 2.0 * (np.log(np.maximum(n, 2) - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


def _grow(values: np.ndarray, random: np.random.Generator) -> tuple[list[float], list[float]]:
    """Cuts and the depth of each interval between them, left to right."""
    limit = math.ceil(math.log2(max(len(values), 2)))
    cuts: list[float] = []
    depths: list[float] = []

    def visit(low: int, high: int, depth: int) -> None:
        if depth >= limit or high - low <= 1 or values[low] == values[high - 1]:
            depths.append(depth + float(_average_depth(high - low)))
            return
        cut = random.uniform(values[low], values[high - 1])
        middle = low + int(np.searchsorted(values[low:high], cut, side="right"))
        middle = min(max(middle, low + 1), high - 1)
        visit(low, middle, depth + 1)
        cuts.append(min(max(cut, values[middle - 1]), values[middle]))
        visit(middle, high, depth + 1)

    visit(0, len(values), 0)
    return cuts, depths


def isolation_outliers(
    df: DataFrame, col: str, contamination: float = CONTAMINATION, seed: int = SEED, rid: str = "_rid"
) -> DataFrame:
    """The flagged rows with ``is_anomaly = -1``; no rows for a text column.

    Gaps count as the median. Samples are drawn by hashing the row id, so the
    answer does not depend on how the table is partitioned.
    """
    if col not in df.columns or not is_numeric(df, col):
        return df.limit(0).withColumn("is_anomaly", F.lit(-1))
    median = exact_quantiles(long_form(df, [], {col: F.col(f"`{col}`")}), ["column"], [0.5]).first()
    if median is None:
        return df.limit(0).withColumn("is_anomaly", F.lit(-1))
    value = F.coalesce(F.col(f"`{col}`").cast("double"), F.lit(median["quantiles"][0]))
    rows = df.select(F.col(f"`{rid}`").alias("_id"), value.alias("_x"))
    total = rows.count()

    # About 2 * SAMPLE candidates per tree, at most TREES * 2 * SAMPLE rows leave the scan.
    want = 2 * SAMPLE * TREES
    copies = min(max(math.ceil(want / total), 1), TREES)
    draw = F.xxhash64("_id", F.lit(seed))  # over all 64 bits, so that no table is too large for it
    drawn = rows.where(draw < int(want / total * 2.0**64) - 2**63) if total > want else rows
    first = F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(TREES))
    candidates = drawn.select(
        "_id", "_x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda i: F.pmod(first + i, F.lit(TREES)))).alias("_tree")
    )

    def tree(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(sample.nsmallest(SAMPLE, ["_h", "_id"])["_x"].to_numpy())
        cuts, depths = _grow(values, np.random.default_rng([seed, int(key[0])]))
        scale = float(_average_depth(len(values))) or 1.0
        return pd.DataFrame({"_cut": [-np.inf, *cuts], "_step": np.diff([0.0, *depths]) / scale})

    steps = (
        candidates.withColumn("_h", F.xxhash64("_id", "_tree", F.lit(seed + 2)))
        .groupBy("_tree")
        .applyInPandas(tree, "_cut double, _step double")
        .toPandas()
    )  # at most TREES * SAMPLE rows
    grown = max(int((steps["_cut"] == -np.inf).sum()), 1)
    steps = steps.groupby("_cut", sort=True)["_step"].sum()
    cuts = steps.index.to_numpy()[1:]
    scores = -np.power(2.0, -np.cumsum(steps.to_numpy()) / grown)

    @F.pandas_udf(T.IntegerType())
    def interval(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(), side="left").astype(np.int32))

    counts = rows.groupBy(interval("_x").alias("_i")).count().toPandas()  # one row per interval
    scored = pd.DataFrame({"s": scores[counts["_i"]], "n": counts["count"]}).groupby("s", sort=True)["n"].sum()
    ends = np.cumsum(scored.to_numpy())
    position = contamination * (total - 1)
    low, high = (scored.index.to_numpy()[np.searchsorted(ends, r, side="right")] for r in (math.floor(position), math.ceil(position)))
    limit = low + (high - low) * (position - math.floor(position))
    flagged = np.flatnonzero(scores < limit)
    odd = np.zeros(len(scores), dtype=bool)
    odd[flagged] = True

    @F.pandas_udf(T.BooleanType())
    def is_odd(x: pd.Series) -> pd.Series:
        return pd.Series(odd[np.searchsorted(cuts, x.to_numpy(), side="left")])

    return df.where(is_odd(value)).withColumn("is_anomaly", F.lit(-1))
