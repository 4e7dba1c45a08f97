"""Filling missing values: median, mode, chained regression, nearest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.values import numeric_columns, other_columns
from quillgrid.operators.chained import chained_fill
from quillgrid.operators.knn import fill_from_neighbours
from quillgrid.operators.quantiles import exact_modes, exact_quantiles, long_form

# Neighbours, rounds, and the text for a column without any value.
NEIGHBOURS = 5
ROUNDS = 10
NO_VALUE = "Unknown"


def impute(
    df: DataFrame,
    method: str = "knn",
    cols: list[str] | None = None,
    k: int = NEIGHBOURS,
    rounds: int = ROUNDS,
    rid: str = "_rid",
) -> DataFrame:
    """Fill numeric columns by ``knn``, ``mice`` or (any other name) the median,
    and every other column by its most frequent value."""
    numbers = [c for c in numeric_columns(df) if cols is None or c in cols]
    others = [c for c in other_columns(df) if cols is None or c in cols]
    if method == "mice":
        out = impute_mice(df, numbers, rounds)
    elif method == "knn":
        out = impute_knn(df, numbers, k, rid)
    else:
        out = impute_median(df, numbers)
    return impute_mode(out, others)


def impute_median(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Numeric gaps get the exact column median; the columns become doubles.

    Collects one number per column.
    """
    cols = numeric_columns(df) if cols is None else cols
    if not cols:
        return df
    long = long_form(df, [], {c: F.col(f"`{c}`") for c in cols})
    medians = {r["column"]: r["quantiles"][0] for r in exact_quantiles(long, ["column"], [0.5]).collect()}
    return df.withColumns(
        {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(medians.get(c)).cast("double")) for c in cols}
    )


def impute_mode(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Gaps of other columns get the most frequent value. Collects one per column."""
    cols = other_columns(df) if cols is None else cols
    if not cols:
        return df
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])
    long = df.select(F.explode(cells).alias("_c")).select("_c.*")
    modes = {r["column"]: r["mode"] for r in exact_modes(long, ["column"]).collect()}
    filled = {}
    for c in cols:
        kind = df.schema[c].dataType
        filled[c] = F.coalesce(F.col(f"`{c}`"), F.lit(modes.get(c, NO_VALUE)).try_cast(kind))
    return df.withColumns(filled)


def impute_knn(df: DataFrame, cols: list[str] | None = None, k: int = NEIGHBOURS, rid: str = "_rid") -> DataFrame:
    """Numeric gaps get the mean of the k nearest rows that have the value.

    Distance: Euclidean over the columns both rows have, scaled up for the
    missing ones; nearer row id first on equal distance; the column mean when no
    row shares a column. The columns become doubles.
    """
    cols = numeric_columns(df) if cols is None else cols
    gaps = [c for c, n in _null_counts(df, cols).items() if n]
    doubles = df.withColumns({c: F.col(f"`{c}`").cast("double") for c in cols})
    return fill_from_neighbours(doubles, cols, gaps, k, rid) if gaps else doubles


def _null_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    if not cols:
        return {}
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def impute_mice(df: DataFrame, cols: list[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Numeric gaps by chained linear regressions on the other columns, ``rounds`` at most.

    Two passes over the table whatever the rounds (see ``chained``). The columns
    become doubles; a column without any value becomes 0.
    """
    cols = numeric_columns(df) if cols is None else cols
    doubles = df.withColumns({c: F.col(f"`{c}`").cast("double") for c in cols})
    return chained_fill(doubles, cols, rounds) if cols else doubles
