"""Chained regressions on sufficient statistics.

Rows are grouped by which columns they miss. A guess for a missing cell is a
linear function of the row's filled cells, the same for all rows of a gap
pattern, and a regression needs only sums of products. So two passes suffice,
however many rounds follow: one for each pattern's counts, means and ranges, one
for its sums of products. With ``W`` the matrix that makes a pattern's whole rows
from its filled cells and ``S`` their sums of products, the sums over the whole
rows are ``W S W'``; a round is algebra on these small matrices.

Tables with very many patterns (``PATTERN_CELLS``) are summed row by row instead,
a pass over the incomplete rows for each regression, with the same results.
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

from quillgrid.functions.values import any_of
from quillgrid.session import materialize

# Functions sent to the workers travel by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: a round that moves no guess by this share of the largest value is the last.
TOLERANCE = 1e-3
PATTERN_CELLS = 1 << 20  # of all patterns' matrices: 8 MB for each of S and W


def chained_fill(df: DataFrame, cols: list[str], rounds: int) -> DataFrame:
    """``df`` with the gaps of ``cols`` (doubles; not a number counts as a gap) filled.

    Start from column means; in each round, column by column (fewest gaps
    first), regress on the others and guess the gaps again. Stops early when no
    guess can have moved by ``TOLERANCE`` times the largest value, judged by the
    ranges of each pattern's filled cells.
    """
    names = [f"_v{i}" for i in range(len(cols))]
    values = [F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(n) for c, n in zip(cols, names)]
    gaps = F.concat(*[F.when(F.col(n).isNull(), "1").otherwise("0") for n in names])
    rows = df.select(*values)
    patterns = materialize(rows.groupBy(gaps.alias("_gaps")).agg(*_ranges(names)), "gap-patterns")
    p = len(cols)
    if p < 2 or patterns.count() * (p + 1) ** 2 <= PATTERN_CELLS:
        found = [r for r in patterns.orderBy("_gaps").collect()]  # bounded by PATTERN_CELLS
        state = _Patterns(found, p)
        if p > 1 and state.targets and rounds > 0:
            state.products = _pattern_sums(rows, state)
            state.run(rounds)
        return _filled(df, cols, state.whole)
    return _by_rows(df, rows, cols, rounds)


def _ranges(names: list[str]) -> list[Column]:
    """Count, mean, variance and range of every column; Spark merges them without cancellation."""
    one = lambda i, n: [
        F.count(n).alias(f"n{i}"), F.avg(n).alias(f"m{i}"), F.var_pop(n).alias(f"s{i}"), F.min(n).alias(f"a{i}"), F.max(n).alias(f"b{i}")
    ]
    return [c for i, n in enumerate(names) for c in one(i, n)]


def _spread(count: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the columns from those of the patterns; 0 and 1 where there is nothing."""
    total = count.sum(axis=0)
    means = np.divide((count * mean).sum(axis=0), total, out=np.zeros(len(total)), where=total > 0)
    squares = (count * (var + (mean - means) ** 2)).sum(axis=0)
    scales = np.sqrt(np.divide(squares, total, out=np.zeros(len(total)), where=total > 0))
    return means, np.where(scales > 0, scales, 1.0)


class _Patterns:
    """Gap patterns, how their whole rows follow from their filled cells, and the regressions."""

    def __init__(self, found: list, p: int) -> None:
        read = lambda c, empty: np.array(
            [[empty if r[f"{c}{i}"] is None else r[f"{c}{i}"] for i in range(p)] for r in found], float
        ).reshape(len(found), p)
        count, mean, var, low, high = (read(c, 0.0) for c in ("n", "m", "s", "a", "b"))
        self.p = p
        self.empty = np.array([[g == "1" for g in r["_gaps"]] for r in found], bool).reshape(len(found), p)
        self.means, self.scales = _spread(count, mean, var)
        self.largest = float(np.maximum(np.abs(low), np.abs(high)).max(initial=0.0))
        self.low, self.high = ((np.where(self.empty, 0.0, (x - self.means) / self.scales)) for x in (low, high))
        sizes = np.array([max([r[f"n{i}"] for i in range(p)], default=0) for r in found])
        lost = (self.empty * sizes[:, None]).sum(axis=0)
        # a pattern without any filled cell counts as gaps, too; its size isn't needed
        self.targets = sorted(np.flatnonzero(self.empty.any(axis=0)).tolist(), key=lambda i: (lost[i], i))
        self.whole_rows = np.tile(np.eye(p + 1), (len(found), 1, 1))
        self.whole_rows[:, 1:][self.empty] = 0.0
        self.products = np.zeros((len(found), p + 1, p + 1))

    def _moved(self, change: np.ndarray, rows: np.ndarray) -> float:
        """How far guesses can move at most, from the ranges of the filled cells."""
        ends = change[:, 1:] * self.low[rows], change[:, 1:] * self.high[rows]
        top = change[:, 0] + np.maximum(*ends).sum(axis=1)
        bottom = change[:, 0] + np.minimum(*ends).sum(axis=1)
        return float(np.maximum(np.abs(top), np.abs(bottom)).max(initial=0.0))

    def run(self, rounds: int) -> None:
        for _ in range(rounds):
            most = 0.0
            for i in self.targets:
                known = ~self.empty[:, i]
                w = self.whole_rows[known]
                products = (w @ self.products[known] @ w.transpose(0, 2, 1)).sum(axis=0)
                weights = solve(products, i, self.p)
                guess = weights @ self.whole_rows[~known]
                most = max(most, self.scales[i] * self._moved(guess - self.whole_rows[~known, i + 1], ~known))
                self.whole_rows[~known, i + 1] = guess
            if most < TOLERANCE * self.largest:
                return

    @property
    def whole(self):
        """Makes whole rows from rows with gaps (not a number); small enough to travel with a task."""
        means, scales, p = self.means, self.scales, self.p
        rules = {np.packbits(e).tobytes(): (np.flatnonzero(e), w[1:][e]) for e, w in zip(self.empty, self.whole_rows, strict=True)}

        def fill(raw: np.ndarray) -> np.ndarray:
            empty = np.isnan(raw)
            known = np.column_stack([np.ones(len(raw)), np.where(empty, 0.0, (raw - means) / scales)])
            out = raw.copy()
            for key, rows in _by_pattern(empty):
                at, weights = rules[key]
                out[np.ix_(rows, at)] = (known[rows] @ weights.T) * scales[at] + means[at]
            return out

        return fill


def _by_pattern(empty: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
    """Packed gap pattern and the rows that have it."""
    if not len(empty):
        return []
    packed = np.packbits(empty, axis=1)
    keys, which = np.unique(packed, axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    cuts = np.searchsorted(which.ravel()[order], np.arange(1, len(keys)))
    return [(k.tobytes(), rows) for k, rows in zip(keys, np.split(order, cuts), strict=True)]


def _matrix(batch: pa.RecordBatch, places: list[int]) -> np.ndarray:
    columns = [pc.fill_null(batch.column(i), float("nan")).to_numpy(zero_copy_only=False) for i in places]
    return np.column_stack(columns) if batch.num_rows else np.zeros((0, len(places)))


def _pattern_sums(rows: DataFrame, state: _Patterns) -> np.ndarray:
    """Sums of products of (1, filled cells, 0 for gaps) of every pattern.

    One pass; a task sends a short record for each product of each pattern that it met.
    """
    p, means, scales = state.p, state.means, state.scales
    number = {np.packbits(e).tobytes(): i for i, e in enumerate(state.empty)}

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = _matrix(batch, list(range(p)))
            empty = np.isnan(raw)
            terms = np.column_stack([np.ones(len(raw)), np.where(empty, 0.0, (raw - means) / scales)])
            for key, own in _by_pattern(empty):
                at = number[key]
                sums[at] = sums.get(at, 0.0) + terms[own].T @ terms[own]
        for at, products in sums.items():
            places = pa.array(np.arange(products.size), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(products.size, at), pa.int32()), places, pa.array(products.ravel())], names=["g", "k", "v"])

    out = np.zeros((len(state.empty), (p + 1) ** 2))
    added = rows.mapInArrow(run, "g int, k int, v double").groupBy("g", "k").agg(F.sum("v").alias("v")).toArrow()  # PATTERN_CELLS rows at most
    if added.num_rows:
        out[added.column("g").to_numpy(), added.column("k").to_numpy()] = added.column("v").to_numpy()
    return out.reshape(-1, p + 1, p + 1)


def solve(products: np.ndarray, target: int, p: int) -> np.ndarray:
    """Weights (intercept first, 0 for the target itself), lightly ridged."""
    use = [0, *[j + 1 for j in range(p) if j != target]]
    left = products[np.ix_(use, use)]
    ridge = np.eye(len(use)) * 1e-9 * max(products[0, 0], 1.0)
    ridge[0, 0] = 0.0
    found = np.linalg.lstsq(left + ridge, products[use, target + 1], rcond=None)[0]
    weights = np.zeros(p + 1)
    weights[use] = found
    return weights


def _filled(df: DataFrame, cols: list[str], whole) -> DataFrame:
    """The table with guesses in the gaps; other cells and columns pass through."""
    places = [df.columns.index(c) for c in cols]
    plain = [f"_c{i}" for i in range(len(df.columns))]  # names that any Arrow version takes
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(plain, df.schema.fields)])

    def run(batches):
        for batch in batches:
            columns, filled = list(batch.columns), whole(_matrix(batch, places))
            for k, at in enumerate(places):
                columns[at] = pa.array(filled[:, k])
            yield pa.RecordBatch.from_arrays(columns, names=plain)

    return df.toDF(*plain).mapInArrow(run, schema).toDF(*df.columns)


# Row by row, for tables with very many patterns


class _Chain:
    """Means, scales and the regressions found so far; small, whatever the table."""

    def __init__(self, means: np.ndarray, scales: np.ndarray) -> None:
        self.means, self.scales, self.steps = means, scales, []

    def replay(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled values with all steps applied, where gaps are, and how far each gap moved last."""
        empty = np.isnan(raw)
        x = np.where(empty, 0.0, (raw - self.means) / self.scales)
        moved = np.zeros_like(x)
        for i, weights in self.steps:
            rows = np.flatnonzero(empty[:, i])
            guess = weights[0] + x[rows] @ weights[1:]  # the target's own weight is 0
            moved[rows, i] = np.abs(guess - x[rows, i])
            x[rows, i] = guess
        return x, empty, moved

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        x, empty, _ = self.replay(raw)
        return np.where(empty, x * self.scales + self.means, raw)


def _sums(rows: DataFrame, chain: _Chain, target: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of (1, x0, x1, ...) over the rows that have the target, and the largest last moves."""
    p = len(rows.columns)

    def run(batches):
        total, most = np.zeros((p + 1, p + 1)), np.zeros(p)
        for batch in batches:
            x, empty, moved = chain.replay(_matrix(batch, list(range(p))))
            if len(x):
                most = np.maximum(most, moved.max(axis=0))
            known = x if target is None else x[~empty[:, target]]
            terms = np.column_stack([np.ones(len(known)), known])
            total += terms.T @ terms
        places = np.arange((p + 1) ** 2 + p)
        values = np.concatenate([total.ravel(), most])
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(values)], names=["k", "v"])

    added = rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("s"), F.max("v").alias("m"))
    sums, largest = np.zeros((p + 1) ** 2), np.zeros(p)
    for r in added.collect():  # (p + 1) ** 2 + p rows
        if r["k"] < len(sums):
            sums[r["k"]] = r["s"]
        else:
            largest[r["k"] - len(sums)] = r["m"]
    return sums.reshape(p + 1, p + 1), largest


def _by_rows(df: DataFrame, rows: DataFrame, cols: list[str], rounds: int) -> DataFrame:
    """Regressions over the rows themselves: the complete ones are summed once, the others replayed for each."""
    p, names = len(cols), rows.columns
    first = rows.agg(*_ranges(names), F.count(F.lit(1)).alias("rows")).first()
    read = lambda c: np.array([[first[f"{c}{i}"] or 0.0 for i in range(p)]], float)
    means, scales = _spread(read("n"), read("m"), read("s"))
    largest = float(np.maximum(np.abs(read("a")), np.abs(read("b"))).max(initial=0.0))
    targets = sorted([i for i in range(p) if first[f"n{i}"] < first["rows"]], key=lambda i: (-first[f"n{i}"], i))
    gap = any_of([F.col(n).isNull() for n in names])
    complete, _ = _sums(rows.where(~gap), _Chain(means, scales), None)
    stored = materialize(rows.where(gap), "incomplete-rows")
    chain = _Chain(means, scales)
    for turn in range(rounds):
        for place, i in enumerate(targets):
            products, moved = _sums(stored, chain, i)
            if turn and not place and max(moved[j] * scales[j] for j in targets) < TOLERANCE * largest:
                return _filled(df, cols, chain)
            chain.steps.append((i, solve(complete + products, i, p)))
    return _filled(df, cols, chain)
