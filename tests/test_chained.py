"""Chained regressions against plain numpy over all rows, and their passes over the table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.operators import chained, impute

FOLDER = "/root/testdata/sf0.01"


def plain(raw, rounds=10, tolerance=1e-3):
    """Every regression over all rows; the stopping rule from each gap pattern's ranges."""
    raw = np.array(raw, float)
    n, p = raw.shape
    empty = np.isnan(raw)
    means = np.array([raw[~empty[:, i], i].mean() if (~empty[:, i]).any() else 0.0 for i in range(p)])
    scales = np.array([raw[~empty[:, i], i].std() if (~empty[:, i]).any() else 0.0 for i in range(p)])
    scales[scales == 0] = 1
    x = np.where(empty, 0, (raw - means) / scales)
    seen = x.copy()
    largest = np.nanmax(np.abs(raw))
    groups = {}
    for r in range(n):
        groups.setdefault(tuple(empty[r]), []).append(r)
    guess = {g: np.eye(p + 1) * np.append([True], ~np.array(g))[:, None] for g in groups}
    targets = sorted([i for i in range(p) if empty[:, i].any()], key=lambda i: (empty[:, i].sum(), i))
    for _ in range(rounds):
        most = 0.0
        for i in targets:
            known = ~empty[:, i]
            terms = np.column_stack([np.ones(known.sum()), x[known]])
            w = chained.solve(terms.T @ terms, i, p)
            for g, rows in groups.items():
                if not g[i]:
                    continue
                new = w @ guess[g]
                change = new - guess[g][i + 1]
                low, high = seen[rows].min(axis=0), seen[rows].max(axis=0)
                top = change[0] + np.maximum(change[1:] * low, change[1:] * high).sum()
                bottom = change[0] + np.minimum(change[1:] * low, change[1:] * high).sum()
                most = max(most, scales[i] * max(abs(top), abs(bottom)))
                guess[g][i + 1] = new
            x[~known, i] = w[0] + x[~known] @ w[1:]
        if most < tolerance * largest:
            break
    return np.where(empty, x * scales + means, raw)


def filled(df, rounds=10):
    out = impute.impute_mice(df, [c for c in df.columns if c != "_rid"], rounds).orderBy("_rid").drop("_rid").toPandas()
    return out.to_numpy(float)


def table(spark, seed, n=400, p=6, share=0.2):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(p, p))
    x = r.normal(size=(n, p)) @ mix * r.uniform(1, 100, p) + r.uniform(-50, 50, p)
    x[r.random((n, p)) < share] = np.nan
    x[0] = np.nan  # a row of gaps only
    rows = [(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "_rid long, " + ", ".join(f"c{i} double" for i in range(p))), x


@pytest.mark.parametrize("rounds", [0, 1, 3, 10])
def test_equals_plain_rows(spark, rounds):
    df, raw = table(spark, 5)
    assert np.allclose(filled(df, rounds), plain(raw, rounds), rtol=1e-6, atol=1e-6)


def test_row_by_row_gives_the_same(spark, monkeypatch):
    df, raw = table(spark, 6, n=150, p=4)
    want = filled(df, 2)
    monkeypatch.setattr(chained, "PATTERN_CELLS", 0)
    assert np.allclose(filled(df, 2), want, rtol=1e-6, atol=1e-6) and np.allclose(want, plain(raw, 2), rtol=1e-6, atol=1e-6)


def test_eight_columns_of_the_lines(spark):
    """The query ``impute_mice_eight`` on a whole table, every row recomputed."""
    from registry.learning import _EIGHT, mice_eight

    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").selectExpr("l_orderkey AS _rid", *_EIGHT)
    order = ["_rid", *[F.coalesce(c, F.lit(-1e9)) for c in lines.columns[1:]]]
    raw = lines.orderBy(*order).drop("_rid").toPandas().to_numpy(float)
    want = np.sort(plain(raw), axis=0)
    got = mice_eight(spark, FOLDER).drop("_rid").toPandas().to_numpy(float)
    assert np.allclose(np.sort(got, axis=0), want, rtol=1e-6, atol=1e-4)


def test_odd_columns(spark):
    rows = [(1, 1.0, None, 5.0, 2), (2, None, None, 5.0, 3), (3, 3.0, None, None, None), (4, float("nan"), None, 5.0, 9)]
    df = spark.createDataFrame(rows, "_rid long, a double, nothing double, same double, whole int")
    got = filled(df)
    assert not np.isnan(got).any() and (got[:, 1] == 0).all() and np.allclose(got[:, 2], 5)
    assert impute.impute_mice(df.limit(0), ["a", "same"]).count() == 0
    one = filled(df.select("_rid", "a"))
    assert np.allclose(one.ravel(), [1, 2, 3, 2])


def test_rounds_cost_no_passes(spark):
    """Jobs do not follow the rounds: they only read the stored patterns and sums."""
    df, _ = table(spark, random.randrange(100), p=12, n=600, share=0.1)
    tracker, group = spark.sparkContext.statusTracker(), "mice-{}"
    jobs = []
    for rounds in (1, 10):
        spark.sparkContext.setJobGroup(group.format(rounds), "rounds")
        impute.impute_mice(df, [f"c{i}" for i in range(12)], rounds)
        jobs.append(len(tracker.getJobIdsForGroup(group.format(rounds))))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
