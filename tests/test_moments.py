"""Correlations by merged co-moments against numpy in high precision."""

import numpy as np
import pytest

from quillgrid.operators.aggregates import correlations


def exact(rows, i, j):
    both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
    if not both:
        return None
    x, y = (np.array([b[k] for b in both], np.longdouble) for k in (0, 1))
    if len(set(x)) == 1 or len(set(y)) == 1:
        return None
    x, y = x - x.mean(), y - y.mean()
    return float((x @ y) / np.sqrt((x @ x) * (y @ y)))


@pytest.mark.parametrize("parts", [1, 7, 150])
def test_any_partitioning_and_size_of_values(spark, parts):
    r = np.random.default_rng(3)
    x = r.normal(size=600)
    columns = [x, 1e12 + 3 * x + r.normal(size=600), -1e12 + r.normal(size=600), np.full(600, 0.1), np.full(600, 1e12 + 0.3), 1e-9 * x * x, np.append(1e9, x[1:])]
    rows = [tuple(None if (i * 7 + j) % 11 == 0 else float(v) for j, v in enumerate(row)) for i, row in enumerate(zip(*columns))]
    rows += [(None,) * len(columns)] * 3
    df = spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(len(columns)))).repartition(parts)
    got = {(q["col_a"], q["col_b"]): q["r"] for q in correlations(df, digits=None).collect()}
    assert len(got) == len(columns) ** 2
    for i in range(len(columns)):
        for j in range(len(columns)):
            want = None if 3 in (i, j) or 4 in (i, j) else exact(rows, i, j)
            have = got[f"c{i}", f"c{j}"]
            assert (have is None) == (want is None), (i, j, have, want)
            if want is not None:
                assert have == pytest.approx(want, abs=2e-4 if {i, j} & {1, 2} else 1e-9), (i, j)


def test_one_pass_and_empty_tables(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert all(r["r"] is None for r in correlations(df).collect())
    one = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    found = correlations(one)
    assert all(r["r"] is None for r in found.collect())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
