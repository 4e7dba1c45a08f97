"""Differences by digests of id ranges: the same numbers, from fewer rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import diff


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("width", [1, 16, 256])
def test_equals_the_whole_diff(spark, kind, width):
    r = random.Random(width)
    old = {i: [r.choice([None, 1.5, 2.0]), r.choice(["a", None, "b"]), r.randrange(3)] for i in r.sample(range(-2000, 2000), 900)}
    new = {i: list(v) for i, v in old.items() if r.random() > 0.05}
    for i in r.sample(sorted(new), 60):
        new[i][r.randrange(2)] = r.choice([None, 9.0, "z"][:1] + [None])
    new |= {5000 + i: [1.0, "n", 1] for i in range(30)}
    schema = "_rid long, x double, t string, n long"
    make = lambda d, lone: spark.createDataFrame([(i, *v) for i, v in d.items()] + [(None, 1.0, "q", 1)] * lone, schema).withColumn("_rid", F.col("_rid").cast(kind))
    a, b = make(old, 2), make(new, 3).withColumn("more", F.lit(1))
    assert diff.table_diff_ranges(a, b, width=width).first() == diff.table_diff(a, b).first()
    assert diff.table_diff_ranges(a, a, width=width).first()["modified_cells"] == 0
    assert diff.table_diff_ranges(a.limit(0), b, width=width).first() == diff.table_diff(a.limit(0), b).first()


def test_joined_rows_follow_the_changes(spark):
    old = spark.range(100_000).select(F.col("id").alias("_rid"), (F.col("id") % 7).alias("x"), F.lit("same").alias("t"))
    new = old.withColumn("x", F.when(F.col("_rid").between(50_000, 50_099), -1).otherwise(F.col("x")))
    ranges = diff.changed_ranges(old, new)
    assert {tuple(r["_columns"]) for r in ranges.collect()} == {(1,)}
    assert diff.rows_in_ranges(old, ranges, "_rid").count() <= 100 + 2 * diff.RANGE_IDS
    assert diff.changed_ranges(old, old).count() == 0
