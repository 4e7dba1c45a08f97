"""Nearest prototypes by groups against all of them at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.operators import prototypes as P

FOLDER = "/root/testdata/sf0.001"


def answers(df):
    return sorted((r["id"], r["label"], None if r["score"] is None else round(r["score"], 9)) for r in df.select("id", "label", "score").collect())


@pytest.mark.parametrize("pivots,block", [(1000, 20_000), (7, 40), (1, 5)])
def test_groups_equal_one_matrix(spark, monkeypatch, pivots, block):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 8))
    known = [(f"p{i % 150:03}", (centres[i % 12] + 0.3 * r.normal(size=8)).tolist()) for i in range(300)]
    known += [("tie b", [1.0] * 8), ("tie a", [2.0] * 8), ("zero", [0.0] * 8)]
    asked = [(i, (centres[i % 12] + 0.5 * r.normal(size=8)).tolist()) for i in range(120)]
    asked += [(200, [3.0] * 8), (201, None), (202, [1.0]), (203, [0.0] * 8), (204, asked[0][1]), (205, (-centres[0]).tolist())]
    df, protos = spark.createDataFrame(asked, "id long, v array<double>"), spark.createDataFrame(known, "label string, vector array<double>")
    monkeypatch.setattr(P, "PIVOTS", pivots)
    monkeypatch.setattr(P, "BLOCK_VECTORS", block)
    one, many = P.nearest_prototype(df, "v", protos), P.nearest_prototype(df, "v", protos, most=10)
    want = [x for x in answers(one) if x[0] != 203]  # all cosines of a zero vector are 0
    assert [x for x in answers(many) if x[0] != 203] == want
    assert [x[1] for x in want if x[0] == 200] == ["tie a"] and [x[2] for x in want if x[0] in (201, 202)] == [None, None]


def test_a_hundred_thousand_prototypes(spark):
    """Made from the given vectors; groups must leave most of them alone."""
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    copies = spark.range(200).select(F.col("id").alias("copy"))
    noisy = F.transform("embedding", lambda x, i: x.cast("double") + F.lit(0.05) * F.sin(F.col("copy") * 37 + i * 11 + F.col("vec_id")))
    many = vectors.join(copies, F.col("copy") >= 0).select(F.concat_ws("-", "vec_id", "copy").alias("label"), noisy.alias("vector"))
    asked = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    assert many.count() == 100_000
    found = {x[0]: x[2] for x in answers(P.nearest_prototype(asked, "v", many))}
    rows = many.collect()
    _, matrix = P._unit([r["label"] for r in rows], [r["vector"] for r in rows])
    for r in asked.collect():
        v = np.array(r["v"], float)
        assert found[r["id"]] == pytest.approx(float((matrix @ (v / np.linalg.norm(v))).max()), abs=1e-9)


def test_visits_do_not_grow_with_groups(spark, monkeypatch, tmp_path):
    """Random directions leave no group out: a vector is stored once, and met once a block, not once a group."""
    r = np.random.default_rng(5)
    vectors = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(1500, 24)))]
    df = spark.createDataFrame(vectors, "id long, v array<double>")
    protos = df.select(F.col("id").cast("string").alias("label"), F.reverse("v").alias("vector"))
    stored, keep = {}, P.materialize

    def watched(df, name, *more, **options):
        stored[name] = keep(df, name, *more, **options)
        return stored[name]

    monkeypatch.setattr(P, "materialize", watched)
    monkeypatch.setattr(P, "BLOCK_VECTORS", 400)
    many = answers(P.nearest_prototype(df, "v", protos, most=10))
    visits = stored["prototype-visits"]
    assert visits.count() == 1500 and visits.agg(F.max(F.size("blocks")).alias("n")).first()["n"] <= 8  # 1,000 groups
    assert many == answers(P.nearest_prototype(df, "v", protos))
