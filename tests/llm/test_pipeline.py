"""The stages one after another, against plain Python on a small table."""

import json
import os
import re

import corpus_pipeline
from quillgrid.llm import jaccard, perplexity, secrets

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = f"{tmp_path}/{name}"
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        held[name] = (before, docs)
    names = [n for n, _ in corpus_pipeline.STAGES]
    for n in names[:-1]:
        assert held[n][1].columns == corpus_pipeline.COLUMNS

    before, after = held["quality rules"]
    kept = {r["doc_id"] for r in perplexity.quality_rules(before).filter("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == kept and 0.6 < len(kept) / before.count() < 1

    before, after = held["n-gram Jaccard join"]
    groups = jaccard.similar_groups(before).collect()
    assert {r["doc_id"] for r in after.collect()} == {r["component_id"] for r in groups} and after.count() < before.count()

    before, after = held["secret scans"]
    assert before.count() == after.count()
    base = [r for r in secrets.BASE_RULES]
    for r in after.collect():
        assert len(r["text"]) == r["n_chars"]
        for rule in base:
            assert not [m for m in re.finditer(rule.pattern, r["text"]) if len(m.group(rule.group)) >= rule.least]

    before, after = held["source mixing"]
    assert after.select("doc_id").distinct().exceptAll(before.select("doc_id")).count() == 0

    before, after = held["byte-level BPE"]
    assert before.count() == after.count() and all(r["n_tokens"] == len(r["ids"]) > 0 for r in after.collect())


def test_stages_on_hard_rows(spark, hard, nothing, tmp_path):
    for number, table in enumerate((hard.withColumn("label", hard["doc_id"]), nothing)):
        docs = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{number}-{k}"
            stage(spark, docs, FOLDER).write.parquet(path)
            docs = spark.read.parquet(path)
        # each stage by itself, too: the first one rejects most of these rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, table, FOLDER).write.parquet(f"{tmp_path}/{number}-alone-{k}")
    alone = spark.read.parquet(f"{tmp_path}/0-alone-1")
    assert alone.filter("doc_id = 4").count() == 1 and alone.filter("doc_id is null").count() == 1


def test_unrelated_texts_of_one_id_stay(spark):
    a, b, c, d = ("".join(f"{x}{i} " for i in range(60)) for x in "abcd")
    rows = [(3, a), (7, a + "more"), (7, b), (8, c), (8, d), (8, d), (None, "".join(reversed(a))), (None, ""), (9, " "), (9, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()
    want = [(3, a), (7, b), (8, c), (8, d), (None, "".join(reversed(a))), (None, ""), (9, " "), (9, " ")]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(repr, want))


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and rows.count() > 50


def test_stages_are_the_five():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert os.path.exists(corpus_pipeline.__file__) and json.dumps([n for n, _ in corpus_pipeline.STAGES])
