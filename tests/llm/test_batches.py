"""Whole texts reach Python in batches bounded by bytes, and results don't depend on where batches end."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import batches, bpe, jaccard, perplexity

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture(scope="module")
def words():
    return bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture
def limit(spark):
    held = spark.conf.get(LIMIT, None)
    yield lambda value: spark.conf.unset(LIMIT) if value is None else spark.conf.set(LIMIT, value)
    spark.conf.unset(LIMIT) if held is None else spark.conf.set(LIMIT, held)


def test_batches_of_whole_texts_are_small(spark, words, limit, monkeypatch):
    limit(None)
    most = 2 * batches.BATCH_BYTES if hasattr(batches, "BATCH_BYTES") else 2 << 20

    def pieces(found, at, size=0):
        for batch in found:
            if batch.nbytes > most:
                raise ValueError(f"a batch of {batch.nbytes} bytes")
            if batch.num_rows:
                yield batch

    for module in (bpe, perplexity, jaccard):
        monkeypatch.setattr(module, "pieces", pieces)
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.repeat(F.concat(F.col("id"), F.lit(" some ")), 150).alias("text"))
    for make in (
        lambda: bpe.encode(docs, words),
        lambda: perplexity.count_grams(docs, "text", "lang"),
    ):
        limit(None)
        make().write.format("noop").mode("overwrite").save()
    limit(None)
    assert jaccard.frequency_levels(docs.select("text"), 5).any()


def test_a_limit_of_the_session_is_kept(spark, limit):
    limit("4000")
    batches.bounded(spark.range(1))
    assert spark.conf.get(LIMIT) == "4000"


def test_results_do_not_follow_the_batches(spark, words, docs, limit):
    def results():
        ids = bpe.encode(docs, words).select("doc_id", F.xxhash64("ids").alias("h"))
        kept = perplexity.quality_rules(docs).select("doc_id", "kept", F.round("perplexity", 4).alias("p"))
        groups = jaccard.labelled_groups(docs).select("doc_id", "text_key", "n_shingles", "component_id")
        return [sorted(map(repr, x.collect())) for x in (ids, kept, groups)]

    limit(str(1 << 30))
    whole = results()
    limit("3000")
    assert results() == whole
