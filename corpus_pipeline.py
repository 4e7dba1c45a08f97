"""From raw documents to token ids, in stages that are stored one by one.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its
predecessor kept and returns the columns of ``documents`` (the last one: ids).
Other columns are left out; nulls, empty and very long texts, repeated rows and
empty tables pass through as the operators' docstrings tell.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import bpe, jaccard, mixing, perplexity, secrets
from quillgrid.session import materialize, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and lie inside their language's perplexity band."""
    return perplexity.quality_rules(docs.select(*COLUMNS), keep=tuple(COLUMNS)).filter("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar documents, that with the smallest ``doc_id`` (of several, the smallest text hash).

    A row is told from others by its ``doc_id`` and the hash of its text, so
    unrelated texts of one ``doc_id`` are judged apart; rows that agree in both
    are one, with the smallest other columns. Texts without words and rows
    without ``doc_id`` are kept: the first are like nothing, the second are
    never a group's document.
    """
    docs = docs.select(*COLUMNS)
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    groups = jaccard.labelled_groups(docs).filter("doc_id is not null and label is not null")
    rows = groups.groupBy("label", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("label").agg(F.min(F.struct("doc_id", "text_key", "n")).alias("row"))
    first = materialize(first.select("row.*"), "firsts")
    others = docs.filter(~alone).withColumn("text_key", F.xxhash64("text"))
    once = others.join(first.filter("n = 1").drop("n"), ["doc_id", "text_key"], "left_semi")
    several = (
        others.join(first.filter("n > 1").drop("n"), ["doc_id", "text_key"], "left_semi")
        .groupBy("doc_id", "text_key")
        .agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    )
    return docs.filter(alone).unionByName(once.select(*COLUMNS)).unionByName(several.select("doc_id", "row.*"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret is replaced by a mark; ``n_chars`` follows the text."""
    clean = secrets.redact(secrets.scan_secrets(docs.select(*COLUMNS)))
    n_chars = F.when(F.size("secret_spans") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in shuffled order."""
    return mixing.mix_sources(docs.select(*COLUMNS), exponent=0.7).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids``."""
    words = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe.encode(docs.select(*COLUMNS), words)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", reject_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", remove_secrets),
    ("source mixing", mix),
    ("byte-level BPE", tokenize),
]
# perplexities and merges are beyond SQL; tests hold the stages against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
