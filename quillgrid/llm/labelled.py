"""Bounded samples of labelled documents, and what the two classifiers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the key as text, modulo 5, is 0. Null keys aren't."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, label`` of at most ``rows`` labelled documents that aren't held out.

    Those with the smallest hash of their key are taken; with fewer labels, all.
    Several labels of a key count as their largest; null keys and labels are
    left out, and equal texts occur once. ``rows`` also bounds what is broadcast.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    chosen = (
        known.groupBy(F.col(key).cast("bigint").alias("key")).agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(rows)
    )
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "key").dropDuplicates(["text"])
