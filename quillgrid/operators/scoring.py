"""Scoring predictions against expected answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.operators.quantiles import exact_quantiles, long_form


def score_predictions(
    df: DataFrame, predicted: str, expected: str, found_slots: str, expected_slot: str, latency: str
) -> DataFrame:
    """One row: queries, accuracy %, slot hit rate %, mean and 95th percentile latency.

    A row without an expected slot counts as a hit.
    """
    hit = F.col(expected_slot).isNull() | F.array_contains(F.col(found_slots), F.col(expected_slot))
    right = F.col(predicted).eqNullSafe(F.col(expected))
    summary = df.agg(
        F.count("*").alias("queries"),
        F.bround(F.avg(right.cast("int")) * 100, 2).alias("accuracy_pct"),
        F.bround(F.avg(F.coalesce(hit, F.lit(False)).cast("int")) * 100, 2).alias("slot_hit_pct"),
        F.bround(F.avg(latency), 2).alias("avg_latency_ms"),
    )
    slow = exact_quantiles(long_form(df, [], {latency: F.col(latency)}), ["column"], [0.95])
    p95 = slow.select(F.col("quantiles")[0]).scalar()
    return summary.withColumn("p95_latency_ms", F.bround(p95, 2))
