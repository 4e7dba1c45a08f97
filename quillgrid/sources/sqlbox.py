"""Free-form Spark SQL over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PART_ROWS = 100_000


def dealt(df: DataFrame, *columns: str, rows: int = PART_ROWS) -> DataFrame:
    """``df`` dealt by ``columns`` to parts of about ``rows`` rows, as many as it takes.

    For aggregates with a large state per group (a sketch beside a distinct
    count has one for each value): a task then has few groups however large the
    table is, and the states themselves are not shuffled.
    """
    return df.repartition(max(1, -(-df.count() // rows)), *columns)


def sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """Run Spark SQL; write ``{name}`` in the text for each table passed.

    ``sql(spark, "SELECT count(*) FROM {dataset}", dataset=df)``. Tables are
    bound to this query only, so callers cannot see each other's tables.
    """
    return spark.sql(query, **tables) if tables else spark.sql(query)
