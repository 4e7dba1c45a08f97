"""Equi-joins of two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_tables(
    a: DataFrame, b: DataFrame, left_key: str, right_key: str, how: str = "inner", suffix: str = "_b"
) -> DataFrame:
    """``a`` joined to ``b``: all columns of ``a``, then ``b`` without its key.

    ``how`` is inner, left, right or full; anything else is inner. Null keys
    never match. Right-only rows have a null key, because the right key is not
    part of the result. Columns of ``b`` whose name is taken get ``suffix``.

    A full join is written as the inner join plus the unmatched rows of both
    sides: adaptive execution can split a hot key in inner and anti joins, and on
    the kept side of a left or right join, but nowhere in a full join.
    """
    how = how.lower() if how.lower() in ("inner", "left", "right", "full") else "inner"
    taken = set(a.columns)
    renames = {c: f"{c}{suffix}" for c in b.columns if c in taken and c != right_key}
    b = b.withColumnsRenamed(renames).withColumnRenamed(right_key, "_join_key")
    match = a[f"`{left_key}`"] == b["_join_key"]
    if how != "full":
        return a.join(b, match, how).drop("_join_key")
    keys = b.select("_join_key").distinct()
    left = a.join(keys, a[f"`{left_key}`"] == keys["_join_key"], "left_anti")
    keys = a.select(F.col(f"`{left_key}`").alias("_left_key")).distinct()
    right = b.join(keys, b["_join_key"] == keys["_left_key"], "left_anti").drop("_join_key")
    return a.join(b, match, "inner").drop("_join_key").unionByName(left, allowMissingColumns=True).unionByName(right, allowMissingColumns=True)
