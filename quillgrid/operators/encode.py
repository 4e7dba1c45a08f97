"""Turning text columns into numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.values import ROW_ID, text_columns, without
from quillgrid.operators.ordering import with_position
from quillgrid.session import materialize

# Fixed value: the text a missing cell is encoded as.
MISSING = "nan"


def encode(df: DataFrame, method: str = "onehot", cols: list[str] | None = None, max_values: int = 1000) -> DataFrame:
    cols = text_columns(df) if cols is None else cols
    if method == "onehot":
        return encode_onehot(df, cols, max_values)
    return encode_label(df, cols) if method == "label" else df


def encode_onehot(df: DataFrame, cols: list[str], max_values: int = 1000) -> DataFrame:
    """Each text column becomes 0/1 columns ``{column}_{value}``.

    Values are sorted and the first is left out; a missing cell is 0 everywhere.
    The value lists decide the schema and are collected, found in one pass over
    all columns; more than ``max_values`` values in a column are an error, not a
    cut. Cells are compared as text.
    """
    if not cols:
        return df
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{n}`").cast("string").alias("v")) for i, n in enumerate(cols)])
    pairs = df.select(F.explode(cells).alias("_c")).select("_c.*").where(F.col("v").isNotNull()).distinct()
    pairs = materialize(pairs, "onehot-values")
    crowded = pairs.groupBy("i").count().where(F.col("count") > max_values).orderBy("i").first()
    if crowded is not None:
        raise ValueError(f"{cols[crowded['i']]!r} has more than {max_values} values; encode it as labels instead")
    values: list[list[str]] = [[] for _ in cols]
    for r in pairs.orderBy("i", "v").collect():  # max_values for each column at most
        values[r["i"]].append(r["v"])
    out = df
    for name, own in zip(cols, values):
        cell = F.col(f"`{name}`").cast("string")
        flags = [F.coalesce((cell == F.lit(v)).cast("int"), F.lit(0)).alias(f"{name}_{v}") for v in own[1:]]
        out = without(out.select("*", *flags), name)
    return out


def encode_onehot_long(df: DataFrame, cols: list[str] | None = None, rid: str = ROW_ID) -> DataFrame:
    """One-hot cells that are 1, as rows ``rid, column, value, place``: any number of values.

    ``place`` counts a column's values in sorted order from 0; the first value
    and missing cells have no row, as they are 0 everywhere in the wide form.
    The distinct values of all columns are found in one pass and numbered by
    one distributed sort.
    """
    cols = text_columns(df, rid) if cols is None else cols
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("value")) for n in cols])
    long = df.select(F.col(f"`{rid}`"), F.explode(cells).alias("_c")).select(f"`{rid}`", "_c.*").where(F.col("value").isNotNull())
    placed = with_position(long.select("column", "value").distinct(), [F.col("column").asc(), F.col("value").asc()], "_place")
    first = placed.groupBy("column").agg(F.min("_place").alias("_first"))
    places = placed.join(first, "column").select("column", "value", (F.col("_place") - F.col("_first")).alias("place"))
    return long.join(materialize(places.where("place > 0"), "onehot-places"), ["column", "value"]).select(
        f"`{rid}`", "column", "value", "place"
    )


def encode_label(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each text column becomes the rank (from 0) of its value in sorted order.

    The distinct values of all columns are found in one pass, numbered by one
    distributed sort and joined back column by column; Spark broadcasts the
    numbers when they are small.
    """
    if not cols:
        return df
    value = {n: F.coalesce(F.col(f"`{n}`"), F.lit(MISSING)) for n in cols}
    cells = F.array(*[F.struct(F.lit(n).alias("_column"), v.alias("_value")) for n, v in value.items()])
    values = df.select(F.explode(cells).alias("_c")).select("_c.*").distinct()
    placed = with_position(values, [F.col("_column").asc(), F.col("_value").asc()], "_code")
    first = placed.groupBy(F.col("_column").alias("_of")).agg(F.min("_code").alias("_first"))
    codes = placed.join(first, F.col("_column") == F.col("_of")).select(
        "_column", "_value", (F.col("_code") - F.col("_first")).cast("long").alias("_code")
    )
    codes = materialize(codes, "labels")
    out = df
    for name in cols:
        own = codes.where(F.col("_column") == name).select("_value", "_code")
        keyed = out.withColumn("_key", value[name])
        joined = keyed.join(own, keyed["_key"] == own["_value"], "left")
        out = joined.withColumn(name, F.col("_code")).drop("_key", "_value", "_code")
    return out
