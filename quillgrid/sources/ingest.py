"""Reading messy files and settling column types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.values import (
    other_columns,
    parse_number,
    strip,
    text_columns,
)
from quillgrid.sources.records import quoted_records

# Cell texts that mean "missing" in a CSV file, and the share of
# filled cells that must parse for a text column to count as numeric.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
NUMERIC_SHARE = 0.8

_TRUTH = ["True", "TRUE", "true", "False", "FALSE", "false"]


def csv_scan(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False
) -> DataFrame:
    """Read CSV with a header row: missing tokens to null, then typed columns.

    Everything is read as text first, because the missing tokens would spoil
    Spark's own inference. One aggregate over the file then decides per column:
    whole numbers, numbers, true/false or text. Pass ``schema`` to skip it.
    Quoted cells may hold line breaks; a file is read by many tasks all the
    same (see ``records``). ``multi_line`` leaves that to Spark, one task a file.
    """
    raw = _cells(spark, path, multi_line)
    names = raw.columns
    text = raw.select(*[F.when(~F.col(f"`{n}`").isin(NA_TOKENS), F.col(f"`{n}`")).alias(n) for n in names])
    if schema is not None:
        return text.select(*[_typed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema.fields])
    checks = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        checks += [
            F.count(c).alias(f"filled{i}"),
            F.count_if(_whole_number(c).isNotNull()).alias(f"whole{i}"),
            F.count_if(_plain_number(c).isNotNull()).alias(f"number{i}"),
            F.count_if(c.isin(_TRUTH)).alias(f"truth{i}"),
        ]
    seen = text.agg(*checks).first()
    kinds: list[T.DataType] = []
    for i in range(len(names)):
        filled = seen[f"filled{i}"]
        if filled and seen[f"whole{i}"] == filled:
            kinds.append(T.LongType())
        elif not filled or seen[f"number{i}"] == filled:
            kinds.append(T.DoubleType())
        elif seen[f"truth{i}"] == filled:
            kinds.append(T.BooleanType())
        else:
            kinds.append(T.StringType())
    return text.select(*[_typed(F.col(f"`{n}`"), k).alias(n) for n, k in zip(names, kinds)])


def _cells(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Every cell as text, under the names of the header."""
    whole = spark.read.options(header=True, escape='"', multiLine=True)
    records = None if multi_line else quoted_records(spark, path)
    if records is None:
        return whole.option("multiLine", multi_line).csv(path)
    names = whole.csv(path).columns  # reads no further than the first record
    cells = ", ".join(f"c{i} string" for i in range(len(names)))
    row = F.from_csv("record", cells, {"escape": '"', "multiLine": "true"})
    return records.where("not first").select(row.alias("_row")).select("_row.*").toDF(*names)


def _whole_number(col: Column) -> Column:
    """A whole number that 64 bits hold."""
    return F.when(col.rlike(r"^\s*[+-]?\d+\s*$"), strip(col).try_cast("bigint"))


def _plain_number(col: Column) -> Column:
    """A number as written in a file: no currency sign, no thousands comma."""
    return F.when(~col.rlike("[$,]"), parse_number(col))


def _typed(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.IntegralType):
        return strip(col).try_cast(kind)
    if isinstance(kind, T.NumericType):
        return _plain_number(col).cast(kind)
    return col if isinstance(kind, T.StringType) else strip(col).try_cast(kind)


def csv_sink(df: DataFrame, path: str) -> str:
    """Write the table as CSV with a header: one file per partition, no index."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(header=True, escape='"', **keep).csv(path)
    return path


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing; left in place it would poison sums and maxima."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.nanvl(F.col(f"`{n}`"), F.lit(None).cast("double")) for n in floats}) if floats else df


def with_row_ids(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Give each row an id. Call once and store the result: the ids depend on
    the file layout, so a second call may number rows differently."""
    return df.select(F.monotonically_increasing_id().alias(name), "*")


def number_shares(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per text column the share of filled cells that read as numbers; one pass."""
    columns = columns if columns is not None else text_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, share double, is_numeric boolean")
    shares = []
    for n in columns:
        c = F.col(f"`{n}`")
        filled = c.isNotNull() & (strip(c) != "")
        shares.append(F.avg(F.when(filled, parse_number(c).isNotNull().cast("int"))).alias(n))
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("share")) for n in columns])
    rows = df.agg(*shares).select(F.explode(cells).alias("_s")).select("_s.*")
    return rows.withColumn("is_numeric", F.coalesce(F.col("share") >= NUMERIC_SHARE, F.lit(False)))


def number_like_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Text columns to treat as numbers. Collects one row per text column."""
    texts = [c for c in text_columns(df) if columns is None or c in columns]
    return [r["column"] for r in number_shares(df, texts).collect() if r["is_numeric"]]


def infer_numeric(df: DataFrame) -> DataFrame:
    """The table with number-like text columns turned into doubles."""
    return df.withColumns({n: parse_number(F.col(f"`{n}`")) for n in number_like_columns(df)})


def value_dictionary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct trimmed values of every non-numeric column: ``(column, value)``."""
    columns = columns or other_columns(df)
    cells = F.array(
        *[F.struct(F.lit(n).alias("column"), strip(F.col(f"`{n}`").cast("string")).alias("value")) for n in columns]
    )
    return df.select(F.explode(cells).alias("_c")).select("_c.*").where(F.col("value").isNotNull()).distinct()


def preview(df: DataFrame, n: int = 10, rid: str = "_rid") -> DataFrame:
    """The first n rows in table order."""
    return df.orderBy(F.col(f"`{rid}`")).limit(n)


