"""Adding, editing and removing columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.values import (
    as_number,
    folded,
    given_number,
    is_numeric,
    number_literal,
    parse_number,
    same_rows,
    without,
)
from quillgrid.operators.aggregates import summarize
from quillgrid.operators.filters import Condition, compare
from quillgrid.session import materialize


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[str(c).strip() for c in df.columns])


def drop_column(df: DataFrame, name: str) -> DataFrame:
    """Without the column; a missing column leaves the table as it is."""
    return without(df, name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns:
        raise ValueError(f"no column named {old!r}")
    if new in df.columns:
        raise ValueError(f"a column named {new!r} already exists")
    return df.withColumnRenamed(old, new)


def _constant(value: object) -> Column:
    """A literal: text that reads as a number becomes one, other text stays."""
    if not isinstance(value, str):
        return F.lit(value)
    try:
        return F.lit(float(value.replace("$", "").replace(",", "").strip()))
    except ValueError:
        return F.lit(value)


def _new_name(df: DataFrame, name: str) -> None:
    if name in df.columns:
        raise ValueError(f"a column named {name!r} already exists")


def add_constant(df: DataFrame, name: str, value: object) -> DataFrame:
    _new_name(df, name)
    return df.withColumn(name, _constant(value))


# The four operations and their spelled-out names.
OPERATIONS = {
    "+": "+", "plus": "+",
    "-": "-", "minus": "-",
    "*": "*", "times": "*", "multiplied by": "*",
    "/": "/", "divided by": "/",
}


def _operand(df: DataFrame, side: str | float) -> Column:
    if isinstance(side, str):
        if side in df.columns:
            return as_number(df, side)
        side = float(side.replace("$", "").replace(",", ""))
    return F.lit(side)


def add_formula(df: DataFrame, name: str, left: str | float, operation: str, right: str | float) -> DataFrame:
    """New column ``left operation right``; division by zero gives null."""
    _new_name(df, name)
    a, b = _operand(df, left), _operand(df, right)
    symbol = OPERATIONS[operation.strip().lower()]
    values = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}
    return df.withColumn(name, values[symbol]())


def add_group_stat(df: DataFrame, name: str, key: str, value: str, func: str) -> DataFrame:
    """Each row gets its group's statistic, rounded to two decimals.

    Aggregate and join back rather than a window: the aggregate is combined
    before the shuffle, and the table itself is not moved when the group table
    is small. A hot group is therefore never gathered in one task.
    """
    _new_name(df, name)
    stat = summarize(df, [key], [(func, value, "_stat")])
    stat = stat.select(F.col(f"`{key}`"), F.bround(F.col("_stat").cast("double"), 2).alias(name))
    return same_rows(df, materialize(stat, "group-stat"), [key], "left")


def derived_column_mismatches(df: DataFrame, existing: str, expected: Column) -> DataFrame:
    """One row: how many values of ``existing`` differ from ``expected``.

    If every value on both sides is a number (or missing) they are compared as
    numbers within a tolerance, otherwise as text; missing equals missing.
    """
    pair = df.select(F.col(f"`{existing}`").alias("_a"), expected.alias("_b"))
    numeric = all(isinstance(pair.schema[c].dataType, T.NumericType) for c in ("_a", "_b"))
    a = F.col("_a").cast("double") if numeric else parse_number(F.col("_a"))
    b = F.col("_b").cast("double") if numeric else parse_number(F.col("_b"))
    # Absolute and relative tolerance.
    close = F.abs(a - b) <= 0.005 + 1e-9 * F.abs(b)
    both_null = F.col("_a").isNull() & F.col("_b").isNull()
    same_number = F.coalesce(close, F.lit(False)) | both_null
    same_text = F.col("_a").cast("string").eqNullSafe(F.col("_b").cast("string"))
    bad_text = (F.col("_a").isNotNull() & a.isNull()) | (F.col("_b").isNotNull() & b.isNull())
    counts = pair.agg(
        F.count_if(bad_text).alias("_text"),
        F.count_if(~same_number).alias("_number_diff"),
        F.count_if(~same_text).alias("_text_diff"),
    )
    return counts.select(
        F.when(F.col("_text") == 0, F.col("_number_diff")).otherwise(F.col("_text_diff")).alias("mismatches")
    )


def verify_derived_column(df: DataFrame, existing: str, expected: Column) -> DataFrame:
    """Keep the table if the existing column already holds these values."""
    if derived_column_mismatches(df, existing, expected).first()[0]:
        raise ValueError(f"a column named {existing!r} already exists with other values")
    return df


def _fits(df: DataFrame, name: str, value: object) -> Column:
    """The new value as a literal, in the column's own type when it fits."""
    kind = df.schema[name].dataType
    if value is None:
        return F.lit(None).cast(kind)
    if not isinstance(kind, T.NumericType):
        return F.lit(value)
    number = given_number(value)
    if number is None:
        return F.lit(value)
    new = number_literal(kind, number)
    return new.cast(kind) if isinstance(kind, T.IntegralType) and number == number // 1 else new


def _set(df: DataFrame, name: str, new: Column, where: Column) -> Column:
    """``new`` where the condition holds; mixed kinds fall back to text."""
    old = F.col(f"`{name}`")
    kind = df.schema[name].dataType
    new_kind = df.select(new.alias("_n")).schema["_n"].dataType
    numbers = isinstance(kind, T.NumericType) and isinstance(new_kind, T.NumericType)
    if kind != new_kind and not numbers:
        old, new = old.cast("string"), new.cast("string")
    return F.when(where, new).otherwise(old)


def set_all_values(df: DataFrame, name: str, value: object) -> DataFrame:
    """One value for the whole column; ``None`` empties it."""
    if name not in df.columns:
        raise ValueError(f"no column named {name!r}")
    return df.withColumn(name, _fits(df, name, value))


def update_where(df: DataFrame, target: str, value: object, where: Condition) -> DataFrame:
    """``target = value`` in the rows meeting a numeric condition.

    The condition column is read as numbers; ``!=`` also holds for null cells.
    ``value=None`` empties the cells.
    """
    hit = update_condition(df, where)
    return df.withColumn(target, _set(df, target, _fits(df, target, value), hit))


def update_condition(df: DataFrame, where: Condition) -> Column:
    if where.operator in ("==", "!=") and not is_numeric(df, where.column):
        number = as_number(df, where.column)
        same = number.eqNullSafe(F.lit(float(where.value)))
        return F.coalesce(same if where.operator == "==" else ~same, F.lit(False))
    return F.coalesce(compare(df, where), F.lit(False))


def updated_rows(df: DataFrame, where: Condition) -> DataFrame:
    """One row: how many rows ``update_where`` changes."""
    return df.agg(F.count_if(update_condition(df, where)).alias("rows_updated"))


def replace_value(df: DataFrame, name: str, old: str, new: object) -> DataFrame:
    """Replace cells equal to ``old`` (trimmed, any case); others stay."""
    if name not in df.columns:
        raise ValueError(f"no column named {name!r}")
    return df.withColumn(name, _set(df, name, _fits(df, name, new), _equals(name, old)))


def _equals(name: str, old: str) -> Column:
    hit = folded(F.col(f"`{name}`")) == F.lit(str(old).strip().lower())
    return F.coalesce(hit, F.lit(False))


def replaced_cells(df: DataFrame, name: str, old: str) -> DataFrame:
    """One row: how many cells ``replace_value`` changes."""
    return df.agg(F.count_if(_equals(name, old)).alias("cells_replaced"))
