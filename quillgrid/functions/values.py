"""Column expressions shared by the operators: numbers, text, rounding."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a number once "$" and "," are removed, and the
# characters stripped from the ends of a text cell.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
BLANKS = " \t\n\r\f\x0b"

# A word character in any script, written so that every regex engine agrees.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(BLANKS))


def given_number(value: object) -> int | float | None:
    """A number as given by a caller: whole numbers stay whole, however many digits."""
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return value
    text = str(value).replace("$", "").replace(",", "").strip()
    try:
        return int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)
    except ValueError:
        return None


def number_literal(kind: T.DataType, number: int | float) -> Column:
    """A whole number next to a whole-number column stays whole, so that it is
    compared exactly, without a cast, and pushed down. Others are doubles."""
    whole = isinstance(kind, T.IntegralType) and number == number // 1 and -(2**63) <= number < 2**63
    return F.lit(int(number)) if whole else F.lit(float(number))


def parse_number(col: Column) -> Column:
    """Text such as ``$1,234`` to a double; anything else becomes null.

    ``try_cast`` alone accepts Java spellings such as ``1d``, so the text has to
    look like a number first.
    """
    text = strip(F.regexp_replace(col.cast("string"), "[$,]", ""))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def quoted(names: list[str]) -> list[Column]:
    """Columns by name, whatever characters the names have."""
    return [F.col(f"`{n}`") for n in names]


def without(df: DataFrame, name: str) -> DataFrame:
    """Drop one column, whatever characters its name has."""
    return df.select(*quoted([c for c in df.columns if c != name]))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


# The column that holds row ids, unless a caller names another one. It is the
# only column that statistics, profiles and repairs leave out.
ROW_ID = "_rid"


def data_columns(df: DataFrame, rid: str = ROW_ID) -> list[str]:
    """Every column but the row id, in table order."""
    return [c for c in df.columns if c != rid]


def numeric_columns(df: DataFrame, rid: str = ROW_ID) -> list[str]:
    return [c for c in data_columns(df, rid) if is_numeric(df, c)]


def text_columns(df: DataFrame, rid: str = ROW_ID) -> list[str]:
    return [c for c in data_columns(df, rid) if isinstance(df.schema[c].dataType, T.StringType)]


def other_columns(df: DataFrame, rid: str = ROW_ID) -> list[str]:
    """Every non-numeric column (text, boolean, dates)."""
    return [c for c in data_columns(df, rid) if not is_numeric(df, c)]


def as_number(df: DataFrame, name: str) -> Column:
    """The numeric view of a column.

    A numeric column is returned untouched, so comparisons on it still reach
    the parquet scan; a text column is parsed.
    """
    col = F.col(f"`{name}`")
    return col if is_numeric(df, name) else parse_number(col)


def folded(col: Column) -> Column:
    """Trimmed lower-case text, the form in which cells are compared."""
    return F.lower(strip(col.cast("string")))


def whole_word(pattern: str) -> str:
    """``pattern`` standing alone as whole words (no look-around needed)."""
    return f"(?:^|{NOT_WORD})(?:{pattern})(?:$|{NOT_WORD})"


def words_of(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(f"({WORD}+)"), 1)


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates)


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def display_round(col: Column) -> Column:
    """Metrics are shown with four decimals."""
    return F.bround(col, 4)


def display_text(df: DataFrame, name: str) -> Column:
    """The printed form of a metric: four decimals, ``N/A`` when missing."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        col = display_round(col)
    return F.coalesce(col.cast("string"), F.lit("N/A"))


def same_rows(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null equals null; keeps one copy of the keys."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = all_of([left[f"`{k}`"].eqNullSafe(other[f"`_right_{k}`"]) for k in keys])
    return left.join(other, condition, how).drop(*[f"_right_{k}" for k in keys])
