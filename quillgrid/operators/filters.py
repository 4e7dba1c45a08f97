"""Row filters. Conditions are combined with AND only.

Text is compared trimmed and without case. Filters on numeric columns use the
bare column, so they are pushed down to the parquet scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.values import (
    ROW_ID,
    WORD,
    all_of,
    any_of,
    as_number,
    data_columns,
    folded,
    given_number,
    is_numeric,
    number_literal,
    other_columns,
    parse_number,
    whole_word,
)

_COMPARE = {
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
}


@dataclass(frozen=True)
class Condition:
    """``column operator value``; ``exact`` asks for whole-cell text equality."""

    column: str
    operator: str
    value: object
    exact: bool = False


def _literal(df: DataFrame, name: str, number: int | float) -> Column:
    return number_literal(df.schema[name].dataType, number)


def compare(df: DataFrame, condition: Condition) -> Column:
    """The predicate of one condition; may be null, which a filter drops."""
    name, op, value = condition.column, condition.operator, condition.value
    if name not in df.columns:
        raise ValueError(f"no column named {name!r}")
    if op in _COMPARE:
        number = given_number(value)
        if number is None:
            raise ValueError(f"{value!r} is not a number")
        return _COMPARE[op](as_number(df, name), _literal(df, name, number))
    if op == "!=":
        return _differs(df, name, value)
    if op != "==":
        raise ValueError(f"unknown operator {op!r}")
    number = given_number(value)
    if is_numeric(df, name):
        if number is None:
            raise ValueError(f"{value!r} is not a number")
        return F.col(f"`{name}`") == _literal(df, name, number)
    if condition.exact:
        return folded(F.col(f"`{name}`")) == F.lit(str(value).strip().lower())
    if isinstance(value, (int, float)):
        return parse_number(F.col(f"`{name}`")) == F.lit(float(value))
    return _contains(df, name, str(value))


def _differs(df: DataFrame, name: str, value: object) -> Column:
    """Not equal; a null cell differs from every value and is kept."""
    number = given_number(value)
    if is_numeric(df, name) and number is not None:
        return ~F.col(f"`{name}`").eqNullSafe(_literal(df, name, number))
    return ~folded(F.col(f"`{name}`")).eqNullSafe(F.lit(str(value).strip().lower()))


def _contains(df: DataFrame, name: str, value: str) -> Column:
    """Whole-word match; a plain substring match when no cell has the word.

    Whether any cell has the word is an EXISTS subquery: it stops at the first
    hit and needs no join.
    """
    cell = F.lower(F.col(f"`{name}`").cast("string"))
    wanted = value.lower()
    word = cell.rlike(whole_word(re.escape(wanted)))
    return word | (cell.contains(wanted) & ~df.where(word).select(F.lit(1)).limit(1).exists())


def filter_all(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    """Rows that meet every condition; no conditions keeps every row."""
    if not conditions:
        return df
    return df.where(all_of([compare(df, c) for c in conditions]))


def filter_between(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Strictly between two bounds ("over 40 and under 60")."""
    return filter_all(df, [Condition(column, ">", low), Condition(column, "<", high)])


def rows_with_null(df: DataFrame, column: str | None = None, rid: str = ROW_ID) -> DataFrame:
    """Rows with a null in one column, or in any column but the row id."""
    names = [column] if column else data_columns(df, rid)
    return df.where(any_of([F.lit(False)] + [F.col(f"`{n}`").isNull() for n in names]))


def drop_null_rows(df: DataFrame, rid: str = ROW_ID) -> DataFrame:
    """Rows without any null cell; a missing row id doesn't count."""
    return df.where(all_of([F.lit(True)] + [F.col(f"`{n}`").isNotNull() for n in data_columns(df, rid)]))


def null_row_count(df: DataFrame, rid: str = ROW_ID) -> DataFrame:
    """One row: how many rows ``drop_null_rows`` leaves out."""
    return rows_with_null(df, rid=rid).agg(F.count("*").alias("rows_dropped"))


# Words that turn a value hit into "everything but this value".
NEGATION = r"not|except|excluding|exclude|other than"


def filter_by_value(df: DataFrame, phrase: str, columns: list[str] | None = None) -> DataFrame:
    """"show X": find the text columns that hold a value named in ``phrase``.

    Looks for whole cell values inside the phrase, else for values sharing a
    word of three or more letters with it. One pass over the table keeps only
    the smallest and largest hit per column, enough to see one, none or several
    different values; several in the same column is an error.
    """
    columns = columns or other_columns(df)
    text = re.sub(r"[_\-]+", " ", phrase.lower())
    tokens = re.findall(r"\w+|[^\w\s]", text)
    pieces = re.findall(r"\S+", text)
    grams = {" ".join(p[i:j]) for p in (tokens, pieces) for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    long_words = {w for w in re.findall(r"[\w']+", text) if len(w) >= 3}

    def hits(kind: str) -> dict[str, str]:
        aggregates = []
        for name in columns:
            cell = folded(F.col(f"`{name}`"))
            if kind == "whole":
                hit = cell.isin(sorted(grams))
            else:
                cell_words = F.regexp_extract_all(cell, F.lit(f"((?:{WORD}|')+)"), 1)
                hit = F.arrays_overlap(cell_words, F.array(*[F.lit(w) for w in sorted(long_words)]))
            aggregates += [F.min(F.when(hit, cell)), F.max(F.when(hit, cell))]
        row = df.agg(*aggregates).first()
        found = {}
        for i, name in enumerate(columns):
            low, high = row[2 * i], row[2 * i + 1]
            if low is not None and low != high:
                raise ValueError(f"several values of {name!r} match; name one of them")
            if low is not None:
                found[name] = low
        return found

    found = (hits("whole") if grams else {}) or (hits("word") if long_words else {})
    if not found:
        raise ValueError("no column holds a value named in the phrase")
    conditions = []
    for name, value in found.items():
        negated = re.search(rf"\b(?:{NEGATION})\b.*(?<!\w){re.escape(value)}(?!\w)", text)
        conditions.append(Condition(name, "!=" if negated else "==", value, exact=True))
    return filter_all(df, conditions)
