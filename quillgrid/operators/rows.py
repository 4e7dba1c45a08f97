"""Adding rows and removing duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.values import ROW_ID, any_of, data_columns, given_number, parse_number, quoted, strip
from quillgrid.operators.ordering import with_position


def _field(kind: T.DataType, name: str) -> Column:
    """A text cell in the column's type; null when it doesn't fit.

    Whole numbers are read digit by digit, so none is rounded; ``3.0`` is whole,
    ``3.7`` isn't.
    """
    raw = F.col(f"`{name}`")
    if isinstance(kind, T.IntegralType):
        digits = strip(F.regexp_replace(raw, "[$,]", ""))
        number = parse_number(raw)
        whole = F.when((number == F.floor(number)) & (F.abs(number) < 2.0**53), number.try_cast("bigint"))
        return F.when(digits.rlike(r"^[+-]?\d+$"), digits.try_cast(kind)).otherwise(whole.try_cast(kind))
    if isinstance(kind, T.NumericType):
        return parse_number(raw).try_cast(kind)
    return raw.try_cast(kind)


def split_rows(df: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Check a batch of text rows against the table's types.

    Returns the accepted rows (typed) and the rejected ones (as given): a row
    is rejected when a given cell does not fit its column's type (no number, a
    fraction for a whole-number column, no date). Columns the table does not
    have are ignored; columns not given become null.
    """
    known = [f for f in df.schema.fields if f.name in rows.columns]
    cells = {f.name: _field(f.dataType, f.name) for f in known}
    bad = any_of([F.lit(False)] + [F.col(f"`{n}`").isNotNull() & c.isNull() for n, c in cells.items()])
    given = any_of([F.lit(False)] + [F.col(f"`{n}`").isNotNull() for n in cells])
    accepted = rows.where(~bad & given).select(*[c.alias(n) for n, c in cells.items()])
    return accepted, rows.where(bad | ~given)


def append_rows(df: DataFrame, rows: DataFrame, rid: str = ROW_ID) -> DataFrame:
    """The table plus the accepted rows of a batch; unknown cells are null.

    If the table has row ids and the batch has none, new rows are numbered from
    the largest id on, in the order of their cells.
    """
    accepted, _ = split_rows(df, rows)
    if rid in df.columns and rid not in accepted.columns:
        order = [F.col(f"`{c}`").asc_nulls_last() for c in accepted.columns]
        accepted = _numbered(df, with_position(accepted, order, rid), rid)
    return df.unionByName(accepted, allowMissingColumns=True)


def _numbered(df: DataFrame, rows: DataFrame, rid: str) -> DataFrame:
    last = df.agg(F.coalesce(F.max(f"`{rid}`"), F.lit(-1))).scalar()
    return rows.withColumn(rid, (last + F.col(f"`{rid}`")).cast(df.schema[rid].dataType))


def append_row(df: DataFrame, values: dict[str, object], rid: str = ROW_ID) -> DataFrame:
    """The table plus one labelled row; a cell that doesn't fit its column is an error.

    A table with row ids gives the row the next one, unless ``values`` has it.
    """
    known = {k: (None if v is None else str(v)) for k, v in values.items() if k in df.columns}
    if not known:
        raise ValueError("give row values with column labels")
    for name, text in known.items():
        kind = df.schema[name].dataType
        if text is None or not isinstance(kind, T.NumericType):
            continue
        number = given_number(text)
        if number is None:
            raise ValueError(f"{text!r} is not a number for {name!r}; the row was not added")
        if isinstance(kind, T.IntegralType) and number != number // 1:
            raise ValueError(f"{text!r} is not a whole number for {name!r}; the row was not added")
    one = df.sparkSession.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in known.items()])
    accepted, rejected = split_rows(df, one)
    if not rejected.isEmpty():
        raise ValueError("a value does not fit its column; the row was not added")
    if rid in df.columns and rid not in known:
        accepted = _numbered(df, accepted.withColumn(rid, F.lit(1)), rid)
    return df.unionByName(accepted, allowMissingColumns=True)


def drop_duplicates(df: DataFrame, rid: str = ROW_ID) -> DataFrame:
    """Without exact repeats; nulls count as equal.

    Row ids don't make rows different: the smallest id of equal rows stays.
    Copies are combined before the shuffle.
    """
    names = data_columns(df, rid)
    if rid not in df.columns:
        return df.dropDuplicates()
    kept = df.groupBy(*quoted(names)).agg(F.min(f"`{rid}`").alias(rid))
    return kept.select(*quoted(df.columns))
