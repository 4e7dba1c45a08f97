"""Run queries and their DuckDB checks side by side and compare whole results."""

from __future__ import annotations

import datetime
import math
import time

import duckdb
from pyspark.sql import types as T

from registry.base import TABLES

_TYPES = {
    T.LongType: "BIGINT",
    T.IntegerType: "INTEGER",
    T.ShortType: "SMALLINT",
    T.DoubleType: "DOUBLE",
    T.FloatType: "FLOAT",
    T.StringType: "VARCHAR",
    T.BooleanType: "BOOLEAN",
    T.DateType: "DATE",
    T.TimestampType: "TIMESTAMP",
    T.TimestampNTZType: "TIMESTAMP",
}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, query, oracle: str) -> tuple[str, str, float, float]:
    """(status, detail, spark seconds, duckdb seconds); status is ok when equal."""
    start = time.time()
    df = query(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    spark_time = time.time() - start
    start = time.time()
    cursor = con.execute(oracle)
    expected_names = [d[0] for d in cursor.description]
    expected_types = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    duck_time = time.time() - start
    names = df.columns
    if sorted(names) != sorted(expected_names):
        return "columns", f"{sorted(names)} != {sorted(expected_names)}", spark_time, duck_time
    kinds = {f.name: _TYPES.get(type(f.dataType), f.dataType.simpleString()) for f in df.schema.fields}
    wrong = {n: (kinds[n], expected_types[n]) for n in names if kinds[n] != expected_types[n]}
    if wrong:
        return "types", str(wrong), spark_time, duck_time
    a, b = _table(names, rows), _table(expected_names, expected)
    if a != b:
        extra, missing = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return "values", f"{len(a)} vs {len(b)} rows; only spark {extra}; only sql {missing}", spark_time, duck_time
    return "ok", f"{len(a)} rows", spark_time, duck_time
