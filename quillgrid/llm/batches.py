"""Arrow batches in small pieces, so that a worker's memory doesn't follow the batch size."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE_BYTES = 512 << 10
SHORT_ROWS = 500
BATCH_BYTES = 1 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands rows to Python in Arrow batches of about ``BATCH_BYTES``, one row at least.

    By default a batch has up to 10,000 rows or 64 MB, so whole texts fill buffers
    outside the heap, doubled as they grow, for each task, and again in its Python
    worker. The limit must hold when a result is computed, so it stays set; one
    that the session has already is kept.
    """
    conf = df.sparkSession.conf
    if conf.get(_LIMIT, None) is None:
        conf.set(_LIMIT, str(BATCH_BYTES))
    return df


def pieces(batches, text: int, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text column number ``text`` holds about ``size`` bytes; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // size
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def short(batches, rows: int = SHORT_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, for work that makes many rows of each."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


@contextmanager
def lending(spark: SparkSession) -> Iterator[Callable]:
    """Broadcasts that are gone at the end of the block; what needs them must be stored inside it."""
    held = []

    def lend(value):
        held.append(spark.sparkContext.broadcast(value))
        return held[-1]

    try:
        yield lend
    finally:
        for broadcast in held:
            broadcast.destroy()


def clashing(columns, made: set[str]) -> None:
    """Refuse columns with names that an operator makes."""
    taken = {c.lower() for c in columns} & made
    if taken:
        raise ValueError(f"columns {sorted(taken)} are made here; rename yours")


def texts_of(column: pa.Array) -> list[str]:
    """The column's values, null as empty."""
    return [t or "" for t in column.to_pylist()]
