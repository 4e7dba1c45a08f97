"""Labels by the nearest prototype vector.

A few prototypes travel with the function and are scored as one matrix. More of
them are dealt to groups: each to the nearest of some pivots, which are prototypes
themselves. A vector's best angle is at most that to the nearest pivot, and a
group's members are at most its radius away from its pivot, so by the triangle
inequality some groups can't hold the best. Neighbouring groups share a block; a
vector meets the blocks of its other groups, each once, in calls of bounded size.
Where vectors have no neighbourhoods no group is left out, and the work is all pairs.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.values import quoted
from quillgrid.session import materialize

# Functions sent to the workers travel by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: a best cosine at or below this gives no label.
COSINE_LIMIT = 0.35
MOST_PROTOTYPES = 10_000  # that travel with the function
PIVOTS = 1_000
BLOCK_VECTORS = 20_000  # prototypes of one call, of at most
BLOCK_VALUES = 4_000_000  # numbers in all
CALL_VECTORS = 5_000  # vectors that they meet in one call
_SLICE = 2_000  # rows whose angles are held at a time
_SLACK = 1e-6  # radians, far above the rounding of an angle


def nearest_prototype(
    df: DataFrame, vector_col: str, prototypes: DataFrame, limit: float = COSINE_LIMIT, most: int = MOST_PROTOTYPES
) -> DataFrame:
    """Add ``label`` and ``score`` of the prototype with the greatest cosine.

    ``prototypes`` has ``label`` (text) and ``vector``; several rows per label
    are allowed, the smaller label wins a tie. Up to ``most`` rows travel with
    the function, more are searched by groups, both exactly. Vectors of another
    length than the prototypes', and null ones, have neither label nor score.
    """
    rows = prototypes.select("label", "vector").limit(most + 1).collect()
    if len(rows) > most:
        return _by_groups(df, vector_col, prototypes, limit)
    labels, matrix = _unit([r["label"] for r in rows], [r["vector"] for r in rows])
    width = matrix.shape[1] if len(rows) else -1

    @F.arrow_udf("struct<label string, score double>")
    def score(vectors: pa.Array) -> pa.Array:
        fits = np.flatnonzero(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width)
        place, best = np.full(len(vectors), -1, np.int64), np.zeros(len(vectors))
        if len(fits):
            block = _rows(vectors.take(pa.array(fits)), width)
            cosines = block @ matrix.T
            place[fits] = cosines.argmax(axis=1)
            best[fits] = cosines.max(axis=1)
        names = pa.array(labels, pa.string()).take(pa.array(place, mask=place < 0))
        return pa.StructArray.from_arrays([names, pa.array(best, mask=place < 0)], ["label", "score"])

    return _labelled(df.withColumn("_s", score(F.col(f"`{vector_col}`"))), df.columns, limit)


def _labelled(scored: DataFrame, columns: list[str], limit: float) -> DataFrame:
    accepted = F.when(F.col("_s.score") > limit, F.col("_s.label"))
    return scored.select(*quoted(columns), accepted.alias("label"), F.col("_s.score").alias("score"))


def _unit(labels: list[str], vectors: list[list[float]]) -> tuple[list[str], np.ndarray]:
    """Prototypes by label, of length 1."""
    order = sorted(range(len(labels)), key=lambda i: labels[i])
    matrix = np.asarray([vectors[i] for i in order], dtype=np.float64)
    if len(order):
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    return [labels[i] for i in order], matrix


def _rows(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    block = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
    return block / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-300)


def _by_groups(df: DataFrame, vector_col: str, prototypes: DataFrame, limit: float) -> DataFrame:
    vectors = prototypes.select("label", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    known = materialize(vectors.groupBy("vector").agg(F.min("label").alias("label")).select("label", "vector"), "prototypes")
    width = known.select(F.max(F.size("vector")).alias("n")).first()["n"]
    drawn = known.where(F.size("vector") == width).orderBy(F.xxhash64("label", "vector"), "label").limit(PIVOTS).collect()  # bounded
    _, pivots = _unit([r["label"] for r in drawn], [r["vector"] for r in drawn])

    def angles_of(batches, column):
        """Slices of the rows that have the width, and their angles to the pivots."""
        for batch in batches:
            fits = np.flatnonzero(batch.column(column).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width)
            for a in range(0, len(fits), _SLICE):
                own = batch.take(pa.array(fits[a : a + _SLICE], pa.int64()))
                yield own, np.arccos(np.clip(_rows(own.column(column), width) @ pivots.T, -1, 1))

    def deal(batches):
        for own, angles in angles_of(batches, 1):
            group = angles.argmin(axis=1)
            apart = angles[np.arange(len(group)), group]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(group.astype(np.int32)), pa.array(apart)], names=["label", "vector", "group", "apart"])

    dealt = materialize(known.mapInArrow(deal, "label string, vector array<double>, group int, apart double"), "prototype-groups")
    radius, sizes = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)  # of an empty group
    for r in dealt.groupBy("group").agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # one row for each pivot
        radius[r["group"]], sizes[r["group"]] = r["radius"], r["n"]
    first, parts, at = _blocks(pivots, sizes, max(1, min(BLOCK_VECTORS, BLOCK_VALUES // max(width or 1, 1))))

    def visit(batches):
        """The blocks in which a vector's best may be, as a list: Spark repeats the row."""
        for own, angles in angles_of(batches, 1):
            near = angles - radius <= angles.min(axis=1, keepdims=True) + _SLACK
            reached = np.zeros((len(near), at), bool)
            for group in np.flatnonzero(sizes).tolist():
                reached[:, first[group] : first[group] + parts[group]] |= near[:, group, None]
            who, block = np.nonzero(reached)
            starts = np.searchsorted(who, np.arange(len(near) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(block.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), lists], names=["id", "vector", "blocks"])

    asked = df.select(F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).where("vector is not null").distinct()
    asked = materialize(asked.select(F.monotonically_increasing_id().alias("id"), "vector"), "asked-vectors", plain=True)
    visits = materialize(asked.mapInArrow(visit, "id long, vector array<double>, blocks array<int>"), "prototype-visits")
    visits = visits.select("id", "vector", F.explode("blocks").alias("block"))
    calls = materialize(visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CALL_VECTORS).cast("int").alias("calls")), "prototype-calls")
    places = df.sparkSession.createDataFrame([(g, int(first[g]), int(parts[g])) for g in range(len(pivots))], "group int, first int, parts int")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = dealt.join(F.broadcast(places), "group").select((F.col("first") + own("vector", "parts")).alias("block"), "label", "vector")
    left = left.join(calls, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("calls") - 1)).alias("call"), "label", "vector")
    right = visits.join(calls, "block").select("block", own("id", "calls").alias("call"), "id", "vector")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(_key: tuple, block: pa.Table, some: pa.Table) -> pa.Table:
        if not block.num_rows or not some.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.float64())], names=schema.names)
        block = block.sort_by("label")
        matrix, step = _rows(block["vector"], width).T, max(1, 4_000_000 // block.num_rows)
        places, best = [], []
        asked = _rows(some["vector"], width)
        for a in range(0, len(asked), step):
            cosines = asked[a : a + step] @ matrix
            places.append(cosines.argmax(axis=1))
            best.append(cosines[np.arange(len(cosines)), places[-1]])
        return pa.table([some["id"], block["label"].take(pa.array(np.concatenate(places))), pa.array(np.concatenate(best))], names=schema.names)

    keys = ["block", "call"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)
    top = found.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "label")).alias("_b"))
    top = top.join(asked, "id").select(F.col("vector").alias("_vector"), F.struct(F.col("_b.label").alias("label"), (-F.col("_b.s")).alias("score")).alias("_s"))
    top = materialize(top, "nearest-prototypes", plain=True)
    joined = df.join(top, F.col(f"`{vector_col}`").cast("array<double>") == F.col("_vector"), "left")
    return _labelled(joined, df.columns, limit)


def _blocks(pivots: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Each group's first block and number of blocks, and how many blocks there are.

    Neighbouring groups fill a block up to ``most`` vectors, larger groups have several of their own.
    """
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    left, at, room = set(np.flatnonzero(sizes).tolist()), -1, 0
    near = pivots @ pivots.T
    here = min(left, default=-1)
    while left:
        left.discard(here)
        if sizes[here] > room:
            first[here], parts[here] = at + 1, -(-sizes[here] // most)
            at += int(parts[here])
            room = most - sizes[here] if parts[here] == 1 else 0
        else:
            first[here], room = at, room - sizes[here]
        if left:
            rest = np.fromiter(left, np.int64)
            here = int(rest[near[here, rest].argmax()])
    return first, parts, at + 1
