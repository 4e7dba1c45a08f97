"""CSV records with line breaks inside quotes, found by many tasks per file.

Whether a line begins inside a quoted cell depends on all lines before it. A
line maps the two states, outside or inside, to two states; so does a block of a
file, by composition. One pass finds each block's map, a window over the (few)
blocks of a file combines them, and a second pass, which now knows how each block
begins, joins lines to records. A record that crosses blocks is put together from
one piece of each.
"""

from __future__ import annotations

import sys

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.session import materialize

# Functions sent to the workers travel by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUOTE = '"'


def ends_inside(line: str, inside: bool, separator: str = ",") -> bool:
    """Is a quoted cell open behind the line? A quote opens at the start of a cell only; a doubled one is text."""
    at, n = 0, len(line)
    while True:
        if not inside and at < n and line[at] == QUOTE:
            inside, at = True, at + 1
        if inside:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if line.startswith(QUOTE, at + 1):
                at += 2
                continue
            inside = False
        at = line.find(separator, at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, value``: lines in the order of the file inside a block."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _block_maps(lines: DataFrame, separator: str) -> DataFrame:
    """``file, block, outside, inside, breaks``: the state behind a block for both states before
    it, and whether some line, begun outside, leaves a cell open.

    Lines without a quote change nothing and stay out.
    """
    names = ["file", "block", "outside", "inside", "breaks"]

    def run(batches):
        now, states, breaks = None, [False, True], False

        def done():
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*now, *states, breaks), kinds, strict=True)], names=names)

        for batch in batches:
            for file, block, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (file, block) != now:
                    if now is not None:
                        yield done()
                    now, states, breaks = (file, block), [False, True], False
                ends = [ends_inside(line, s, separator) for s in (False, True)]
                states, breaks = [ends[s] for s in states], breaks or ends[0]
        if now is not None:
            yield done()

    quoted = lines.filter(F.contains("value", F.lit(QUOTE)))
    return quoted.mapInArrow(run, "file long, block long, outside boolean, inside boolean, breaks boolean")


def _start_states(maps: DataFrame) -> DataFrame:
    """``file, block, breaks, behind``: the state behind each block of ``maps``, from the file's beginning on.

    A block either ends in one state whatever comes before, or keeps or swaps
    the state: so the last block of the first kind and the number of swaps since
    it decide.
    """
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swap = (F.col("outside") & ~F.col("inside")).cast("int")
    known = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("state"), F.col("swaps")))
    counted = maps.withColumn("swaps", F.sum(swap).over(so_far)).withColumn("known", known)
    last = F.last("known", ignorenulls=True).over(so_far)
    since = F.col("swaps") - F.coalesce(last["swaps"], F.lit(0))
    return counted.select("file", "block", "breaks", (F.coalesce(last["state"], F.lit(False)) != (since % 2 == 1)).alias("behind"))


def quoted_records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame | None:
    """``record, first``: the records of CSV files, line breaks inside quotes kept; ``first``: of its file.

    None if no record has a line break, so that a plain reader will do.
    """
    lines = _lines(spark, path)
    states = materialize(_start_states(_block_maps(lines, separator)), "csv-blocks")
    if states.filter("breaks").isEmpty():
        return None
    # one short row for each block that has a quote
    rows = states.select("file", "block", "behind").collect()
    known = sorted((r["file"], r["block"]) for r in rows)
    open_blocks = {(r["file"], r["block"]) for r in rows if r["behind"]}
    shared = spark.sparkContext.broadcast((open_blocks, known))

    def run(batches):
        from bisect import bisect_left

        open_blocks, known = shared.value
        now, inside, held, lead, first = None, False, [], False, False

        def state_before(file, block):
            """Behind the last block with quotes before this one; none: the file's beginning, outside."""
            at = bisect_left(known, (file, block)) - 1
            return at >= 0 and known[at][0] == file and known[at] in open_blocks

        out: list[tuple] = []

        def put(whole: bool):
            # kind 0: a whole record, 1: more of one that began in an earlier block, 2: the beginning of one that goes on
            if held:
                out.append((*now, 1 if lead else 0 if whole else 2, "\n".join(held), first))

        def flush():
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "block", "kind", "record", "first"])

        for batch in batches:
            files, blocks, values = (c.to_pylist() for c in batch.columns)
            quotes = pc.match_substring(batch.column(2), QUOTE).to_pylist()
            for file, block, line, has in zip(files, blocks, values, quotes, strict=True):
                if (file, block) != now:
                    put(not inside)
                    now, held = (file, block), []
                    inside = state_before(file, block)
                    lead, first = inside, block == 0
                elif not inside and held:
                    put(True)
                    held, lead, first = [], False, False
                if not inside and not held and not line.strip():
                    continue  # a blank line between records
                held.append(line)
                if has:
                    inside = ends_inside(line, inside, separator)
            yield flush()
        put(not inside)
        yield flush()

    pieces = materialize(lines.mapInArrow(run, "file long, block long, kind int, record string, first boolean"), "csv-records")
    # the rest of a record has the number of its beginning in the file
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = pieces.filter("kind > 0").withColumn("number", F.sum((F.col("kind") == 2).cast("int")).over(order))
    glued = split.groupBy("file", "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))), lambda x: x["record"]), "\n").alias("record"),
        F.max("first").alias("first"),
    )
    records = pieces.filter("kind = 0").select("record", "first").unionByName(glued.select("record", "first"))
    return records.select(F.regexp_replace("record", "\r$", "").alias("record"), "first")
