"""Removal of repeated passages by recompression.

Words get 64-bit names. A round names every pair of neighbours whose first
symbol falls on one side of a coin and whose second on the other (a coin per
symbol and round); from the fourth round on, runs of equal symbols are named
before. Names are hashes of what they stand for, so they agree everywhere
without a dictionary, and equal passages get the same symbols inside.

* Symbols of ``window`` words and more are passages as a whole: where Spark finds
  the same name in an earlier row, all of it is a repeat, settled without
  looking at windows. A copy of a document is settled by its last symbol alone.
* Symbols of the third round have at most eight words, and whether one begins
  at a word depends on four words to both sides. Each window picks one such
  beginning inside, by a hash of these eight words. Where no other row and no
  other place has the same eight words around a beginning, windows that picked
  it are unique; only the others are compared, by 128-bit hashes.

Runs wait until the fourth round because a run may reach out of a window;
without them, what a window picks depends on its own words.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.batches import bounded, lending, pieces
from quillgrid.llm.jaccard import Shingler, _bitmap, _held, _mix
from quillgrid.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONTEXT = 4  # words to both sides that decide whether a symbol of the third round begins
NAME_BITS = 1 << 26  # of the bitmap of repeated names; 8 MB are broadcast
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)
_LAST = (1 << 63) - 1  # stands for a null id


class Sums:
    """Hashes of any stretch of consecutive words, from sums of powers."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.lanes = []
        for base, salt in ((0x5851F42D4C957F2D, _A), (0xDA942042E4DD58B5, _B)):
            power = np.full(n + 1, base, np.uint64)
            back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
            power[0] = back[0] = 1
            power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
            values = _mix(words ^ salt) * power[:n]
            self.lanes.append((np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)]), back))

    def hash(self, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
        sums, back = self.lanes[lane]
        return _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _C)


def _pairs(symbols: np.ndarray, starts: np.ndarray, last: np.ndarray, coin: int):
    """One round of pairs: new symbols, where each starts, which end a text, and which are new."""
    side = (_mix(symbols ^ np.uint64(coin * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(63)).astype(bool)
    merge = np.zeros(len(symbols), bool)
    merge[:-1] = ~side[:-1] & side[1:] & ~last[:-1]
    at = np.flatnonzero(merge)
    symbols, last = symbols.copy(), last.copy()
    symbols[at] = _mix(symbols[at] * _A + symbols[at + 1] * _B + _C)
    last[at] = last[at + 1]
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    return symbols[keep], starts[keep], last[keep], merge[keep]


def _run_names(symbols: np.ndarray, starts: np.ndarray, last: np.ndarray):
    """One round of runs of equal symbols."""
    same = np.zeros(len(symbols), bool)  # as the symbol before, in the same text
    same[1:] = (symbols[1:] == symbols[:-1]) & ~last[:-1]
    heads = np.flatnonzero(~same)
    length = np.diff(np.append(heads, len(symbols)))
    named = symbols[heads]
    long = length > 1
    named[long] = _mix(named[long] * _C + length[long].astype(np.uint64) * _A + _B)
    return named, starts[heads], last[heads + length - 1], long


class Parse:
    """What one piece of texts has to tell: its words, anchors and long symbols."""

    def __init__(self, shingler: Shingler, raw: list[bytes], window: int):
        self.word_starts, self.word_ends, words, begin = shingler.words_of(raw)
        self.first = np.searchsorted(self.word_starts, begin)  # of each text; behind it the number of all words
        self.words, self.window, self.sums = words, window, Sums(words)

    def _rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def symbols(self):
        """Of all rounds: ``anchors`` (name, first and behind the last window) and ``long`` symbols (name, start, end)."""
        n, window = len(self.words), self.window
        row = self._rows()
        last = np.zeros(n, bool)
        last[self.first[1:][np.diff(self.first) > 0] - 1] = True
        symbols, starts = self.words, np.arange(n)
        for coin in (1, 2, 3):
            symbols, starts, last, _ = _pairs(symbols, starts, last, coin)
        anchors = self._anchors(starts, row)
        long = []
        texts = int((np.diff(self.first) > 0).sum())
        for coin in range(4, 200):
            if len(symbols) == texts:
                break
            for of_pairs in (False, True):
                symbols, starts, last, new = _pairs(symbols, starts, last, coin) if of_pairs else _run_names(symbols, starts, last)
                ends = np.append(starts[1:], n)
                pick = np.flatnonzero(new & (ends - starts >= window))
                long.append((symbols[pick], starts[pick], ends[pick]))
        names, a, b = (np.concatenate([x[i] for x in long]) if long else np.zeros(0, np.uint64 if i == 0 else np.int64) for i in range(3))
        a, b = a.astype(np.int64), b.astype(np.int64)
        # the parse proposes, the words decide: a name is also a hash of all words it covers
        return anchors, (_mix(names ^ self.sums.hash(a, b)), a, b)

    def _anchors(self, starts: np.ndarray, row: np.ndarray):
        n, window = len(self.words), self.window
        begin, behind = self.first[:-1][row], self.first[1:][row]
        places = starts[(starts - CONTEXT >= begin[starts]) & (starts + CONTEXT <= behind[starts])]
        key = self.sums.hash(places - CONTEXT, places + CONTEXT)
        rank = np.full(n, _FAR, np.uint64)
        # ties go to the left: the low bits count places
        rank[places] = (_mix(key ^ _C) & ~np.uint64((1 << 28) - 1)) | places.astype(np.uint64)
        windows = np.flatnonzero(np.arange(n) + window <= behind)
        if not len(windows):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # the smallest rank among window - 2 * CONTEXT + 1 places, by doubling
        span, width, best = window - 2 * CONTEXT + 1, 1, np.append(rank, np.full(window, _FAR, np.uint64))
        while 2 * width <= span:
            best = np.minimum(best[: len(best) - width], best[width:])
            width *= 2
        low = windows + CONTEXT
        chosen = (np.minimum(best[low], best[low + span - width]) & np.uint64((1 << 28) - 1)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1)]))
        tail = np.append(head[1:], len(windows)) - 1
        name = _mix(self.sums.hash(chosen[head] - CONTEXT, chosen[head] + CONTEXT) ^ _B)
        return name, windows[head], windows[tail] + 1


def _first_of(names: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which entries are the first of their name in their row; entries stand in order inside a row."""
    order = np.lexsort((np.arange(len(names)), names, rows))
    new = np.ones(len(names), bool)
    new[1:] = (names[order][1:] != names[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    out = np.zeros(len(names), bool)
    out[order] = new
    return out


def _raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _names(docs: DataFrame, window: int, bitmap: Broadcast | None) -> DataFrame:
    """``id, text_key, name, kind, a, b``: anchors (kind 0: windows ``a`` to ``b``) and long symbols (kind 1: words).

    Of equal names in a row only the first counts elsewhere; the others, known
    as repeats already, have no name (kind 0 windows are then compared, kind 1
    words gone). With a bitmap of names only those in it are given.
    """

    def run(batches):
        shingler = Shingler(1)
        held = bitmap.value if bitmap is not None else None
        for batch in pieces(batches, 2):
            parse = Parse(shingler, _raw(batch.column(2)), window)
            columns = []
            for kind, (names, a, b) in enumerate(parse.symbols()):
                rows = np.searchsorted(parse.first, a, side="right") - 1
                rows = np.minimum(rows, len(parse.first) - 2)
                order = np.lexsort((b, a, rows))  # inside a row by start, shorter ones first
                names, a, b, rows = names[order], a[order], b[order], rows[order]
                known = ~_first_of(names, rows)
                if held is None:
                    pick = ~known
                else:
                    repeated = _held(held, names)
                    if kind == 0:  # an anchor that is repeated inside its row: the first has to be compared as well
                        known = np.isin(names, names[known])
                    pick = known | repeated
                begin = parse.first[:-1][rows]
                columns.append([rows[pick], names.view(np.int64)[pick], known[pick], np.full(int(pick.sum()), kind), (a - begin)[pick], (b - begin)[pick]])
            row, name, known, kind, a, b = (np.concatenate(c) for c in zip(*columns, strict=True))
            at = pa.array(row)
            names_out = pa.array(name, pa.int64(), mask=known)
            if held is None:
                yield pa.RecordBatch.from_arrays([names_out, batch.column(0).take(at)], names=["name", "id"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), names_out, pa.array(kind, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                    names=["id", "text_key", "name", "kind", "a", "b"],
                )

    schema = "name long, id long" if bitmap is None else "id long, text_key long, name long, kind int, a int, b int"
    return bounded(docs).mapInArrow(run, schema)


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in one of the spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.minimum(starts, n), 1)
    np.add.at(step, np.minimum(ends, n), -1)
    return np.cumsum(step[:n]) > 0


def _result(words: list[bytes], gone: np.ndarray) -> tuple[int, int, str]:
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


_RESULT = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]


def _settle(rows: DataFrame, window: int) -> DataFrame:
    """``id, text_key`` and the result of texts without windows to compare; of the others
    the packed text, the settled words and each window's start and hashes."""

    def run(batches):
        shingler, unpack, pack = Shingler(1), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i in range(batch.num_rows):
                raw = unpack.decompress(batch.column(2)[i].as_py())
                words = raw.split()
                n = len(words)
                spans = batch.column(3)[i].values
                kind, a, b = (
                    (spans.field(c).to_numpy() for c in ("kind", "a", "b")) if spans is not None and len(spans) else (np.zeros(0, np.int64),) * 3
                )
                gone = _covered(n, a[kind == 1], b[kind == 1])
                # windows to compare: they picked a repeated anchor, and no settled passage has them whole
                starts = np.flatnonzero(_covered(max(0, n - window + 1), a[kind == 0], b[kind == 0]))
                reach = np.zeros(n + 1, np.int64)
                np.maximum.at(reach, a[kind == 1], b[kind == 1])
                starts = starts[np.maximum.accumulate(reach)[starts] < starts + window]
                low = high = np.zeros(0, np.uint64)
                if len(starts):
                    sums = Sums(shingler.words_of([raw])[2])
                    low, high = (sums.hash(starts, starts + window, lane) for lane in (0, 1))
                    order = np.lexsort((starts, high, low))
                    again = np.zeros(len(starts), bool)
                    again[order[1:]] = (low[order][1:] == low[order][:-1]) & (high[order][1:] == high[order][:-1])
                    gone |= _covered(n, starts[again], starts[again] + window)
                    starts, low, high = starts[~again], low[~again], high[~again]
                done = _result(words, gone) if not len(starts) else (None, None, None)
                lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (starts, low.view(np.int64), high.view(np.int64))]
                open_ = pack.compress(raw) if len(starts) else None
                bits = pack.compress(np.packbits(gone).tobytes()) if len(starts) else None
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *[pa.array([v], t) for v, (_, t) in zip(done, _RESULT, strict=True)],
                     pa.array([open_], pa.binary()), pa.array([bits], pa.binary()), *lists],
                    names=["id", "text_key", *[c for c, _ in _RESULT], "packed", "gone", "starts", "low", "high"],
                )

    schema = (
        "id long, text_key long, n_words long, n_removed long, kept_sha256 string, packed binary, gone binary, "
        "starts array<long>, low array<long>, high array<long>"
    )
    return bounded(rows).mapInArrow(run, schema)


def _finish(rows: DataFrame, window: int) -> DataFrame:
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                words = unpack.decompress(batch.column(1)[i].as_py()).split()
                gone = np.unpackbits(np.frombuffer(unpack.decompress(batch.column(2)[i].as_py()), np.uint8))[: len(words)].astype(bool)
                found = batch.column(3)[i].values
                if found is not None and len(found):
                    starts = found.to_numpy()
                    gone |= _covered(len(words), starts, starts + window)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), *[pa.array([v], t) for v, (_, t) in zip(_result(words, gone), _RESULT, strict=True)]],
                    names=["id", *[c for c, _ in _RESULT]],
                )

    return bounded(rows).mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string")


def _packed(docs: DataFrame) -> DataFrame:
    """``id, text_key, packed``: compressed texts, which travel instead of the plain ones."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches, 2):
            packed = pa.array([pack.compress(x) for x in _raw(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["id", "text_key", "packed"])

    return bounded(docs).mapInArrow(run, "id long, text_key long, packed binary")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` of every row: what is left without repeated passages.

    Words are runs of anything but ASCII white space, unchanged. A word is
    removed if some window of ``window`` consecutive words that covers it occurs
    earlier: in a row of smaller ``key``, or before in the same row. Windows are
    judged on the input. Words that are left are joined by one blank and hashed
    (SHA-256 of UTF-8).

    Null keys are behind all others (so is the largest 64-bit number, which
    stands for null). Rows of equal key come neither before nor
    after each other, so repeated rows get equal results. Null and empty texts
    have no words; texts shorter than a window lose nothing; an empty table
    gives an empty table; other columns don't matter. Names and windows are
    compared by hashes of 64 and 128 bits.
    """
    if window < 3 * CONTEXT + 4:
        raise ValueError(f"a window needs {3 * CONTEXT + 4} words at least")
    spark = df.sparkSession
    source = F.col(f"`{text}`")
    docs = df.select(
        F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(_LAST)).alias("id"), F.xxhash64(source).alias("text_key"), source.alias("text")
    )
    firsts = _names(docs, window, None).groupBy("name").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    firsts = materialize(firsts.select("name", "low"), "first-names")
    with lending(spark) as lend:
        names = materialize(_names(docs, window, lend(_bitmap(firsts, "name", NAME_BITS))), "repeated-names")
    known = names.filter("name is null").select("id", "text_key", "kind", "a", "b")
    # a repeated anchor asks for a comparison in its first row, too; a long symbol is gone in all but that
    shared = names.filter("name is not null").join(firsts, "name").filter((F.col("kind") == 0) | (F.col("id") > F.col("low")))
    spans = known.unionByName(shared.select("id", "text_key", "kind", "a", "b"))
    spans = spans.groupBy("id", "text_key").agg(F.collect_set(F.struct("kind", "a", "b")).alias("spans"))
    spans = materialize(spans, "spans")
    rows = _packed(docs).join(spans, ["id", "text_key"], "left")
    settled = materialize(_settle(rows, window), "settled")
    done = settled.filter("n_words is not null").select("id", "n_words", "n_removed", "kept_sha256")
    open_ = settled.filter("n_words is null")
    windows = open_.select("id", "text_key", F.explode(F.arrays_zip("starts", "low", "high")).alias("w")).select("id", "text_key", "w.*")
    earliest = windows.groupBy("low", "high").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    earliest = materialize(earliest.select("low", "high", "first"), "first-windows")
    again = windows.join(earliest, ["low", "high"]).filter(F.col("id") > F.col("first"))
    again = again.groupBy("id", "text_key").agg(F.collect_set("starts").alias("again"))
    rest = _finish(open_.select("id", "text_key", "packed", "gone").join(again, ["id", "text_key"], "left").select("id", "packed", "gone", "again"), window)
    every = done.unionByName(rest)
    return every.select(F.when(F.col("id") == _LAST, F.lit(None)).otherwise(F.col("id")).alias(key), "n_words", "n_removed", "kept_sha256")
