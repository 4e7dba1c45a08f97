"""Improbable-feature digests of documents.

Every window of 64 bytes has an entropy. Entropies that are rare in the corpus
make a window improbable elsewhere; windows that stay the rarest one around for
long enough are a document's features. Features are inserted into a chain of
Bloom filters, and two documents are alike as far as the bits of their filters
overlap beyond chance.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.batches import bounded, pieces, texts_of
from quillgrid.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 64  # bytes of a feature, and windows that compete with one another
LEVELS = 1024  # of entropy
POPULARITY = 16  # rounds that a window must win
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
_STEP = 1 << 17  # bytes handled at a time, so that arrays stay in the cache
# n * log2(n) in whole steps of 2 ** -32, so that sums don't depend on what else is in the array
_XLOG = np.concatenate([[0], np.rint(np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1)) * 2**32)]).astype(np.int64)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy level of each window of 64 bytes, 0 to 1023.

    When a window moves on by a byte, the count of the byte that enters and the
    one that leaves change. Both counts follow from comparing the data with
    itself, moved by 1 to 63 places.
    """
    n = len(data) - WINDOW + 1
    levels = np.empty(max(0, n), np.int16)
    for start in range(0, n, _STEP):
        part = data[start : start + _STEP + WINDOW - 1]
        lead, trail = np.ones(len(part), np.uint8), np.ones(len(part), np.uint8)
        for k in range(1, WINDOW):
            same = (part[:-k] == part[k:]).view(np.uint8)
            lead[:-k] += same
            trail[k:] += same
        # lead: equal bytes in the window that begins here; trail: in the one that ends here
        first = np.bincount(part[:WINDOW], minlength=256)
        gain = np.diff(_XLOG)[trail[WINDOW:] - 1]
        loss = np.diff(_XLOG)[lead[: len(part) - WINDOW] - 1]
        # the byte that enters is counted in a window that has lost the first byte already
        sums = np.concatenate([[_XLOG[first].sum()], gain - loss]).cumsum()
        entropy = np.log2(WINDOW) - sums / (WINDOW * 2**32)
        levels[start : start + len(sums)] = np.clip(np.rint(entropy * ((LEVELS - 1) / 6)), 0, LEVELS - 1)
    return levels


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row, and where each text starts (one more for the end)."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), starts


def _inside(starts: np.ndarray, n: int, reach: int) -> np.ndarray:
    """True for places from which ``reach`` bytes lie in one text; ``n`` places."""
    keep = np.ones(n + reach, np.int8)
    for i in range(1, reach):
        keep[np.maximum(starts[1:] - i, 0)] = 0
    return keep[:n].astype(bool)


def rarity_ranks(df: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy level, 0 the rarest in the corpus; counted by Spark over all texts.

    Windows of one repeated byte (level 0) say nothing and come last.
    """

    def count(batches):
        total = np.zeros(LEVELS, np.int64)
        for batch in pieces(batches, 0):
            data, starts = _joined([t.encode("utf-8", "surrogatepass") for t in texts_of(batch.column(0))])
            levels = entropies(data)
            total += np.bincount(levels[_inside(starts, len(levels), WINDOW)], minlength=LEVELS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["level", "n"])

    counted = bounded(df.select(F.col(f"`{text}`").alias("text"))).mapInArrow(count, "level int, n long")
    counts = np.zeros(LEVELS, np.int64)
    for row in counted.groupBy("level").agg(F.sum("n").alias("n")).collect():  # one row per level at most
        counts[row["level"]] = row["n"]
    counts[0] = np.iinfo(np.int64).max
    ranks = np.empty(LEVELS, np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(LEVELS)
    return ranks


def _features(texts: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the selected windows in order, and the text that each belongs to.

    A text of 1 to 63 bytes has no window; it is its own single feature.
    """
    data, starts = _joined(texts)
    sizes = np.diff(starts)
    which, hashes = [], []
    for i in np.flatnonzero((sizes > 0) & (sizes < WINDOW)):
        padded = np.zeros(WINDOW, np.uint8)
        padded[: sizes[i]] = data[starts[i] : starts[i + 1]]
        which.append(np.array([i]))
        hashes.append(_mix(padded[None, :]) + np.uint64(sizes[i]))
    if len(data) >= WINDOW:
        levels = entropies(data)
        n = len(levels)
        valid = _inside(starts, n, WINDOW)
        key = (ranks[levels] << 40) | np.arange(n)
        key[~valid] = np.iinfo(np.int64).max
        owner = np.repeat(np.arange(len(texts)), sizes)[:n]
        popular = np.zeros(n, bool)
        if n >= WINDOW:
            best, width = key, 1
            while width < WINDOW:  # smallest key of the next 2, 4, ... windows, ties to the left
                best = np.minimum(best[: len(best) - width], best[width:])
                width *= 2
            # a round counts when all its windows are in one text
            whole = valid[: len(best)] & valid[WINDOW - 1 :][: len(best)]
            whole &= owner[: len(best)] == owner[WINDOW - 1 :][: len(best)]
            winners = best[whole] & ((1 << 40) - 1)
            popular = np.bincount(winners, minlength=n) >= POPULARITY
        # texts too short for a whole round, or without a popular window, keep their rarest one
        has = np.zeros(len(texts), bool)
        has[owner[popular]] = True
        for i in np.flatnonzero(~has & (sizes >= WINDOW)):
            popular[starts[i] + np.argmin(key[starts[i] : starts[i + 1] - WINDOW + 1])] = True
        at = np.flatnonzero(popular)
        for i in range(0, len(at), 1 << 13):
            part = at[i : i + (1 << 13)]
            which.append(owner[part])
            hashes.append(_mix(data[part[:, None] + np.arange(WINDOW)]))
    if not which:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    which, hashes = np.concatenate(which), np.concatenate(hashes)
    order = np.argsort(which, kind="stable")
    return which[order], hashes[order]


def _mix(windows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of 64 bytes."""
    words = np.ascontiguousarray(windows).view("<u8")
    x = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(words.shape[1]):
        x = (x ^ words[:, i]) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x * np.uint64(0x9E3779B97F4A7C15)


def filters_of(texts: list[str], ranks: np.ndarray) -> list[np.ndarray]:
    """The chain of Bloom filters of each text, one row of 256 bytes each; empty texts have none."""
    which, hashes = _features([t.encode("utf-8", "surrogatepass") for t in texts], ranks)
    counts = np.bincount(which, minlength=len(texts))
    chains = -(-counts // FILTER_FEATURES)
    first = np.concatenate([[0], np.cumsum(chains)])
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    link = first[which] + (np.arange(len(which)) - begin[which]) // FILTER_FEATURES
    bits = np.zeros((int(first[-1]), FILTER_BITS), bool)
    for i in range(HASHES):
        bits[link, ((hashes >> np.uint64(64 - 11 * (i + 1))) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[first[i] : first[i + 1]] for i in range(len(texts))]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the mean over the shorter chain's filters of the best normalised bit overlap.

    The overlap of two filters counts from what chance gives, the product of
    their densities, up to the bits of the emptier one. Two empty chains are
    alike, an empty and another one are not.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    right = np.unpackbits(b, axis=1).astype(np.float32)
    set_b, total = right.sum(axis=1), 0.0
    for i in range(0, len(a), 64):
        left = np.unpackbits(a[i : i + 64], axis=1).astype(np.float32)
        set_a = left.sum(axis=1)
        chance = set_a[:, None] * set_b[None, :] / FILTER_BITS
        most = np.minimum(set_a[:, None], set_b[None, :])
        total += float(((left @ right.T - chance) / np.maximum(most - chance, 1e-9)).clip(0, 1).max(axis=1).sum())
    return total / len(a)


def as_text(chain: np.ndarray) -> str:
    """The filters in hex, joined by colons."""
    return ":".join(f.tobytes().hex() for f in chain)


def from_text(text: str) -> np.ndarray:
    if not text:
        return np.zeros((0, FILTER_BITS // 8), np.uint8)
    return np.frombuffer(bytes.fromhex(text.replace(":", "")), np.uint8).reshape(-1, FILTER_BITS // 8)


def fingerprints(df: DataFrame, ranks: np.ndarray, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``df`` and ``name``, the digest of each whole text; null and empty texts have an empty one.

    Equal texts have equal digests. A column of ``df`` with that name is refused.
    """
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {name!r} is made here; rename yours")
    at = df.columns.index(text)

    def run(batches):
        for batch in pieces(batches, at):
            found = [as_text(c) for c in filters_of(texts_of(batch.column(at)), ranks)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, name])

    return bounded(df).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


_PREFIX = 64  # characters of a text that tell rows of one key apart where rows are dealt


def neighbour_order(df: DataFrame, key: str, text: str, rows_per_part: int | None = None) -> DataFrame:
    """``key, text`` by descending key, null last, equal keys by text: partitions are consecutive and sorted.

    Partitions are ranges that Spark samples, as many as its shuffles have
    (or one for each ``rows_per_part`` rows). Rows of one key are dealt by the
    beginning of their text, so only equal texts of one key stay together.
    """
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = [F.col("key").desc_nulls_last(), F.substring("text", 1, _PREFIX)]
    if rows_per_part is None:
        dealt = rows.repartitionByRange(*order)
    else:
        dealt = rows.repartitionByRange(max(1, -(-rows.count() // rows_per_part)), *order)
    return dealt.sortWithinPartitions(F.col("key").desc_nulls_last(), "text")


def edited_text(text: str, following: str) -> str:
    """The last half of ``text``, rounded down, replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edits(df: DataFrame, ranks: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of every text and of its edited text, and their likeness to each other and the next text.

    Returns ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. The next row is that with the next smaller key,
    after the smallest the largest (a single row: itself). Null texts are empty;
    null keys come after all others; equal keys are ordered by text.
    """
    result = (
        f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]

    def one(rows):
        edits = [edited_text(t, n) for _, t, n in rows]
        every = list(dict.fromkeys(x for (_, t, n), e in zip(rows, edits, strict=True) for x in (t, n, e)))
        chain = dict(zip(every, filters_of(every, ranks), strict=True))
        done = [
            (k, len(t), hashlib.sha256(e.encode()).hexdigest(), as_text(chain[t]), as_text(chain[e]),
             likeness(chain[t], chain[e]), likeness(chain[t], chain[n]))
            for (k, t, n), e in zip(rows, edits, strict=True)
        ]
        return [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]

    def in_pieces(rows):
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[1])
            if size >= 1 << 18:
                yield held
                held, size = [], 0
        if held:
            yield held

    def inner(batches):
        """Results of all rows but a partition's last, which waits, with the first, for the other partitions."""
        from pyspark import TaskContext

        part, ends = TaskContext.get().partitionId(), []

        def pairs():
            last = None
            for batch in pieces(batches, 1):
                for own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if last is None:
                        ends.append((1, own, value))
                    else:
                        yield last[0], last[1], value
                    last = own, value
            if last is not None:
                ends.append((2, *last))

        blank = lambda n, kind: pa.nulls(n, kind)
        for rows in in_pieces(pairs()):
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [*one(rows), blank(n, pa.int64()), pa.array([0] * n, pa.int32()), blank(n, pa.string())], names=[*names, "__part", "__role", "__text"]
            )
        roles, own, values = ([e[i] for e in ends] for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int64()), *[blank(len(ends), k) for k in kinds[1:]], pa.array([part] * len(ends), pa.int64()),
             pa.array(roles, pa.int32()), pa.array(values, pa.string())],
            names=[*names, "__part", "__role", "__text"],
        )

    def across(batches):
        for batch in batches:
            for rows in in_pieces(zip(*[c.to_pylist() for c in batch.columns], strict=True)):
                yield pa.RecordBatch.from_arrays(one(rows), names=names)

    ordered = neighbour_order(df, key, text)
    stored = materialize(bounded(ordered).mapInArrow(inner, f"{result}, __part long, __role int, __text string"), "edits")
    heads = stored.filter("__role = 1").select(F.col("__part").alias("h_part"), F.col("__text").alias("h_text"))
    # which partition follows: a number for each partition, no texts
    by_part = Window.orderBy("__part")
    following = stored.filter("__role = 1").select("__part").select(
        "__part", F.coalesce(F.lead("__part").over(by_part), F.first("__part").over(by_part)).alias("__next")
    )
    tails = stored.filter("__role = 2").join(following, "__part").join(heads, F.col("__next") == F.col("h_part"))
    last = bounded(tails.select(F.col(f"`{key}`").alias("key"), "__text", "h_text")).mapInArrow(across, result)
    return stored.filter("__role = 0").select(*[F.col(f"`{n}`") for n in names]).unionByName(last)
