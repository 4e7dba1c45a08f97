"""Quality rules with N-gram perplexity.

A modified Kneser-Ney model of characters is counted by Spark over every
document, one model per language. Its N-grams are stored as sorted arrays of
hashes with log probabilities and back-off weights. Documents whose perplexity
lies outside their language's bands are rejected, as are those that fail the base
rules on length and repetition. One band is of nats per symbol, another of nats
per word: marks that repeat are cheap per character, not per word.

Two models are counted together. One is of the characters as they are, every code
point a symbol of its own: it grows with the corpus, and where a language's N-grams
take more than ``PART_BYTES`` they are looked up part by part. The other maps
characters to an alphabet of 64 symbols first (case and digits folded), so more counts
stand behind each; of the code points that share a symbol by remainder, each has a
probability among them from counts by language. A document must lie inside the bands of both.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.batches import bounded, lending, pieces, texts_of
from quillgrid.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 4
SYMBOLS = 64
_BITS = 6
MODEL_BYTES = 256 << 20  # models of as many languages as fit are broadcast at once
PART_BYTES = 256 << 20  # N-grams of one language's characters that are broadcast at once
ENTRY_BYTES = 16  # hash, log probability, back-off
CHARACTER_BYTES = 40  # a row of characters on its way through the driver
_POINT_BITS = 21  # a code point plus one; 0 is the text's border
_POINTS = 0x110001  # all code points and the end
_LETTERS, _FOLDED, _CHARACTERS = range(3)  # kinds of counts
_HELD = 4 << 20  # N-grams of characters that a task counts before it hands them over
BAND = 3.0  # interquartile ranges that the band reaches beyond the quartiles
LEAST_BAND = 0.05  # in nats per character
LEAST_WORD_BAND = 0.3  # in nats per word
_GATHER = 2 << 20  # symbols counted at a time
_SCORED = 1 << 19  # symbols scored at a time
# The characters with a symbol of their own besides a-z.
MARKS = ".,;:!?'\"()-|%$&*#<>/@=_+"
REST = 31 + len(MARKS)  # from this symbol on, code points share symbols by remainder


def alphabet() -> np.ndarray:
    """Symbol of every code point: 0 is the text's border, 1 blank, 2 line break, 3-28 a-z,
    29 A-Z, 30 digits, then ``MARKS``; other code points share the rest by remainder."""
    table = (REST + np.arange(0x110000) % (SYMBOLS - REST)).astype(np.uint8)
    table[[9, 11, 12, 32]] = 1
    table[[10, 13]] = 2
    table[97:123] = np.arange(3, 29)
    table[65:91] = 29
    table[48:58] = 30
    table[[ord(c) for c in MARKS]] = np.arange(31, REST)
    return table


def _with_borders(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points plus one of all texts, 0 for the borders between them; whether an N-gram ends there; where
    texts start; and how many N-grams each has: one for each character and the end."""
    border = "\0" * (ORDER - 1)
    joined = border + ("\0" + border).join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER - 1)[:-1]]) + ORDER - 1
    keep = np.ones(len(points), bool)
    for i in range(ORDER - 1):
        points[starts - 1 - i] = 0
        keep[starts - 1 - i] = False
    points[starts + sizes - 1] = 0  # a border inside a text does not look like its end
    return points, keep, starts, sizes


def _packed(symbols: np.ndarray, bits: int, order: int, kind: type) -> np.ndarray:
    """At each place the symbol and the ``order`` - 1 before it, the last one lowest."""
    packed = np.zeros(len(symbols), kind)
    for i in range(order):
        packed[i:] |= symbols[: len(symbols) - i].astype(kind) << kind(bits * i)
    return packed


def _grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed N-grams of all texts, one for each character and the end; and how many each text has."""
    points, keep, _, sizes = _with_borders(texts)
    symbols = np.where(points > 0, table[points - np.uint32(points > 0)], 0)
    return _packed(symbols, _BITS, ORDER, np.uint32)[keep], sizes


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed code points before each character and the end of all texts, and that character, both plus one."""
    points, keep, _, _ = _with_borders(texts)
    before = np.concatenate([np.zeros(1, np.uint64), _packed(points, _POINT_BITS, ORDER - 1, np.uint64)[:-1]])
    return before[keep], points[keep]


def _code_points(texts: list[str]) -> np.ndarray:
    """Code points of all texts, 0 for the end of each: one for each of ``_grams``."""
    return np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)


def _kinds(before: np.ndarray, last: np.ndarray, n: np.ndarray, table: np.ndarray):
    """``kind, context, last, n`` of counted N-grams of characters: themselves, folded, and code points that share a symbol."""
    yield _CHARACTERS, before, last, n
    fold = np.concatenate([[0], table]).astype(np.uint8)
    mask = np.uint64((1 << _POINT_BITS) - 1)
    gram = fold[last].astype(np.int64)
    for i in range(ORDER - 1):
        gram |= fold[(before >> np.uint64(_POINT_BITS * i)) & mask].astype(np.int64) << (_BITS * (i + 1))
    keys, at = np.unique(gram, return_inverse=True)
    yield _FOLDED, keys >> _BITS, keys & (SYMBOLS - 1), np.bincount(at, n).astype(np.int64)
    shared = fold[last] >= REST
    keys, at = np.unique(last[shared] - np.uint32(1), return_inverse=True)
    yield _LETTERS, np.zeros(len(keys), np.int64), keys, np.bincount(at, n[shared], len(keys)).astype(np.int64)


def count_grams(df: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang, kind, context, last, n``: each N-gram's count over all texts of a language, added up by Spark.

    An N-gram is its last symbol and the packed ones before it. A task counts N-grams of characters;
    folded ones and code points that share a symbol by remainder follow from them.
    """

    def count(batches):
        table = alphabet()
        ids, points = np.zeros(_POINTS, np.uint16), [0]  # points of a task are numbered: four fit into 64 bits
        held: dict[str | None, list] = {}
        counts: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

        def add_up(key):
            keys, n = np.unique(np.concatenate(held[key]), return_counts=True)
            held[key] = []
            if key in counts:
                keys, at = np.unique(np.concatenate([counts[key][0], keys]), return_inverse=True)
                n = np.bincount(at, np.concatenate([counts[key][1], n])).astype(np.int64)
            counts[key] = keys, n

        def rows(key, before, last, n):
            for kind, *columns in _kinds(before, last, n, table):
                for i in range(0, len(columns[0]), 1 << 16):
                    part = [c[i : i + (1 << 16)] for c in columns]
                    kinds = pa.array(np.full(len(part[0]), kind), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(kinds), pa.string()), kinds, *[pa.array(c.astype(t)) for c, t in zip(part, (np.int64, np.int32, np.int64), strict=True)]],
                        names=["lang", "kind", "context", "last", "n"],
                    )

        def hand_over():
            for key in held:
                if held[key]:
                    add_up(key)
            known = np.array(points, np.uint64)
            for key in list(counts):
                keys, n = counts.pop(key)
                point = [known[(keys >> np.uint64(16 * i)) & np.uint64(0xFFFF)] for i in range(ORDER)]
                before = point[1] | point[2] << np.uint64(_POINT_BITS) | point[3] << np.uint64(2 * _POINT_BITS)
                yield from rows(key, before, point[0].astype(np.uint32), n)
            ids[:] = 0
            del points[1:]

        for batch in pieces(batches, 1):
            by_lang: dict[str | None, list[str]] = {}
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if value:
                    by_lang.setdefault(key, []).append(value)
            for key, texts in by_lang.items():
                found, keep, _, _ = _with_borders(texts)
                used = np.flatnonzero(np.bincount(found))[1:]
                if len(points) + np.count_nonzero(ids[used] == 0) > 0xFFFF:
                    yield from hand_over()
                if len(used) > 0xFFFF - 1:
                    both, n = np.unique(np.stack([_characters(texts)[0], _characters(texts)[1].astype(np.uint64)]), axis=1, return_counts=True)
                    yield from rows(key, both[0], both[1].astype(np.uint32), n)
                    continue
                new = used[ids[used] == 0]
                ids[new] = np.arange(len(points), len(points) + len(new))
                points.extend(new.tolist())
                held.setdefault(key, []).append(_packed(ids[found], 16, ORDER, np.uint64)[keep])
                if sum(map(len, held[key])) > _GATHER:
                    add_up(key)
            if sum(len(keys) for keys, _ in counts.values()) > _HELD:
                yield from hand_over()
        yield from hand_over()

    rows = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    counted = bounded(rows).mapInArrow(count, "lang string, kind int, context long, last int, n long")
    return counted.groupBy("lang", "kind", "context", "last").agg(F.sum("n").alias("n"))


def _discounts(grams: DataFrame) -> DataFrame:
    """``d_lang, d_kind, d_size, d1, d2, d3`` of each order from its counts of counts (Chen and Goodman).

    Where a count of counts is 0 the formulas have no value; then 0.5, 1, 1.5.
    """
    n = [F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    usual = [F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.0)), F.lit(float(i))) for i in (1, 2, 3)]
    enough = F.least("n1", "n2", "n3", "n4") > 0
    return grams.groupBy("lang", "kind", "size").agg(*n).select(
        F.col("lang").alias("d_lang"), F.col("kind").alias("d_kind"), F.col("size").alias("d_size"),
        *[F.when(enough, u).otherwise(0.5 * (i + 1)).alias(f"d{i + 1}") for i, u in enumerate(usual)],
    )


def train(counts: DataFrame) -> DataFrame:
    """Interpolated modified Kneser-Ney: ``lang, size, context, gram, logp, backoff``.

    ``size`` is the length of the N-gram, ``logp`` the natural logarithm of its
    last symbol's probability after the others (null where it only stands in
    front of others), ``backoff`` the logarithm of the weight by which shorter N-grams count after this one. Top counts are
    occurrences, those below are numbers of different symbols in front. Rows of
    ``size`` 0 are code points with the logarithm of their count. Those of ``size`` ``ORDER`` + 1 are top
    N-grams of characters, ``gram`` the last one after ``context``; all that are scored were counted,
    so they need no shorter ones.

    All orders of both models share the steps, and what more than one needs is stored: short
    plans keep the driver small.
    """
    counts = materialize(counts, "grams")
    orders = {ORDER: counts.filter(F.col("kind") != _LETTERS)}
    wide = F.col("kind") == _CHARACTERS
    by_kind = lambda value: F.when(wide, value(_POINT_BITS)).otherwise(value(_BITS))
    tail = lambda size: F.col("context").bitwiseAND(by_kind(lambda bits: F.lit((1 << (bits * (size - 1))) - 1).cast("long")))
    for size in range(ORDER - 1, 0, -1):
        shorter = orders[size + 1].groupBy("lang", "kind", tail(size).alias("context"), "last").agg(F.count(F.lit(1)).alias("n"))
        orders[size] = materialize(shorter, f"grams-{size}")
    grams = _union([orders[size].select("lang", "kind", F.lit(size).alias("size"), "context", "last", "n") for size in orders])
    d = materialize(_discounts(grams), "discounts")
    off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    same = grams["lang"].eqNullSafe(d["d_lang"]) & (grams["kind"] == d["d_kind"]) & (grams["size"] == d["d_size"])
    found = grams.join(d, same).select("lang", "kind", "size", "context", "last", "n", F.least(off, F.col("n").cast("double")).alias("off"))
    sums = found.groupBy(F.col("lang").alias("c_lang"), F.col("kind").alias("c_kind"), F.col("size").alias("c_size"), F.col("context").alias("c")).agg(
        F.sum("n").alias("total"), F.sum("off").alias("freed")
    )
    sums = materialize(sums, "contexts")
    same = found["lang"].eqNullSafe(sums["c_lang"]) & (found["kind"] == sums["c_kind"])
    same = same & (found["size"] == sums["c_size"]) & (found["context"] == sums["c"])
    shares = found.join(sums, same).select(
        "lang", "kind", "size", "context", "last", ((F.col("n") - F.col("off")) / F.col("total")).alias("own"), (F.col("freed") / F.col("total")).alias("freed")
    )
    shares = materialize(shares, "shares")
    done: dict[int, DataFrame] = {}
    for size in range(1, ORDER + 1):
        own = shares.filter(F.col("size") == size)
        if size == 1:
            p = F.col("own") + F.col("freed") / F.when(wide, _POINTS).otherwise(SYMBOLS)
        else:
            below = done[size - 1].select(
                F.col("lang").alias("b_lang"), F.col("kind").alias("b_kind"), F.col("context").alias("b"), F.col("last").alias("b_last"), F.col("p").alias("b_p")
            )
            same = own["lang"].eqNullSafe(below["b_lang"]) & (own["kind"] == below["b_kind"])
            own = own.join(below, same & (tail(size - 1) == below["b"]) & (own["last"] == below["b_last"]))
            p = F.col("own") + F.col("freed") * F.col("b_p")
        done[size] = materialize(own.select("lang", "kind", "size", "context", "last", p.alias("p")), f"probabilities-{size}")
    gram = (F.shiftleft("context", _BITS) + F.col("last")).cast("int").alias("gram")
    logs = _union([done[size] for size in range(1, ORDER)]).filter(~wide).select("lang", "size", gram, F.log("p").alias("logp"))
    o = sums.filter((F.col("c_size") > 1) & (F.col("c_kind") == _FOLDED)).select(
        F.col("c_lang").alias("o_lang"), (F.col("c_size") - 1).alias("o_size"), F.col("c").cast("int").alias("o_gram"),
        F.log(F.col("freed") / F.col("total")).alias("backoff"),
    )
    # the border in front of a text is a context, never an N-gram: such rows have a weight alone
    same = logs["lang"].eqNullSafe(o["o_lang"]) & (logs["size"] == o["o_size"]) & (logs["gram"] == o["o_gram"])
    none = F.lit(0).cast("long").alias("context")
    lower = logs.join(o, same, "full").select(
        F.when(F.col("o_gram").isNull(), F.col("lang")).otherwise(F.col("o_lang")).alias("lang"),
        F.coalesce("size", "o_size").alias("size"),
        none,
        F.coalesce("gram", "o_gram").alias("gram"),
        "logp",
        F.coalesce("backoff", F.lit(0.0)).alias("backoff"),
    )
    log, weight = F.log("p").alias("logp"), F.lit(0.0).alias("backoff")
    top = done[ORDER].filter(~wide).select("lang", "size", none, gram, log, weight)
    whole = done[ORDER].filter(wide).select("lang", (F.col("size") + 1).alias("size"), "context", F.col("last").alias("gram"), log, weight)
    letters = counts.filter(F.col("kind") == _LETTERS).select("lang", F.lit(0).alias("size"), none, F.col("last").alias("gram"), F.log("n").alias("logp"), weight)
    return materialize(_union([lower, top, whole, letters]), "kneser-ney")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _hash(gram: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes; different N-grams never share one, each step can be undone."""
    x = gram.astype(np.uint64) | np.uint64(size << 32)
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def _character_hash(before: np.ndarray, last: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of N-grams of characters."""
    x = before * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += (last.astype(np.uint64) + np.uint64(seed << 32)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x9E3779B97F4A7C15)


class HashArray:
    """Sorted hashes with a value pair each, found by interpolation: the top bits of
    a hash tell where it would stand, a few steps forward settle it."""

    def __init__(self, hashes: np.ndarray, logp: np.ndarray, backoff: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.logp, self.backoff = hashes[order], logp[order], backoff[order] if len(backoff) else backoff
        bits = max(1, math.ceil(math.log2(len(hashes) + 1)))
        self.shift = np.uint64(64 - bits)
        bucket = (self.hashes >> self.shift).astype(np.int64)
        self.starts = np.searchsorted(bucket, np.arange((1 << bits) + 1)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 where absent."""
        bucket = (wanted >> self.shift).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        found = np.full(len(wanted), -1, np.int64)
        left = np.flatnonzero(at < end)
        at = at[left]
        while len(left):
            same = self.hashes[at] == wanted[left]
            found[left[same]] = at[same]
            at += 1
            more = ~same & (at < end[left])
            left, at = left[more], at[more]
        return found


class Characters:
    """N-grams of characters of one language, or a part of them. All that are looked up were counted, so with hashes
    that differ among them each finds its own; those of other parts are not found, but for a chance of
    one in 2 ** 64 for each entry."""

    def __init__(self, before: np.ndarray, last: np.ndarray, logp: np.ndarray):
        before, last, self.seed = before.astype(np.uint64), last.astype(np.uint32), 0
        hashes = _character_hash(before, last, self.seed)
        while len(np.unique(hashes)) < len(hashes):
            self.seed += 1
            hashes = _character_hash(before, last, self.seed)
        self.array = HashArray(hashes, logp.astype(np.float32), np.zeros(0, np.float32)) if len(hashes) else None

    def score(self, texts: list[str]) -> np.ndarray:
        """Natural log probability of every character and end of the texts; 0 for those of other parts."""
        before, last = _characters(texts)
        scores = np.zeros(len(last))
        for i in range(0, len(last) if self.array else 0, _SCORED):
            part = slice(i, i + _SCORED)
            at = self.array.find(_character_hash(before[part], last[part], self.seed))
            scores[part][at >= 0] = self.array.logp[at[at >= 0]]
        return scores


class Model:
    """One language's model."""

    def __init__(self, size: np.ndarray, context: np.ndarray, gram: np.ndarray, logp: np.ndarray, backoff: np.ndarray):
        whole = size == ORDER + 1
        self.characters = Characters(context[whole], gram[whole], logp[whole])
        self.arrays = {}
        for n in range(1, ORDER + 1):
            own = size == n
            self.arrays[n] = HashArray(_hash(gram[own], n), logp[own].astype(np.float32), backoff[own].astype(np.float32))
        codes, counts, symbols = gram[size == 0], np.exp(logp[size == 0]), alphabet()[gram[size == 0]]
        self.letters = np.zeros(max(128, codes.max(initial=0) + 1))  # rules name ASCII alone
        self.letters[codes] = np.log(counts / np.bincount(symbols, counts, SYMBOLS)[symbols])

    def spell(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log probability of every code point among those of its symbol; 0 for those with a
        symbol by rule and at the ends of texts. All others were counted."""
        found = self.letters[codes]
        found[ends] = 0.0
        return found

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Natural log probability of the last symbol of every top N-gram."""
        total = np.zeros(len(grams))
        left, rest = np.arange(len(grams)), grams
        for n in range(ORDER, 0, -1):
            array = self.arrays[n]
            at = array.find(_hash(rest, n))
            hit = at >= 0
            hit[hit] = ~np.isnan(array.logp[at[hit]])
            total[left[hit]] += array.logp[at[hit]]
            left, rest = left[~hit], rest[~hit]
            if not len(left):
                return total
            if n > 1:  # the weight stands with the context, the N-gram without its last symbol
                shorter = self.arrays[n - 1]
                at = shorter.find(_hash(rest >> np.uint32(_BITS), n - 1))
                total[left[at >= 0]] += shorter.backoff[at[at >= 0]]
                rest = rest & np.uint32((1 << (_BITS * (n - 1))) - 1)
        total[left] -= math.log(SYMBOLS)
        return total


def _wanted(langs: list[str | None]) -> Column:
    wanted = F.lit(False)
    for lang in langs:
        wanted = wanted | F.col("lang").eqNullSafe(F.lit(lang))
    return wanted


def _in_part(part: int, parts: int) -> Column:
    return F.pmod(F.xxhash64("context", "gram"), F.lit(parts)) == part


def load_models(model: DataFrame, langs: list[str | None], parts: int = 1) -> dict[str | None, Model]:
    """Models of these languages, of N-grams of characters the first part."""
    rows = model.filter(_wanted(langs) & ((F.col("size") <= ORDER) | _in_part(0, parts))).toArrow()
    columns = [rows.column(c).to_numpy() for c in ("size", "context", "gram", "logp", "backoff")]
    found = rows.column("lang")
    own = {lang: (found.is_null() if lang is None else pc.fill_null(pc.equal(found, lang), False)).to_numpy() for lang in langs}
    return {lang: Model(*[c[mask] for c in columns]) for lang, mask in own.items()}


def load_characters(model: DataFrame, lang: str | None, part: int, parts: int) -> Characters:
    rows = model.filter(_wanted([lang]) & (F.col("size") == ORDER + 1) & _in_part(part, parts)).select("context", "gram", "logp").toArrow()
    return Characters(*[rows.column(c).to_numpy() for c in ("context", "gram", "logp")])


# Fixed values of the base rules.
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
SYMBOL_CHARS = "[#*$%&|<>]"
_LINE_WORD = re.compile(r"[^\x20\x09-\x0D]")
_BLANKS = re.compile(r"[\x20\x09-\x0D]")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, covered = 0, 0  # words before ``covered`` are counted
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def base_numbers(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()  # at ASCII white space, as the pattern does
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if _LINE_WORD.search(x)]
    symbols = sum(map(text.count, SYMBOL_CHARS[1:-1]))
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words)


def score_texts(df: DataFrame, shared: Broadcast, text: str, lang: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``quality_lang``, the base numbers, ``nats``, ``spelling`` and ``characters``: mean negative
    log probabilities of symbols, of code points among those that share a symbol by remainder, and of
    characters, in the models by language that ``shared`` holds."""

    def run(batches):
        table, models = alphabet(), shared.value
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for batch in pieces(batches, 1):
            langs, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            nats: list[float | None] = [None] * len(texts)
            spelling: list[float | None] = [None] * len(texts)
            characters: list[float | None] = [None] * len(texts)
            by_lang: dict[str | None, list[int]] = {}
            for i, key in enumerate(langs):
                if texts[i]:
                    by_lang.setdefault(key, []).append(i)
            for key, places in by_lang.items():
                grams, sizes = _grams([texts[i] for i in places], table)
                ends = np.cumsum(sizes)
                scores = np.empty(len(grams))
                for i in range(0, len(grams), _SCORED):
                    scores[i : i + _SCORED] = models[key].score(grams[i : i + _SCORED])
                letters = models[key].spell(_code_points([texts[i] for i in places]), ends - 1)
                whole = models[key].characters.score([texts[i] for i in places])
                for i, end, size in zip(places, ends, sizes, strict=True):
                    characters[i] = -float(whole[end - size : end].sum()) / int(size)
                    nats[i] = -float(scores[end - size : end].sum()) / int(size)
                    spelling[i] = -float(letters[end - size : end].sum()) / int(size)
            numbers = list(zip(*[base_numbers(t) for t in texts], strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[2:],
                    batch.column(0),
                    *[pa.array(list(c), pa.int64()) for c in numbers],
                    *[pa.array([None if x is None else round(x, 6) for x in c], pa.float64()) for c in (nats, spelling)],
                    pa.array(characters, pa.float64()),
                ],
                names=[*batch.schema.names[2:], "quality_lang", *names, "nats", "spelling", "characters"],
            )

    rows = df.select(F.col(f"`{lang}`").cast("string").alias("__lang"), F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    schema = f"{kept}{', ' if kept else ''}quality_lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, nats double, spelling double, characters double"
    return bounded(rows).mapInArrow(run, schema)


def score_part(df: DataFrame, shared: Broadcast, text: str) -> DataFrame:
    """``__row, __nats``: mean negative log probability that the part of the characters in ``shared`` adds to a row."""

    def run(batches):
        for batch in pieces(batches, 1):
            texts = texts_of(batch.column(1))
            scores, sizes = shared.value.score(texts), np.array([len(t) + 1 for t in texts])
            nats = [-float(scores[end - size : end].sum()) / int(size) for end, size in zip(np.cumsum(sizes), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nats, pa.float64())], names=["__row", "__nats"])

    return bounded(df.select("__row", F.col(f"`{text}`"))).mapInArrow(run, "__row long, __nats double")


def score_by_parts(df: DataFrame, model: DataFrame, name: str | None, parts: int, text: str, lang: str, keep: list[str]) -> DataFrame:
    """``score_texts`` of one language whose characters are looked up part by part: rows are stored with a number,
    and what each part adds to them is summed."""
    columns = [F.col(f"`{c}`") for c in dict.fromkeys([*keep, text, lang])]
    rows = materialize(df.select(*columns, F.monotonically_increasing_id().alias("__row")), "numbered-texts")
    with lending(df.sparkSession) as lend:
        first = materialize(score_texts(rows, lend(load_models(model, [name], parts)), text, lang, [*keep, "__row"]), "perplexity-part")
    added = []
    for part in range(1, parts):
        with lending(df.sparkSession) as lend:
            added.append(materialize(score_part(rows, lend(load_characters(model, name, part, parts)), text), "perplexity-part"))
    rest = _union(added).groupBy("__row").agg(F.sum("__nats").alias("__nats"))
    return first.join(rest, "__row").withColumn("characters", F.col("characters") + F.col("__nats")).drop("__row", "__nats")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def word_length() -> Column:
    """Characters per word, one blank each included."""
    return F.greatest(F.col("word_chars") + F.col("n_words"), F.lit(1)) / F.greatest("n_words", F.lit(1))


def bands(scores: DataFrame, reach: float = BAND, least: float = LEAST_BAND, least_word: float = LEAST_WORD_BAND) -> DataFrame:
    """``band_lang, low, high`` in nats per symbol, ``word_low, word_high`` in nats per word,
    ``code_low, code_high`` in nats per code point, ``char_low, char_high`` in nats per character as it is.

    The quartiles of a language's documents that pass the base rules, and
    ``reach`` times their distance (``least`` nats at least, ``least_word`` for words)
    to both sides. Equal numbers count once, so a text with very many copies
    can't narrow a band.
    """
    passed = scores.filter(~base_failed() & F.col("nats").isNotNull()).select("quality_lang", "nats", "spelling", "characters", "n_words", "word_chars")
    quartiles = passed.distinct().groupBy(F.col("quality_lang").alias("band_lang")).agg(
        F.percentile_approx("nats", [0.25, 0.75], 10_000).alias("q"),
        F.percentile_approx(F.col("nats") * word_length(), [0.25, 0.75], 10_000).alias("w"),
        F.percentile_approx(F.col("nats") + F.col("spelling"), [0.25, 0.75], 10_000).alias("c"),
        F.percentile_approx("characters", [0.25, 0.75], 10_000).alias("h"),
    )
    side, word_side, code_side, char_side = (
        F.greatest(reach * (F.col(c)[1] - F.col(c)[0]), F.lit(floor)) for c, floor in (("q", least), ("w", least_word), ("c", least), ("h", least))
    )
    return quartiles.select(
        "band_lang", (F.col("q")[0] - side).alias("low"), (F.col("q")[1] + side).alias("high"),
        (F.col("w")[0] - word_side).alias("word_low"), (F.col("w")[1] + word_side).alias("word_high"),
        (F.col("c")[0] - code_side).alias("code_low"), (F.col("c")[1] + code_side).alias("code_high"),
        (F.col("h")[0] - char_side).alias("char_low"), (F.col("h")[1] + char_side).alias("char_high"),
    )


MADE = {
    "quality_lang", "nats", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity",
    "low", "high", "band_lang", "word_low", "word_high", "code_low", "code_high", "spelling", "code_point_perplexity",
    "characters", "char_low", "char_high", "character_perplexity", "__lang", "__text", "__row", "__nats",
}


def quality_rules(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    keep: tuple[str, ...] = ("doc_id",),
    reach: float = BAND,
) -> DataFrame:
    """``keep`` columns of every row with the base numbers, ``perplexity``, the band and the verdict.

    Counts the language models over all rows of ``df``, scores each row with its
    language's model, derives the bands from all scores and gives ``base_failed``
    and ``kept`` (inside all bands, ends included, and the base rules passed).
    ``perplexity`` is that of the symbols, ``code_point_perplexity`` that with every
    code point that shares a symbol by remainder told apart, ``character_perplexity`` that of the
    characters as they are; ``low`` and ``high`` are where the bands meet for the first, with a
    row's length of words, its spelling and its characters.

    Null and empty texts have no words and no perplexity and fail; null
    languages are a language of their own; repeated rows get equal results; an
    empty table gives an empty table. Columns in ``keep`` with names made here
    are refused.
    """
    taken = {c.lower() for c in keep} & MADE
    if taken:
        raise ValueError(f"columns {sorted(taken)} are made here; rename yours")
    model = train(count_grams(df, text, lang))
    top = F.coalesce(F.max(F.when(F.col("size") == 0, F.col("gram"))), F.lit(0))  # code points up to it have a place
    whole = F.count(F.when(F.col("size") > ORDER, 1))
    sizes = model.groupBy("lang").agg(
        ((F.count(F.lit(1)) - whole) * ENTRY_BYTES + F.greatest(top + 1, F.lit(128)) * 8).alias("n"), (whole * CHARACTER_BYTES).alias("whole")
    ).collect()
    sizes = sorted(sizes, key=lambda x: (x["lang"] is not None, x["lang"]))
    parts_of = {x["lang"]: -(-x["whole"] // PART_BYTES) for x in sizes}
    blocks: list[list[str | None]] = []
    room = 0
    for name, n, more in sizes:
        if parts_of[name] > 1:
            continue
        if not blocks or n + more > room:
            blocks.append([])
            room = MODEL_BYTES
        blocks[-1].append(name)
        room -= n + more
    column, empty = F.col(f"`{lang}`").cast("string"), F.coalesce(F.col(f"`{text}`"), F.lit("")) == ""
    with lending(df.sparkSession) as lend:
        if len(blocks) <= 1 and max(parts_of.values(), default=1) <= 1:
            parts = [score_texts(df, lend(load_models(model, blocks[0]) if blocks else {}), text, lang, list(keep))]
        else:
            parts = [score_texts(df.filter(empty), lend({}), text, lang, list(keep))]
            for names in blocks:
                own = F.lit(False)
                for name in names:
                    own = own | column.eqNullSafe(F.lit(name))
                parts.append(score_texts(df.filter(own & ~empty), lend(load_models(model, names)), text, lang, list(keep)))
            for name in (x for x in parts_of if parts_of[x] > 1):
                rows = df.filter(column.eqNullSafe(F.lit(name)) & ~empty)
                parts.append(score_by_parts(rows, model, name, parts_of[name], text, lang, list(keep)))
        scores = materialize(_union(parts).withColumn("characters", F.round("characters", 6)), "perplexity")
    limits = materialize(bands(scores, reach), "bands")
    judged = scores.join(limits, scores["quality_lang"].eqNullSafe(limits["band_lang"]), "left")
    low = F.greatest("low", F.col("word_low") / word_length(), F.col("code_low") - F.col("spelling"), F.col("char_low") - F.col("characters") + F.col("nats"))
    high = F.least("high", F.col("word_high") / word_length(), F.col("code_high") - F.col("spelling"), F.col("char_high") - F.col("characters") + F.col("nats"))
    inside = F.coalesce(F.col("nats").between(low, high), F.lit(False))
    return judged.select(
        *[F.col(f"`{c}`") for c in keep],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & inside).alias("kept"),
        F.exp("nats").alias("perplexity"), F.exp(low).alias("low"), F.exp(high).alias("high"),
        F.exp(F.col("nats") + F.col("spelling")).alias("code_point_perplexity"),
        F.exp("characters").alias("character_perplexity"),
    )
