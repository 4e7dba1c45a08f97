"""Byte-level BPE with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary tells whether a whole
pre-token is one token. Second tier: a heap of adjacent pairs over a linked list
of bytes merges the rest, lowest rank first, leftmost first among equals.
Results of both are kept per worker in two bounded generations of a cache.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillgrid.llm.batches import bounded, pieces, texts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CACHE_BYTES = 56 << 20  # of each of the two generations, in each Python worker; empty again at the end of a task
_ENTRY_BYTES = 190  # of a cached stretch beside its characters and ids
_MASK = (1 << 64) - 1
_STEP, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd constants that spread bits


def _slot(h: int, shift: int, n: int) -> int:
    x = h ^ (shift * _STEP & _MASK)
    x = (x ^ (x >> 32)) * _MIX & _MASK
    return (x ^ (x >> 29)) % n


def _slots(hashes: np.ndarray, shifts: np.ndarray, n: int) -> np.ndarray:
    """``_slot`` of each hash (rows) with each displacement (columns)."""
    x = hashes[:, None] ^ (shifts * np.uint64(_STEP))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    return (x ^ (x >> np.uint64(29))) % np.uint64(n)


class PerfectHash:
    """A minimal perfect hash by displacement: ``n`` keys to ``0 .. n - 1``.

    Keys fall into buckets of about four; from the fullest bucket on, each gets
    the first displacement that sends its keys to free places. A bucket of one
    key names its place itself. Only a comparison with the key at a place tells
    whether some other text is in the table.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.m = len(keys), max(1, len(keys) // 4)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) < len(keys):
            raise ValueError("the vocabulary holds a token twice")
        buckets: dict[int, list[int]] = {}
        for h in hashes:
            buckets.setdefault(h % self.m, []).append(h)
        shifts, used = np.zeros(self.m, np.int64), np.zeros(self.n, bool)
        free: list[int] | None = None
        for bucket, members in sorted(buckets.items(), key=lambda b: (-len(b[1]), b[0])):
            if len(members) == 1:
                free = free if free is not None else list(np.flatnonzero(~used)[::-1])
                place = int(free.pop())
                used[place], shifts[bucket] = True, -place - 1
                continue
            own, start, width = np.array(members, np.uint64), 0, 32
            while True:
                places = _slots(own, np.arange(start, start + width, dtype=np.uint64), self.n)
                fits = [
                    i for i in np.flatnonzero(~used[places].any(axis=0)) if len(set(places[:, i].tolist())) == len(own)
                ]
                if fits:
                    used[places[:, fits[0]]], shifts[bucket] = True, start + int(fits[0])
                    break
                start, width = start + width, min(width * 4, 8192)
        self.shifts = shifts

    def place(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        shift = int(self.shifts[h % self.m])
        return -shift - 1 if shift < 0 else _slot(h, shift, self.n)


class Vocabulary:
    """Ranks of byte strings, the perfect hash over them, and the pairs that merge.

    Its size is that of the vocabulary file, whatever the data.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes {missing} are not in the vocabulary")
        self.pattern, self.codec = pattern, None
        self.hash = PerfectHash(list(ranks))
        self.tokens: list[bytes] = [b""] * len(ranks)
        self.ids = np.zeros(len(ranks), np.uint32)
        for token, rank in ranks.items():
            at = self.hash.place(token)
            self.tokens[at], self.ids[at] = token, rank
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = np.array([left, right, merged], np.uint32)

    @staticmethod
    def load(path: str, pattern: str) -> Vocabulary:
        """A file of lines ``base64(token) rank``."""
        with open(path, "rb") as lines:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


class Codec:
    """Encoder and decoder of one worker."""

    @staticmethod
    def of(vocabulary: Vocabulary) -> Codec:
        """The codec of a broadcast vocabulary, made once per worker process, so that tasks share its cache."""
        if vocabulary.codec is None:
            vocabulary.codec = Codec(vocabulary)
        return vocabulary.codec

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.pattern = regex.compile(v.pattern)
        self.tokens, self.ids = v.tokens, v.ids.tolist()
        self.shifts, self.m, self.n = v.hash.shifts.tolist(), v.hash.m, v.hash.n
        self.pairs = {
            (a << 32) | b: c for a, b, c in zip(*[x.tolist() for x in v.pairs], strict=True)
        }
        self.byte_ids = [self._whole(bytes([b])) for b in range(256)]
        self.byte_pairs = [self.pairs.get((a << 32) | b, -1) for a in self.byte_ids for b in self.byte_ids]
        most = max(self.ids) + 1
        sizes = np.zeros(most, np.int64)
        sizes[v.ids] = [len(t) for t in self.tokens]
        self.sizes, self.starts = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        by_id = [b""] * most
        for t, i in zip(self.tokens, self.ids, strict=True):
            by_id[i] = t
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.texts = list(map(str, range(most)))
        self.forget()

    def forget(self) -> None:
        """Empty the cache."""
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _whole(self, piece: bytes) -> int:
        """The id of a pre-token that is one token, else -1."""
        h = xxhash.xxh3_64_intdigest(piece)
        shift = self.shifts[h % self.m]
        at = -shift - 1 if shift < 0 else _slot(h, shift, self.n)
        return self.ids[at] if self.tokens[at] == piece else -1

    def _merge(self, piece: bytes) -> list[int]:
        """Merge bytes by rank: a heap of (rank, place) over a doubly linked list.

        ``ranks`` holds what the pair at a place merges into, -1 for nothing: an
        entry of the heap that differs is out of date.
        """
        pair = self.pairs.get
        byte_ids, first = self.byte_ids, self.byte_pairs
        symbols = [byte_ids[b] for b in piece]
        n = len(symbols)
        ranks = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]
        heap = [rank * n + i for i, rank in enumerate(ranks) if rank >= 0]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            rank = top // n
            i = top - rank * n
            if ranks[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            symbols[i], symbols[j] = rank, -1
            if k < n:
                ranks[j] = -1
                before[k] = i
                more = ranks[i] = pair((rank << 32) | symbols[k], -1)
                if more >= 0:
                    push(heap, more * n + i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                more = ranks[h] = pair((symbols[h] << 32) | rank, -1)
                if more >= 0:
                    push(heap, more * n + h)
        return [s for s in symbols if s >= 0]

    def _ids(self, word: str) -> list[int]:
        piece = word.encode()
        whole = self._whole(piece)
        return [whole] if whole >= 0 else self._merge(piece)

    def _stretch(self, text: str) -> bytes:
        """Ids of a stretch that pre-tokens don't cross, as 32-bit numbers."""
        found = self.old.get(text)
        if found is None:
            words = (text,) if _ONE.fullmatch(text) else self.pattern.findall(text)
            ids = self._ids(words[0]) if len(words) == 1 else [i for w in words for i in self._ids(w)]
            found = array("I", ids).tobytes()
        self.held += _ENTRY_BYTES + len(text) + len(found)
        if self.held > CACHE_BYTES:
            self.young, self.old, self.held = {}, self.young, 0
        if len(text) <= _LONGEST:
            self.young[text] = found
        return found

    def pack(self, text: str) -> bytes:
        """All ids as 32-bit numbers.

        Without two white-space characters in a row, no pre-token reaches over
        the place before a blank, around a line break or between a Latin letter
        and most marks, so texts are cut there and the stretches cached. Other
        texts are cut into pre-tokens as a whole.
        """
        pieces = _CUT.findall(text) if not _RUN.search(text) else self.pattern.findall(text)
        found = list(map(self.young.get, pieces))
        if None in found:
            found = [f if f is not None else self.young.get(p) or self._stretch(p) for f, p in zip(found, pieces, strict=True)]
        return b"".join(found)

    def encode(self, text: str) -> tuple[str, bytes]:
        """All ids as decimals joined by one space, and as 32-bit numbers."""
        packed = self.pack(text)
        return " ".join(map(self.texts.__getitem__, np.frombuffer(packed, np.uint32).tolist())), packed

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        shift = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.flat[shift + np.arange(ends[-1])].tobytes()


_LONGEST = 1 << 16  # characters of a cached stretch
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_ONE = re.compile(f" ?[{_LATIN}]+")
_CUT = re.compile(f" ?[{_LATIN}]+(?=[ \\n.,;:!?%$&*#|]|$)|\\n|[ \\n]?[^ \\n]+|[ \\n]")
_RUN = regex.compile(r"\s\s")


def _with_columns(df: DataFrame, vocabulary: Vocabulary, added: list[T.StructField], make, used: str, texts: bool = True) -> DataFrame:
    """``df`` and new columns that ``make`` gives for a codec and the values of column ``used``."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    taken = {f.name for f in added} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are made here; rename yours")
    at = df.columns.index(used)

    def run(batches):
        codec = Codec.of(shared.value)
        for batch in pieces(batches, at) if texts else batches:
            columns = list(batch.columns) + make(codec, batch.column(at))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *[f.name for f in added]])
        codec.forget()

    return bounded(df).mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", name: str = "ids") -> DataFrame:
    """``df`` and ``name``, the token ids of each whole text (null: empty), as an array of integers.

    Empty texts have no ids; repeated rows get the same ids; a column of ``df``
    with that name is refused.
    """

    def make(codec, texts):
        packed = [codec.pack(t) for t in texts_of(texts)]
        offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(packed), np.int32))
        return [pa.ListArray.from_arrays(pa.array(offsets), values)]

    return _with_columns(df, vocabulary, [T.StructField(name, T.ArrayType(T.IntegerType()))], make, text)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` and ``name``, the bytes of the ids (null: no bytes)."""

    def make(codec, lists):
        return [pa.array([codec.decode(np.array(x.as_py() or [], np.int64)) for x in lists], pa.binary())]

    return _with_columns(df, vocabulary, [T.StructField(name, T.BinaryType())], make, ids, texts=False)


def round_trip(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``df`` and ``n_tokens, ids_sha256, decoded_sha256``: encode, then decode what was encoded.

    The digests are those of the decimal ids joined by one space and of the
    decoded bytes. They are taken where the ids are made, so the ids, which are
    larger than the texts, don't travel.
    """

    def make(codec, texts):
        n, ids_hash, text_hash = [], [], []
        for t in texts_of(texts):
            decimals, packed = codec.encode(t)
            ids = np.frombuffer(packed, np.uint32)
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(decimals.encode()).hexdigest())
            text_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]

    added = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    return _with_columns(df, vocabulary, added, make, text)
