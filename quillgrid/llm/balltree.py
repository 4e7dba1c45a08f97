"""Ranked lexical search with exact sparse ball trees.

Documents are vectors of integer impacts over the terms that a block of queries
asks for; a query is a vector of integer weights, and a score their inner
product. Documents that share rare terms are dealt to the same tree. A tree's
nodes are balls: centroid and radius bound every inner product below them,

    q . x  <=  q . c + |q over the ball's terms| * r,

rounded up. Each query walks every tree best-first and leaves out subtrees
whose bound is below its worst answer so far; leaves are scored in 64-bit
integers. One tree in sixteen is searched first: its answers give each query a
score below which nothing in the other trees can count.
"""

from __future__ import annotations

import heapq
import math
import pickle
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.batches import bounded, lending, pieces
from quillgrid.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREE_ROWS = 2048  # documents of a tree at most
TREE_CELLS = 1 << 23  # documents times terms of a tree, so that its dense form has 32 MB
LEAF_ROWS = 32
BLOCK_QUERIES = 256  # of a block, on average
BLOCK_CHARS = 1 << 18
FIRST = 16  # one tree in so many is searched first
_SLACK = 1e-9  # relative, far above the rounding of sums of doubles

# A term's bytes: digits, letters (A-Z become a-z) and everything from 0x80 on; others separate.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TERM_BYTES).split()


class Block:
    """Queries and the numbers of their terms."""

    def __init__(self, rows: list[tuple[int | None, int, str]]):
        self.items = [(item, copies) for item, copies, _ in rows]
        self.bags = [Counter(terms_of(text.encode("utf-8", "surrogatepass"))) for _, _, text in rows]
        self.place: dict[bytes, int] = {}
        for bag in self.bags:
            for term in bag:
                self.place.setdefault(term, len(self.place))

    def weigh(self, n_docs: int, found: dict[int, int]) -> None:
        """Weights from how many documents hold each term."""
        df = np.array([found.get(i, 0) for i in range(len(self.place))], np.int64)
        self.weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64) if len(df) else df
        self.queries = [
            (np.array([self.place[t] for t in bag], np.int64), np.array([int(self.weights[self.place[t]]) * c for t, c in bag.items()], np.int64))
            for bag in self.bags
        ]


def term_vectors(docs: DataFrame, block, key: str, text: str) -> DataFrame:
    """``key, n, terms, tfs``: each row's number of terms, and those that the block asks for."""

    def run(batches):
        place = block.value.place
        for batch in pieces(batches, 1):
            sizes, counts, terms, tfs = [], [], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms_of(raw or b"")
                found = Counter([place[w] for w in words if w in place])
                sizes.append(len(words)), counts.append(len(found)), terms.extend(found.keys()), tfs.extend(found.values())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["key", "n", "terms", "tfs"])

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    return bounded(rows).mapInArrow(run, "key long, n long, terms array<int>, tfs array<int>")


class Tree:
    """A ball tree over sparse rows; the rows of a node stand side by side."""

    def __init__(self, keys: np.ndarray, missing: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        """``sizes`` are the numbers of ``terms`` and ``impacts`` of each row."""
        self.keys, self.missing, self.sizes, self.terms, self.impacts = keys, missing, sizes, terms, impacts
        self.spans: list[tuple[int, int, int, int]] = []  # first row, behind the last, children (-1: a leaf)
        dense = self._dense()
        order = np.arange(len(keys))
        self._split(dense, order, 0, len(order))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in order]) if len(order) else order
        self.keys, self.missing, self.sizes = keys[order], missing[order], sizes[order]
        self.terms, self.impacts = terms[flat], impacts[flat]
        self.radius = np.zeros(len(self.spans))
        dense = dense[order]
        for i, centre in enumerate(self.centres(dense)):
            a, b = self.spans[i][:2]
            away = dense[a:b] - centre
            self.radius[i] = math.sqrt(float(np.einsum("ij,ij->i", away, away).max())) * (1 + _SLACK)

    def _dense(self) -> np.ndarray:
        self.own, column = np.unique(self.terms, return_inverse=True)
        dense = np.zeros((len(self.sizes), len(self.own)), np.float32)  # impacts are whole numbers below 2 ** 24
        dense[np.repeat(np.arange(len(self.sizes)), self.sizes), column] = self.impacts
        return dense

    def _split(self, dense: np.ndarray, order: np.ndarray, a: int, b: int) -> int:
        """Halve rows along a direction in which they differ much; groups of like rows stay together there."""
        at = len(self.spans)
        self.spans.append((a, b, -1, -1))
        if b - a > LEAF_ROWS:
            rows = dense[order[a:b]]
            rows -= rows.mean(axis=0)
            line = np.cos(12.9898 * self.own).astype(np.float32)
            for _ in range(2):  # towards the direction of most variance
                line = (rows @ line) @ rows
                line /= max(float(np.abs(line).max()), 1e-30)
            order[a:b] = order[a:b][np.argsort(rows @ line, kind="stable")]
            middle = (a + b) // 2
            self.spans[at] = (a, b, self._split(dense, order, a, middle), self._split(dense, order, middle, b))
        return at

    def centres(self, dense: np.ndarray) -> np.ndarray:
        return np.array([dense[a:b].mean(axis=0, dtype=np.float64) for a, b, _, _ in self.spans])

    def search(self, block: Block, floors: list[int], k: int) -> list[list[tuple[int, int, int]]]:
        """Per query the best ``k`` rows of at least its floor: (score, null, key)."""
        dense = self._dense()
        centres = self.centres(dense)
        held = np.array([(dense[a:b] > 0).any(axis=0) for a, b, _, _ in self.spans], np.float64)
        column = {int(t): i for i, t in enumerate(self.own)}
        out = []
        for (terms, weights), floor in zip(block.queries, floors, strict=True):
            here = [(column[t], w) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if t in column and w]
            if not here:
                out.append([])
                continue
            at, q = np.array([h[0] for h in here]), np.array([h[1] for h in here], np.int64)
            real = q.astype(np.float64)
            bounds = (centres[:, at] @ real + np.sqrt(held[:, at] @ (real * real)) * self.radius) * (1 + _SLACK) + 1
            out.append(self._walk(dense, at, q, bounds.tolist(), max(1, floor), k))
        return out

    def _walk(self, dense, at, q, bounds, floor, k):
        best: list[tuple[int, int, int]] = []  # a heap, its worst first: score, -null, -key
        open_ = [(-bounds[0], 0)]
        while open_:
            bound, node = heapq.heappop(open_)
            if -bound < floor:
                break
            a, b, left, right = self.spans[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= floor:
                        heapq.heappush(open_, (-min(-bound, bounds[child]), child))
                continue
            scores = dense[a:b][:, at].astype(np.int64) @ q
            for i in np.flatnonzero(scores >= floor).tolist():
                row = (int(scores[i]), -int(self.missing[a + i]), -int(self.keys[a + i]))
                if len(best) < k:
                    heapq.heappush(best, row)
                elif row > best[0]:
                    heapq.heapreplace(best, row)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return best


def _trees(keys, missing, sizes, terms, impacts):
    """Trees over rows, halved until each is small enough."""
    n = len(keys)
    if n > LEAF_ROWS and (n > TREE_ROWS or n * len(np.unique(terms)) > TREE_CELLS):
        half, cut = n // 2, int(sizes[: n // 2].sum())
        yield from _trees(keys[:half], missing[:half], sizes[:half], terms[:cut], impacts[:cut])
        yield from _trees(keys[half:], missing[half:], sizes[half:], terms[cut:], impacts[cut:])
    elif n:
        yield Tree(keys, missing, sizes, terms, impacts)


def plant(vectors: DataFrame, block, n_docs: int, length: int) -> DataFrame:
    """``tree, packed``: one ball tree for each ``TREE_ROWS`` rows or fewer.

    Rows are ordered by the two rarest terms that they hold, then by key, so
    that a tree's rows resemble each other and copies spread over partitions.
    """
    parts = max(1, math.ceil(vectors.count() / TREE_ROWS))

    def rare(batches):
        weights = block.value.weights
        for batch in batches:
            lists = batch.column(2)
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            top = np.zeros(batch.num_rows, np.int64)
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own = flat[a:b]
                first = own[np.lexsort((own, -weights[own]))[:2]].tolist()
                top[i] = (first[0] << 31) | (first[1] if len(first) > 1 else 0)
            yield pa.RecordBatch.from_arrays([pa.array(top), *batch.columns], names=["top", *batch.schema.names])

    def build(batches):
        pack = zstandard.ZstdCompressor(level=1)
        held, count = [], 0

        def made():
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = rows.column("key").combine_chunks()
            lists = rows.column("terms").combine_chunks()
            at = lists.offsets.to_numpy()
            sizes = np.diff(at)
            terms = lists.flatten().to_numpy().astype(np.int32)
            tfs = rows.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
            n = rows.column("n").to_numpy()
            m = 100 - 75 + (75 * n * n_docs) // length
            impacts = ((1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, sizes))).astype(np.int32)
            missing = keys.is_null().to_numpy(zero_copy_only=False)
            for tree in _trees(keys.fill_null((1 << 63) - 1).to_numpy(), missing, sizes, terms, impacts):
                blob = pack.compress(pickle.dumps(tree.__dict__, protocol=5))
                yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["packed"])

        for batch in batches:
            a = 0
            while a < batch.num_rows:
                part = batch.slice(a, TREE_ROWS - count)
                held.append(part)
                count += part.num_rows
                a += part.num_rows
                if count >= TREE_ROWS:
                    yield from made()
                    held, count = [], 0
        if held:
            yield from made()

    rows = vectors.filter(F.size("terms") > 0)
    placed = bounded(rows).mapInArrow(rare, "top long, key long, n long, terms array<int>, tfs array<int>")
    dealt = placed.repartitionByRange(parts, "top", "key").sortWithinPartitions("top", "key")
    return materialize(bounded(dealt).mapInArrow(build, "packed binary"), "ball-trees")


def _answers(trees: DataFrame, block, floors, k: int) -> DataFrame:
    """``query, item, copies, key, score``: each tree's best rows for every query."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for raw in batch.column(0):
                tree = Tree.__new__(Tree)
                tree.__dict__.update(pickle.loads(unpack.decompress(raw.as_py())))
                found = tree.search(block.value, floors.value, k)
                rows = [(i, *block.value.items[i], None if null else -key, score) for i, own in enumerate(found) for score, null, key in own]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "item", "copies", "key", "score"])

    return bounded(trees).mapInArrow(run, "query long, item long, copies long, key long, score long")


def _best(answers: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``item, rank, key, score``: for each row of ``queries`` the ``k`` rows of ``docs`` that score highest.

    Terms are runs of letters, digits and everything outside ASCII, A-Z in lower
    case. With N rows that have a term, L terms in all and n in a row, a term of
    df rows weighs ``floor(1000 * ln((2 N + 2) / (2 df + 1)))``; its tf
    occurrences count ``10 ** 9 tf div (1000 tf + 8 m)`` with
    ``m = 25 + 75 n N div L``. Only scores above 0 are answers; equal ones are
    ordered by key, null last. All numbers but the logarithm are integers, and
    no answer is left out: bounds only skip what can't be one.

    Queries go in blocks of about ``BLOCK_QUERIES``, each with its own trees, so
    that what is shared with all tasks is bounded. Null, empty and unmatched
    queries have no answers; repeated queries are answered each, repeated
    documents ranked each; empty tables give an empty table. Other columns don't
    matter.
    """
    spark = docs.sparkSession
    column = F.col(f"`{item_text}`")
    asked = queries.filter(column.isNotNull()).groupBy(F.col(f"`{item}`").cast("bigint").alias("item"), column.alias("text"))
    asked = materialize(asked.agg(F.count(F.lit(1)).alias("copies")), "queries")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, math.ceil(max(size["n"] / BLOCK_QUERIES, (size["chars"] or 0) / BLOCK_CHARS)))
    out = spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in ((item, "long"), ("rank", "int"), (key, "long"), ("score", "long"))])
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()  # one block
        block = Block([(r["item"], r["copies"], r["text"]) for r in rows])
        if not block.place:
            continue
        with lending(spark) as lend:
            vectors = materialize(term_vectors(docs, lend(block), key, text), "vectors")
            total = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.sum("n").alias("length")).first()
            if not total["n"]:
                continue
            df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            block.weigh(total["n"], {r["term"]: r["df"] for r in df.collect()})  # one row per term of the block
            shared = lend(block)
            trees = plant(vectors, shared, total["n"], total["length"]).repartition(spark.sparkContext.defaultParallelism * 4, F.xxhash64("packed"))
            early = F.pmod(F.xxhash64(F.lit("early"), "packed"), F.lit(FIRST)) == 0
            first = materialize(_best(_answers(trees.filter(early), shared, lend([1] * len(rows)), k), k), "first-answers")
            worst = first.filter(F.col("rank") == k).select("query", "score").collect()  # one row per query of the block
            floors = {r["query"]: r["score"] for r in worst}
            rest = _answers(trees.filter(~early), shared, lend([floors.get(i, 1) for i in range(len(rows))]), k)
            best = materialize(_best(rest.unionByName(first.drop("rank")), k), "answers")
        found = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        out = out.unionByName(found.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score"))
    return out
