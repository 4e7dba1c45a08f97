"""Ball-tree search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillgrid.llm import balltree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, queries, k=10):
    """``(item, rank, doc_id, score)`` by scoring all documents."""
    bags = [(key, TERM.findall((t or "").translate(LOW))) for key, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in queries:
        scored = []
        for key, bag in bags:
            if not bag:
                continue
            tf, m = Counter(bag), 25 + (75 * len(bag) * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
                for t in TERM.findall((text or "").translate(LOW)) if df[t]
            )
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(item, i + 1, None if none else key, -score) for i, (score, none, key) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, queries, k=10):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame(queries, "item_id long, text string")
    return sorted(map(tuple, balltree.search(docs, queries, k).collect()), key=repr)


def made_up(seed, n):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("Red", "blue", "é", "x1", "Z") for b in range(60)]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda most: r.choice([" ", ", ", "-"]).join(r.choices(words, weights, k=r.randrange(1, most)))
    docs = [(i, text(60)) for i in range(n)]
    docs += [(n + i, docs[i % 5][1]) for i in range(300)] + [(3, docs[9][1]), (None, docs[9][1]), (None, docs[2][1]), (n + 400, None), (n + 401, ""), (n + 402, "--")]
    queries = [(i, text(25)) for i in range(30)] + [(1, docs[2][1]), (1, docs[2][1]), (None, docs[9][1]), (50, None), (51, "!"), (52, "nowhere")]
    return docs, queries


def test_made_up_texts(spark, monkeypatch):
    docs, queries = made_up(1, 1500)
    want = plain(docs, queries)
    assert found(spark, docs, queries) == want
    # many small trees, several blocks of queries, few answers
    monkeypatch.setattr(balltree, "TREE_ROWS", 100)
    monkeypatch.setattr(balltree, "LEAF_ROWS", 4)
    monkeypatch.setattr(balltree, "BLOCK_QUERIES", 12)
    assert found(spark, docs, queries) == want
    assert found(spark, docs, queries, 3) == plain(docs, queries, 3)


def test_hard_rows_and_nothing(spark, hard, nothing):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    queries = [(1, "the cat sat on é 你好 token"), (2, "")]
    asked = spark.createDataFrame(queries, "item_id long, text string")
    clash = hard.withColumn("score", hard["doc_id"]).withColumn("rank", hard["doc_id"]).withColumn("item_id", hard["doc_id"])
    assert sorted(map(tuple, balltree.search(clash, asked).collect()), key=repr) == plain(rows, queries)
    assert balltree.search(nothing, asked).count() == 0 and balltree.search(hard, asked.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_bounds_hold_and_prune(seed):
    r = np.random.default_rng(seed)
    n, v = 1024, 80
    groups = r.integers(0, 16, n)  # rows of a group share five terms
    sizes = np.full(n, 6)
    terms = np.concatenate([np.append(g * 5 + np.arange(5), r.integers(0, v)) for g in groups]).astype(np.int32)
    keep = np.concatenate([np.append(np.ones(5, bool), t[5] // 5 != t[0] // 5) for t in terms.reshape(-1, 6)])
    terms, sizes = terms[keep], np.add.reduceat(keep, np.arange(0, 6 * n, 6)).astype(int)
    impacts = r.integers(500_000, 600_000, len(terms)).astype(np.int32)
    tree = balltree.Tree(np.arange(n), np.zeros(n, bool), sizes, terms, impacts)
    dense = tree._dense().astype(np.float64)
    held = np.array([(dense[a:b] > 0).any(axis=0) for a, b, _, _ in tree.spans])
    for (a, b, _, _), centre, radius, own in zip(tree.spans, tree.centres(dense), tree.radius, held, strict=True):
        q = r.integers(0, 20_000, dense.shape[1]).astype(float)
        assert (dense[a:b] @ q).max() <= (centre @ q + np.sqrt((q * q) @ own) * radius) * (1 + balltree._SLACK) + 1
    # a query for one group's terms leaves most leaves alone
    block = balltree.Block([(1, 1, " ".join(f"t{i}" for i in range(5)))])
    block.place = {f"t{i}".encode(): i for i in range(v)}
    block.weigh(n, {})
    seen = []
    walk = tree._walk
    tree._walk = lambda d, *rest: walk(Seen(d, seen), *rest)
    best = tree.search(block, [1], 10)[0]
    scores = sorted((dense[:, [list(tree.own).index(i) for i in range(5)]] @ block.queries[0][1]).astype(int).tolist(), reverse=True)
    assert sorted((b[0] for b in best), reverse=True) == scores[:10] and sum(seen) < n / 2


class Seen:
    """A matrix that notes how many rows are read."""

    def __init__(self, dense, seen):
        self.dense, self.seen = dense, seen

    def __getitem__(self, rows):
        self.seen.append(rows.stop - rows.start)
        return self.dense[rows]
