"""Removal of repeated passages against all windows in dictionaries."""

import hashlib
import random

import numpy as np
import pytest

from quillgrid.llm import repeats
from quillgrid.llm.jaccard import Shingler

SCHEMA = "doc_id long, text string"


def plain(rows, window=20):
    """``(doc_id, n_words, n_removed, kept_sha256)`` by remembering every window's smallest id."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (key, _), w in zip(rows, words, strict=True):
        rank = (key is None, key or 0)
        for i in range(len(w) - window + 1):
            gram = tuple(w[i : i + window])
            first[gram] = min(first.get(gram, rank), rank)
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        rank, seen, gone = (key is None, key or 0), set(), [False] * len(w)
        for i in range(len(w) - window + 1):
            gram = tuple(w[i : i + window])
            if first[gram] < rank or gram in seen:
                gone[i : i + window] = [True] * window
            seen.add(gram)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((key, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, window=20):
    return sorted(map(tuple, repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA), window=window).collect()), key=repr)


def made_up(seed):
    """Texts of pasted passages, runs, edits and copies."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(40))
    passages = [[word() for _ in range(r.choice([18, 19, 20, 21, 25, 40, 90]))] for _ in range(12)]
    passages += [["ha"] * k for k in (5, 19, 20, 21, 60)] + [["ab", "cd"] * k for k in (4, 10, 11, 30)]
    rows = []
    for key in range(70):
        text = []
        for _ in range(r.randrange(1, 7)):
            part = list(r.choice(passages))
            if r.random() < 0.3:
                part = part[r.randrange(len(part)) :]
            if r.random() < 0.2 and part:
                part[r.randrange(len(part))] = "x"
            text += part + [word() for _ in range(r.choice([0, 0, 1, 3, 15]))]
        rows.append((key, r.choice([" ", "\n", "\t "]).join(text)))
    rows += [(100 + i, rows[r.randrange(60)][1]) for i in range(10)]
    rows += [(7, rows[3][1]), (7, rows[30][1]), (12, rows[12][1]), (None, rows[5][1]), (None, rows[5][1] + " end"), (200, None), (201, ""), (202, " \n ")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_made_up_texts(spark, seed):
    rows = made_up(seed)
    want = plain(rows)
    assert found(spark, rows) == want and any(x[2] for x in want)


def test_other_windows(spark):
    rows = made_up(9)
    for window in (16, 33):
        assert found(spark, rows, window) == plain(rows, window)
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA), window=15)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows)
    assert found(spark, rows) == want and sum(x[2] for x in want) > 1000


def test_hard_rows_and_nothing(spark, hard, hard_rows, nothing):
    out = repeats.remove_repeats(hard.withColumn("name", hard["doc_id"]).withColumn("id", hard["doc_id"])).collect()
    assert sorted(map(tuple, out), key=repr) == plain([(r[0], r[1]) for r in hard_rows])
    assert repeats.remove_repeats(nothing).count() == 0


def test_saturated_bitmap_gives_the_same(spark, monkeypatch):
    rows = made_up(4)
    monkeypatch.setattr(repeats, "NAME_BITS", 64)
    assert found(spark, rows) == plain(rows)


def test_equal_passages_have_equal_symbols():
    """Inside, whatever stands around: anchors of every window, and a long symbol of a long passage."""
    r = random.Random(1)
    passage = [f"p{r.randrange(10_000)}" for _ in range(400)]
    names = []
    for side in ("x", "y"):
        around = [f"{side}{r.randrange(1000)}" for _ in range(50)]
        raw = " ".join(around + passage + around).encode()
        anchors, long = repeats.Parse(Shingler(1), [raw], 20).symbols()
        inside = (anchors[1] >= 50) & (anchors[2] <= 430)
        names.append((set(anchors[0][inside].tolist()), set(long[0].tolist())))
    assert len(names[0][0] & names[1][0]) >= len(names[0][0]) - 2 and names[0][1] & names[1][1]


def test_runs_and_pairs():
    symbols = np.array([5, 5, 5, 7, 7, 9, 9], np.uint64)
    last = np.array([0, 0, 0, 0, 1, 0, 1], bool)
    named, starts, ends, new = repeats._run_names(symbols, np.arange(7), last)
    assert starts.tolist() == [0, 3, 5] and ends.tolist() == [False, True, True] and new.all() and len(set(named.tolist())) == 3
    # a run that a text's end cuts isn't one
    named, starts, _, _ = repeats._run_names(np.array([5, 5], np.uint64), np.arange(2), np.array([1, 1], bool))
    assert starts.tolist() == [0, 1] and named.tolist() == [5, 5]
