"""The Merkle manifest and its bitmap ranks against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillgrid.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*values):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def reduce_runs(nodes):
    """Levels of digests, the lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path_of(levels, place):
    steps = []
    for nodes in levels[:-1]:
        run = nodes[place // 16 * 16 : place // 16 * 16 + 16]
        steps.append((run[: place % 16], run[place % 16 + 1 :]))
        place //= 16
    return steps


def plain(rows):
    leaf = lambda r, text: digest(r[0], r[3], r[2], r[4], text)
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        groups.setdefault(r[3], []).append((r[0] is None, r[0] or 0, leaf(r, r[1]), leaf(r, low(r[1]) if bad else r[1]), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [reduce_runs([x[2] for x in sorted(groups[g], key=lambda x: x[:4])]) for g in names]
    top = reduce_runs([t[-1][0] for t in trees])
    out = []
    for i, (g, tree) in enumerate(zip(names, trees, strict=True)):
        for place, (_, _, own, bad, key) in enumerate(sorted(groups[g], key=lambda x: x[:4])):
            steps = path_of(tree, place) + path_of(top, i)
            folded = bad
            for left, right in steps:
                folded = sha("".join(left) + folded + "".join(right))
            proof = sha("".join("".join(a) + "".join(b) for a, b in steps))
            out.append((key, own, tree[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, manifest.document_manifest(df).collect()), key=repr)


def test_made_up_rows(spark):
    r = random.Random(3)
    keys = [*range(40), *(r.randrange(-(1 << 62), 1 << 62) for _ in range(300)), *range(1 << 40, (1 << 40) + 300), -1, -64, -65, (1 << 63) - 1, -(1 << 63)]
    rows = [(k, r.choice(["Abc Déf", "low", None, ""]) and f"Text {k}", "en", r.choice(["a", "b", "B", "é", None, ""]), 3) for k in keys]
    rows += [(5, f"same id {i}", "en", "a", i) for i in range(40)] + [(6, "copy", None, "b", None)] * 40
    rows += [(None, f"no id {i}", "en", "a", i) for i in range(40)] + [(None, "copy", "en", "lone", 1)] + [(3, "Alone", "en", "single", 1)]
    rows += [(i, "x", "en", f"s{i:03}", 1) for i in range(40)]
    r.shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_sizes(spark, n):
    rows = [(i * 3, f"Row {i}", "en", None, i) for i in range(n)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_hard_rows_and_nothing(spark, hard, hard_rows, nothing):
    clash = hard.withColumn("leaf", F.lit("x")).withColumn("group", F.lit(1)).withColumn("place", F.lit(1))
    assert found(clash) == plain(hard_rows)
    assert manifest.document_manifest(nothing).count() == 0
    with pytest.raises(ValueError):
        manifest.document_manifest(hard.withColumnRenamed("doc_id", "root"), key="root")


def test_ranks_count_smaller_keys(spark):
    r = random.Random(8)
    rows = {(g, r.choice([r.randrange(-200, 200), r.randrange(-(1 << 63), 1 << 63)])): r.choice([1, 1, 1, 5]) for g in "xyz" for _ in range(200)}
    df = spark.createDataFrame([(g, k, w) for (g, k), w in rows.items()], "g string, k long, w long")
    got = {(x["g"], x["k"]): x["below"] for x in manifest.rank_in_groups(df, ["g"], "k", "w").collect()}
    assert got == {(g, k): sum(w for (h, j), w in rows.items() if h == g and j < k) for g, k in rows}
