"""Jaccard groups and fingerprints against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import digest, jaccard


def plain_groups(rows, words, p, q):
    """All pairs of different sets."""
    sets, members = {}, {}
    for i, (key, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        s = frozenset(zip(*[w[j:] for j in range(words)])) if len(w) >= words else frozenset([tuple(w)] if w else [])
        sets[i] = s
        if s:
            members.setdefault(s, []).append(i)
    unique = list(members)
    parent = list(range(len(unique)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(unique)):
        for b in range(a):
            both = len(unique[a] & unique[b])
            if both and q * both >= p * (len(unique[a]) + len(unique[b]) - both):
                parent[find(a)] = find(b)
    groups = {}
    for a, s in enumerate(unique):
        groups.setdefault(find(a), []).extend(members[s])
    out = {}
    for g in groups.values():
        keys = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            out[i] = min(keys) if keys else None
    return sorted((str(k), len(sets[i]), str(out.get(i, k))) for i, (k, _) in enumerate(rows))


def groups_of(spark, rows, **settings):
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sid", F.lit(1)).withColumn("label", F.lit("x"))
    return sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.similar_groups(table, **settings).collect())


def mutated(draw, words, n):
    out = list(words)
    for i in draw.sample(range(len(out)), n):
        out[i] = f"new{draw.randrange(10**6)}"
    return " ".join(out)


def near_copies(seed):
    """Groups around a base with few and many changes, chains, shared passages, tiny sets, copies."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randint(2, 6)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(draw.randint(20, 160))]
        rows += [mutated(draw, base, draw.randint(0, min(9, len(base)))) for _ in range(draw.randint(1, 25))]
        rows += [" ".join(base[: len(base) - draw.randint(0, 6)]), " ".join(base) + " " + passage]
    chain = [word() for _ in range(200)]
    for i in range(0, 60, 3):
        rows.append(" ".join(chain[i : i + 120]))
    rows += [passage + " " + " ".join(word() for _ in range(draw.randint(1, 60))) for _ in range(30)]
    rows += ["a b", "A b", "a", "", None, "  \n", "a b c", "a b c d"] * 2 + [rows[0]] * 40
    rows = [(i if draw.random() < 0.97 else None, t) for i, t in enumerate(rows)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "words", "similarity"), [(1, 3, (90, 100)), (2, 5, (8, 10)), (3, 2, (6, 10)), (4, 1, (1, 1))])
def test_groups_equal_all_pairs(spark, seed, words, similarity):
    rows = near_copies(seed)
    assert groups_of(spark, rows, words=words, similarity=similarity) == plain_groups(rows, words, *similarity)


def test_groups_of_documents(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert groups_of(spark, rows, words=3, similarity=(90, 100)) == plain_groups(rows, 3, 90, 100)


def test_groups_of_nothing(nothing):
    assert jaccard.similar_groups(nothing).count() == 0


def test_a_thousand_near_copies_make_few_comparisons(spark, monkeypatch):
    """The group is settled with its leader: comparisons grow with its members, not their pairs."""
    draw = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, mutated(draw, base, draw.choice([0, 1, 1, 2, 2, 3, 4, 6]))) for i in range(1000)]
    made = []
    compare = jaccard._compare

    def counted(*args):
        out = compare(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_compare", counted)
    assert groups_of(spark, rows, words=3, similarity=(90, 100)) == plain_groups(rows, 3, 90, 100)
    assert sum(made) < 5000


def test_many_followers_do_not_meet_all_neighbours(spark, monkeypatch):
    """A leader's followers (several groups of them) and its many neighbours, of which one is linked to a follower."""
    draw = random.Random(9)
    none = []
    base = list(range(1000, 1100))
    differ = lambda k: sorted(draw.sample(base, k // 2)) + [draw.randrange(1 << 40) + 10_000 for _ in range(k - k // 2)]
    follower = [(i + 10, 1, 100, 100, 30, differ(30)) for i in range(80)]
    tops = [(1, 500 + j, 100, 100, 60, differ(60)) for j in range(50)]
    tops[7] = (1, 507, 100, 100, 32, follower[3][5] + [77_777, 77_778])
    # as if 500 were the smaller side: the leader's followers are asked for in the second step
    tops[8] = (508, 1, 100, 100, 31, follower[5][5] + [77_779])
    kind = "sid long, other long, n long, m long, d long, delta array<long>"
    made, keep = {}, jaccard.materialize

    def watched(df, name):
        made[name] = keep(df, name)
        return made[name]

    monkeypatch.setattr(jaccard, "materialize", watched)
    followers, near = spark.createDataFrame(follower, kind), spark.createDataFrame(tops, kind)
    linked = spark.createDataFrame(none, "node long, label long")
    at = jaccard.Threshold(8, 10)
    got = {tuple(sorted((r["a"], r["b"]))) for r in jaccard._links_below(near, followers, linked, at).collect()}
    under = {1: [(1, none)] + [(f[0], f[5]) for f in follower]}
    want = set()
    for a, b, _, _, _, delta in tops:
        for x, dx in under.get(a, [(a, none)]):
            for y, dy in under.get(b, [(b, none)]):
                if 18 * len(set(delta) ^ set(dx) ^ set(dy)) <= 2 * 200:
                    want.add(tuple(sorted((x, y))))
    assert got == want == {(13, 507), (15, 508)}
    assert made["reaching-sets"].count() < 60  # of 81 * 49 pairs


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1002), (1002, 1001)], "a long, b long")
    labels = {r["node"]: r["label"] for r in jaccard.connect(edges).collect()}
    assert all(labels[i] == 0 for i in range(301)) and labels[1000] == labels[1001] == labels[1002] == 1000


def test_components_need_no_round_to_see_that_nothing_changes(spark, monkeypatch):
    stored = []
    keep = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: stored.append(name) or keep(df, name))
    edges = spark.createDataFrame([(1, 5), (5, 7), (2, 3), (9, 9)], "a long, b long")
    labels = {r["node"]: r["label"] for r in jaccard.connect(edges).collect()}
    assert labels == {1: 1, 5: 1, 7: 1, 2: 2, 3: 2}
    assert stored.count("large-star") == 1


def test_pairs_are_found_once(spark, docs, monkeypatch):
    """The driver keeps the plan of every step: what is needed several times is stored, not planned again."""
    stored = []
    keep = jaccard.materialize

    def watched(df, name):
        stored.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("Join ")))
        return keep(df, name)

    monkeypatch.setattr(jaccard, "materialize", watched)
    jaccard.similar_groups(docs).collect()
    assert max(n for _, n in stored) <= 9, stored


def plain_level(window):
    share = np.array(list(Counter(window).values())) / 64
    return round(float(-(share * np.log2(share)).sum() * 1023 / 6))


def test_entropies(monkeypatch):
    monkeypatch.setattr(digest, "_STEP", 500)
    data = (b"the cat sat on the mat " * 40 + b"\0" * 100 + random.Random(1).randbytes(1500))[:2400]
    found = digest.entropies(np.frombuffer(data, np.uint8))
    want = [plain_level(data[i : i + 64]) for i in range(len(data) - 63)]
    assert np.abs(found - want).max() <= 1 and (found != want).mean() < 0.01
    assert len(digest.entropies(np.frombuffer(b"short", np.uint8))) == 0


def plain_features(text, ranks):
    raw = text.encode()
    if len(raw) < 64:
        return [raw] if raw else []
    n = len(raw) - 63
    rank = [int(ranks[x]) for x in digest.entropies(np.frombuffer(raw, np.uint8))]
    wins = Counter(min(range(i, i + 64), key=lambda j: (rank[j], j)) for i in range(n - 63))
    popular = sorted(i for i, c in wins.items() if c >= digest.POPULARITY) or [min(range(n), key=lambda j: (rank[j], j))]
    return [raw[i : i + 64] for i in popular]


def test_features_do_not_depend_on_neighbours(docs):
    ranks = np.random.default_rng(1).permutation(digest.LEVELS)
    texts = [r["text"] for r in docs.limit(40).collect()] + ["", "x", "ab" * 31, "é" * 40, "q" * 64, "one two " * 9]
    together, each = digest.filters_of(texts, ranks), [digest.filters_of([t], ranks)[0] for t in texts]
    for text, a, b in zip(texts, together, each, strict=True):
        assert np.array_equal(a, b)
        features = plain_features(text, ranks)
        assert len(a) == -(-len(features) // digest.FILTER_FEATURES)
        which, hashes = digest._features([text.encode()], ranks)
        assert len(hashes) == len(features) and np.array_equal(digest.from_text(digest.as_text(a)), a)


def test_likeness():
    ranks = np.arange(digest.LEVELS)
    draw = random.Random(4)
    text = lambda n: " ".join("".join(draw.choices("abcdefghijklmnop", k=5)) for _ in range(n))
    a, b = text(3000), text(3000)
    mixed = a[:9000] + b[9000:]
    fa, fb, fm, none = digest.filters_of([a, b, mixed, ""], ranks)
    assert digest.likeness(fa, fa) == pytest.approx(1) and digest.likeness(none, none) == 1 and digest.likeness(fa, none) == 0
    assert digest.likeness(fa, fb) < 0.1 < 0.3 < digest.likeness(fa, fm) < 0.8
    assert digest.likeness(fa, fm) == digest.likeness(fm, fa)


def test_edits_of_the_next_row(spark, docs, hard, hard_rows, nothing, monkeypatch):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(r[0] and -r[0], r[1]) for r in hard_rows if r[0] != 5]
    table = spark.createDataFrame([(k, t) for k, t in texts], "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("halo", F.lit(2))
    ranks = digest.rarity_ranks(table)
    assert sorted(ranks) == list(range(digest.LEVELS))
    order = sorted(((k, t or "") for k, t in texts), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for i, (k, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        want.append((str(k), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    place = digest.neighbour_order
    monkeypatch.setattr(digest, "neighbour_order", lambda df, key, text: place(df, key, text, rows_per_part=17))
    found = digest.compare_edits(table, ranks).collect()
    assert sorted(want) == sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in found)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    same = {}
    for r in digest.fingerprints(table, ranks).collect():
        assert same.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"]
    one = digest.compare_edits(table.limit(1), ranks).collect()
    assert len(one) == 1 and one[0]["near_next"] == pytest.approx(1)
    assert digest.compare_edits(nothing, ranks).count() == 0
