"""The two classifiers: parts against plain versions, the whole by held-out accuracy."""

import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import passages, toxicity
from quillgrid.llm.labelled import held_out, training_rows

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def letters(spark):
    return toxicity.letter_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text"))


def test_letter_model_is_a_distribution(letters):
    assert np.allclose(np.exp(letters).sum(2), 1)


def plain_restore(stretch, logp, restorer):
    """The best of all readings, one by one."""
    runs = ["".join(g) for _, g in itertools.groupby(stretch)]
    options = []
    for run in runs:
        c = run[0]
        found = [(c, 0.0)] if c.isalpha() else [(x, restorer.mark) for x in toxicity.LEET.get(c, "")]
        if not found:
            options.append([("", restorer.gap)])
            continue
        more = [(x * 2, cost + restorer.twice) for x, cost in found] if len(run) > 1 else []
        options.append(found + more)
    best = None
    for choice in itertools.product(*options):
        word, a, b, total = "".join(x for x, _ in choice), 0, 0, sum(cost for _, cost in choice)
        for x in word:
            c = toxicity._symbol(x)
            total, a, b = total + logp[a][b][c], b, c
        total += logp[a][b][0]
        if best is None or total > best[0] + 1e-12:
            best = (total, word)
    return best


@pytest.mark.parametrize("stretch", ["1d10t", "i d i o t", "w0rthl3$$", "looooser", "s.c.u.m", "m0r0n", "+r4sh", "c-l-0-w-n", "aabb", "|1l1|"])
def test_viterbi_equals_all_readings(letters, stretch):
    restorer = toxicity.Restorer(letters)
    score, word = plain_restore(stretch, letters, restorer)
    own = restorer.restore(stretch)
    assert plain_restore_score(own, stretch, letters, restorer) == pytest.approx(score), (own, word)


def plain_restore_score(word, stretch, logp, restorer):
    runs = ["".join(g) for _, g in itertools.groupby(stretch)]
    best = -math.inf

    def walk(i, rest, a, b, total):
        nonlocal best
        if i == len(runs):
            if not rest:
                best = max(best, total + logp[a][b][0])
            return
        c = runs[i][0]
        found = [(c, 0.0)] if c.isalpha() else [(x, restorer.mark) for x in toxicity.LEET.get(c, "")]
        if not found:
            walk(i + 1, rest, a, b, total + restorer.gap)
        for x, cost in found:
            s = toxicity._symbol(x)
            if rest.startswith(x):
                walk(i + 1, rest[1:], b, s, total + cost + logp[a][b][s])
            if len(runs[i]) > 1 and rest.startswith(x * 2):
                walk(i + 1, rest[2:], s, s, total + cost + restorer.twice + logp[a][b][s] + logp[b][s][s])

    walk(0, word, 0, 0, 0.0)
    return best


def test_disguised_words_are_read(letters):
    words = toxicity.Restorer(letters).words
    assert "loser" in words("you l0ser") and "moron" in words("a m.o.r.o.n!") and "clown" in words("c l o w n")
    assert {"plain", "words", "stay"} <= words("Plain words, stay.") and words("") == set()
    assert any(w.startswith("stup") for w in words("stuuuupid"))


@pytest.mark.parametrize("text", [
    "what a i d i o t", "y o u i d i o t here", "an i  d  i  o  t here", "an i\td\ti\to\tt here", "an i\nd\ni\no\nt here", "an id iot.", "an i di ot here",
    "an idiiot", "an iddiioott", "an a$$", "an idio+", "an 1d10+ here",
])
def test_split_doubled_and_marked_words_are_evidence(letters, text):
    assert toxicity.Scorer(letters, {"idiot": 2.0, "ass": 2.0})(text)[0] == 2.0


def test_neighbours_that_only_touch_are_no_evidence(letters):
    score = toxicity.Scorer(letters, {"idiot": 2.0, "ass": 2.0})
    for text in ("the id, iot of it", "c l a s s", "a letter still passes", "id est iot", "idiocy at last", "20 a 30", ""):
        assert score(text) == (0.0, 0.0), text


def test_held_out_rows(spark):
    rows = spark.range(500).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_training_rows_are_bounded_and_clean(spark, hard):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 12)] + [(None, 1, 1), (4, None, 1)], "doc_id long, toxic int, quality int")
    rows = training_rows(hard, labels, "toxic", 6).collect()
    assert 0 < len(rows) <= 6 and not any(zlib.crc32(str(r["key"]).encode()) % 5 == 0 for r in rows)
    assert len({r["text"] for r in rows}) == len(rows)
    # one quality label, of id 4, whose remainder is 3
    assert [r["key"] for r in training_rows(hard, labels, "quality", 6).collect()] == [4]


def held_out_rates(spark, scores, label):
    rows = scores.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").filter("held_out").select("predicted", label).collect()
    rate = lambda value: np.mean([r["predicted"] == value for r in rows if r[label] == value])
    return rate(1), rate(0)


def test_toxicity_on_held_out_rows(spark):
    table = lambda n: spark.read.parquet(f"{FOLDER}/{n}.parquet")
    caught, left_alone = held_out_rates(spark, toxicity.score_toxicity(table("documents"), table("labels")), "toxic")
    assert caught > 0.8 and left_alone > 0.98


def test_quality_on_held_out_rows(spark):
    table = lambda n: spark.read.parquet(f"{FOLDER}/{n}.parquet")
    good, bad = held_out_rates(spark, passages.score_quality(table("documents"), table("labels")), "quality")
    assert good > 0.97 and bad > 0.9


@pytest.mark.parametrize("score", [toxicity.score_toxicity, passages.score_quality])
def test_scores_of_hard_rows(spark, hard, hard_rows, nothing, score):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(1, 11)], "doc_id long, toxic int, quality int")
    rows = score(hard.withColumn("score", F.lit(1)).withColumn("label", F.lit(1)), labels).collect()
    assert len(rows) == len(hard_rows) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert score(nothing, labels).count() == 0
    unlabelled = score(hard, labels.limit(0)).collect()
    assert len(unlabelled) == len(hard_rows) and all(0 <= r["score"] <= 1 for r in unlabelled)


def test_passages_are_counted_whole():
    encoder = passages.Encoder()
    texts = ["", "one", " ".join(["w"] * 64), " ".join(["w"] * 65), "x\ny " * 500, "  "]
    x, sizes = encoder.passages(texts)
    assert sizes.tolist() == [1, 1, 1, 2, 16, 1] and len(x) == sum(sizes) and np.isfinite(x).all()
    alone = np.concatenate([encoder.passages([t])[0] for t in texts])
    assert np.allclose(x, alone)


def test_attention_gradients():
    draw = np.random.default_rng(0)
    model, sizes = passages.Attention(), np.array([3, 1, 4])
    x, y = draw.normal(size=(8, passages.NUMBERS)), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(np.log(np.where(y == 1, (p := model.score(x, sizes)), 1 - p)))
    got = model.gradients(model.forward(x, sizes), sizes, y)
    for name, values in model.p.items():
        at = tuple(draw.integers(0, s) for s in values.shape)
        values[at] += 1e-5
        up = loss()
        values[at] -= 2e-5
        down = loss()
        values[at] += 1e-5
        assert got[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_attention_finds_the_bad_passage():
    """One odd passage among many makes a bag bad; the weights say which."""
    draw = np.random.default_rng(1)
    sizes = draw.integers(1, 8, 400)
    x, y, odd = draw.normal(size=(sizes.sum(), passages.NUMBERS)), np.ones(400), []
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for i in range(0, 400, 2):
        at = first[i] + draw.integers(0, sizes[i])
        x[at, 3] += 6
        y[i] = 0
        odd.append((i, at))
    model = passages.Attention().fit(x, sizes, y, epochs=30)
    assert ((model.score(x, sizes) > 0.5) == (y == 1)).mean() > 0.95
    weights = model.forward(x, sizes)["a"]
    assert np.mean([weights[first[i] : first[i] + sizes[i]].argmax() + first[i] == at for i, at in odd]) > 0.8
