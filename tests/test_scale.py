"""The ways taken on large or skewed input, against brute force on small data."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.operators import cleaning, impute, knn, outliers
from quillgrid.operators.ordering import with_position
from quillgrid.operators.quantiles import exact_modes, exact_quantiles
from quillgrid.operators.similarity import similar_pairs
from quillgrid.operators.text import tag_dictionary_values


def edit_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_quantiles_of_a_hot_group(spark):
    """A third of all rows share one value, another third one group."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.when(F.col("id") % 3 == 1, 5.0).otherwise(F.pow(F.col("id") % 1009, F.lit(3)) / 7).alias("value"),
    )
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {r["k"]: (r["n"], r["quantiles"]) for r in exact_quantiles(df, ["k"], probs).collect()}
    data = df.toPandas()
    assert set(got) == set(data["k"])
    for key, values in data.groupby("k")["value"]:
        n, found = got[key]
        assert n == len(values)
        assert np.allclose(found, np.quantile(values, probs), rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_quantiles_of_tiny_groups(spark, size):
    df = spark.createDataFrame([(None, float(i * i)) for i in range(size)], "k string, value double")
    got = exact_quantiles(df, ["k"], [0.25, 0.5, 0.75]).first()
    assert np.allclose(got["quantiles"], np.quantile([i * i for i in range(size)], [0.25, 0.5, 0.75]))


@pytest.mark.parametrize("accuracy", [10, 4000])
def test_quantiles_of_far_apart_values(spark, accuracy):
    """Half of the values near 0, half near 1e9: bins follow ranks, not widths. A coarse sketch changes nothing."""
    df = spark.range(20_000).select(
        (F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 == 0, F.rand(3)).otherwise(1e9 + F.rand(4)).alias("value")
    ).cache()
    probs = [0.01, 0.25, 0.5, 0.75, 1.0]
    got = {r["k"]: r["quantiles"] for r in exact_quantiles(df, ["k"], probs, accuracy=accuracy).collect()}
    for key, values in df.toPandas().groupby("k")["value"]:
        assert got[key] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


def test_mode_tie_is_smallest(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), ("a", 1.0), ("b", None)], "k string, value double")
    assert [tuple(r) for r in exact_modes(df, ["k"]).collect()] == [("a", 1.0, 2)]


def test_positions_with_a_hot_sort_value(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") * 1.0).alias("v"))
    got = with_position(df, [F.col("v").asc(), F.col("id").asc()]).select("id", "position").collect()
    order = sorted(range(20_000), key=lambda i: (1.0 if i % 3 == 0 else float(i), i))
    assert {r["id"]: r["position"] for r in got} == {row: place + 1 for place, row in enumerate(order)}


def test_positions_over_many_sort_partitions(spark):
    df = spark.range(5_000).select("id", (F.col("id") % 3).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = with_position(df, [F.col("v").desc(), F.col("id").asc()])
        rows = got.select("id", "position").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(range(5_000), key=lambda i: (-(i % 3), i))
    assert {r["id"]: r["position"] for r in rows} == {row: place + 1 for place, row in enumerate(order)}


@pytest.mark.parametrize("cutoff", [70, 80, 88])
def test_similar_pairs_equal_brute_force(spark, cutoff):
    draw = random.Random(cutoff)

    def changed(word):
        letters = list(word)
        for _ in range(draw.randint(1, max(1, len(word) // 5 + 1))):
            place, kind = draw.randrange(len(letters)), draw.random()
            if kind < 0.33 and len(letters) > 1:
                del letters[place]
            elif kind < 0.66:
                letters.insert(place, draw.choice("abcd"))
            else:
                letters[place] = draw.choice("abcd")
        return "".join(letters)

    words = set()
    for _ in range(45):
        word = "".join(draw.choice("abcd") for _ in range(draw.randint(1, 30)))
        words |= {word, changed(word), changed(changed(word))}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "value string")
    got = {(r["a"], r["b"]) for r in similar_pairs(df, df, cutoff).collect()}
    expected = {
        (a, b)
        for a, b in itertools.product(words, repeat=2)
        if edit_distance(a, b) * 100 <= max(len(a), len(b)) * (100 - cutoff)
    }
    assert got == expected


def spelling_by_hand(counts, cutoff):
    """The map from all pairs: up to five most similar values, of them the most frequent, longest, most similar."""
    out = {}
    for a in counts:
        if len(a) < 3:
            continue
        near = []
        for b in counts:
            longer = max(len(a), len(b))
            edits = edit_distance(a, b)
            if edits * 100 <= longer * (100 - cutoff):
                near.append((-(100.0 * (1.0 - edits / longer)), -counts[b], b))
        top = sorted(near)[:5]
        best = min((n, -len(b), s, b) for s, n, b in top)[3]
        if best != a:
            out[a] = best
    return out


@pytest.mark.parametrize("cutoff", [50, 60, 80])
def test_spelling_map_equals_all_pairs(spark, cutoff):
    draw = random.Random(cutoff)
    counts = {"abcdefghij": 3, "abcdefghiX": 1, "Xbcdefghij": 1, "abcdXfghij": 1, "bacdefghij": 1, "abcdefghYZ": 100}
    for _ in range(12):
        word = "".join(draw.choice("abc") for _ in range(draw.randint(2, 9)))
        for _ in range(6):
            letters = list(word)
            for _ in range(draw.randint(0, 3)):
                i, kind = draw.randrange(len(letters)), draw.random()
                if kind < 0.3 and len(letters) > 1:
                    del letters[i]
                elif kind < 0.5:
                    letters.insert(i, draw.choice("abc"))
                elif kind < 0.75 and i + 1 < len(letters):
                    letters[i], letters[i + 1] = letters[i + 1], letters[i]
                else:
                    letters[i] = draw.choice("abc")
            counts.setdefault("".join(letters), draw.randint(1, 9))
    df = spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "v string")
    got = {r["value"]: r["canonical"] for r in cleaning.spelling_map(df, ["v"], cutoff).collect()}
    assert got == spelling_by_hand(counts, cutoff)


def test_crowded_values_are_settled_without_pairs(spark, monkeypatch):
    """Values with enough others one edit apart stand in groups, however the groups fall into batches."""

    def no_pairs(*_):
        raise AssertionError("pairs of values were made")

    for search in ("close_pairs", "similar_pairs"):
        monkeypatch.setattr(cleaning, search, no_pairs)
    counts = {f"Name#{i:04d}": 1 + (i * 7919) % 4 for i in range(90)}
    counts |= {f"Name#{i:03d}": 2 for i in range(6)} | {f"$1{i}": 1 + i for i in range(8)} | {f"1{i}": 9 - i for i in range(8)} | {"ab": 50, "n/a": 3}
    df = spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "v string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for rows in ("3", "10000"):
        spark.conf.set(key, rows)
        try:
            got = {r["value"]: r["canonical"] for r in cleaning.spelling_map(df, ["v"]).collect()}
        finally:
            spark.conf.unset(key)
        assert got == spelling_by_hand(counts, 80)
        assert len(got) > 50


def _nearest(data, target, row, k):
    """Row ids are positions; nan marks a gap."""
    p = data.shape[1]
    found = []
    for donor in range(len(data)):
        if np.isnan(data[donor, target]):
            continue
        both = ~np.isnan(data[row]) & ~np.isnan(data[donor])
        if both.any():
            squared = 0.0
            for axis in np.flatnonzero(both):
                squared += (data[row, axis] - data[donor, axis]) ** 2
            found.append((squared * (p / both.sum()), donor))
    found.sort()
    chosen = [data[d, target] for _, d in found[:k]]
    return float(np.mean(chosen)) if chosen else float(np.nanmean(data[:, target]))


def test_knn_with_scattered_gaps_in_five_columns(spark):
    draw = np.random.default_rng(8)
    data = np.round(draw.normal(size=(220, 5)), 2)
    data[draw.random(data.shape) < 0.3] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(data)]
    df = spark.createDataFrame(rows, "_rid long, a double, b double, c double, d double, e double")
    got = {r["_rid"]: r for r in impute.impute_knn(df).collect()}
    for i, row in enumerate(data):
        for axis, name in enumerate("abcde"):
            expected = _nearest(data, axis, i, 5) if np.isnan(row[axis]) else row[axis]
            assert got[i][name] == pytest.approx(expected, rel=1e-9, abs=1e-9), (i, name)


@pytest.mark.parametrize("small", [False, True])
def test_knn_equals_brute_force(spark, monkeypatch, small):
    if small:  # many parts and many blocks
        monkeypatch.setattr(knn, "_PART_ROWS", 20)
        monkeypatch.setattr(knn, "_BLOCK_ROWS", 7)
    draw = np.random.default_rng(3)
    data = np.round(draw.normal(size=(400, 3)) * [1, 5, 2], 1)
    data[:130] = data[0]  # a third of the rows are copies
    data[200:260, 0] += 1000  # a far cluster
    data[draw.random(data.shape) < 0.15] = np.nan
    data[7] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(data)]
    df = spark.createDataFrame(rows, "_rid long, a double, b double, c double")
    got = {r["_rid"]: r for r in impute.impute_knn(df).collect()}
    assert len(got) == len(data)
    for i, row in enumerate(data):
        for axis, name in enumerate("abc"):
            expected = _nearest(data, axis, i, 5) if np.isnan(row[axis]) else row[axis]
            assert got[i][name] == pytest.approx(expected, rel=1e-12, abs=1e-12), (i, name)


def test_knn_receivers_meet_the_donors_in_their_reach():
    draw = np.random.default_rng(5)
    donors, asked = draw.random((4000, 3)), draw.random((1000, 3))
    donors[:300] = donors[0]  # ties: lower numbers first
    asked[:50] = donors[0]
    asked[:, 2] = np.nan
    whole = knn._squared(asked, donors, ~np.isnan(donors))
    best = knn._smallest(whole, 5)
    for bound in (None, np.take_along_axis(whole, best, 1)[:, -1]):
        compared, seen = 0, []
        for rows, reached in knn._abreast(asked, donors, bound, [2], 5):
            some = donors[reached]
            squared = knn._squared(asked[rows], some, ~np.isnan(some))
            assert (reached[knn._smallest(squared, 5)] == best[rows]).all()
            compared += squared.size
            seen += rows.tolist()
        assert sorted(seen) == list(range(1000))
        assert compared < 0.3 * whole.size


def test_knn_in_line_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "_ABREAST", 8)
    monkeypatch.setattr(knn, "_PART_ROWS", 150)
    draw = np.random.default_rng(6)
    data = np.round(draw.normal(size=(900, 3)) * [40, 5, 2], 1)
    data[:60] = data[0]
    data[200:230, 0] *= 50
    data[draw.random(data.shape) < 0.1] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(data)]
    df = spark.createDataFrame(rows, "_rid long, a double, b double, c double")
    got = {r["_rid"]: r for r in impute.impute_knn(df).collect()}
    for i, row in enumerate(data):
        for axis, name in enumerate("abc"):
            expected = _nearest(data, axis, i, 5) if np.isnan(row[axis]) else row[axis]
            assert got[i][name] == pytest.approx(expected, rel=1e-12, abs=1e-12), (i, name)


@pytest.mark.parametrize("block", [1000, 3])
def test_long_values_are_compared_in_blocks(spark, monkeypatch, block):
    from quillgrid.operators import similarity

    r = random.Random(4)
    monkeypatch.setattr(similarity, "BLOCK_VALUES", block)
    values = []
    for size in (85, 99, 101, 120, 130, 300, 2000):
        base = "".join(r.choices("abcdefgh é", k=size))
        for edits in (0, 1, size // 10, size // 6, size // 4):
            text = list(base)
            for _ in range(edits):
                at = r.randrange(len(text))
                text[at : at + 1] = r.choice(["", "x", "yz"])
            values.append("".join(text))
    values = sorted(set(values))
    df = spark.createDataFrame([(k, v) for k in "pq" for v in values], "k string, value string")
    got = {(x["k"], x["a"], x["b"]) for x in similar_pairs(df, df, 80, ["k"]).collect()}
    want = set()
    for a in values:
        for b in values:
            longer = max(len(a), len(b))
            if abs(len(a) - len(b)) * 5 <= longer and (a == b or edit_distance(a, b) * 5 <= longer):
                want |= {("p", a, b), ("q", a, b)}
    assert got == want


def brute_knn(rows, p, k=5):
    """Rows ``(id, values)``: every gap from all rows that have the value."""
    means = [(lambda v: sum(v) / len(v) if v else None)([r[1][j] for r in rows if r[1][j] is not None]) for j in range(p)]
    out = {}
    for rid, own in rows:
        new = list(own)
        for j in range(p):
            if own[j] is None:
                near = []
                for other, theirs in rows:
                    both = [c for c in range(p) if own[c] is not None and theirs[c] is not None]
                    if theirs[j] is not None and both:
                        near.append((sum((own[c] - theirs[c]) ** 2 for c in both) * (p / len(both)), other, theirs[j]))
                best = sorted(near)[:k]
                new[j] = sum(b[2] for b in best) / len(best) if best else means[j]
        out[rid] = new
    return out


@pytest.mark.parametrize("p,n,share,part", [(66, 150, 0.03, 10), (4, 400, 0.25, 15), (3, 300, 0.6, 4000)])
def test_knn_of_any_width(spark, monkeypatch, p, n, share, part):
    """Nearly every row misses other columns; a rare column, copies of a point and rows of gaps."""
    r = random.Random(p)
    rows = [(i, [None if r.random() < share else float(r.choice([r.randrange(8), r.randrange(1000)])) for _ in range(p)]) for i in range(n)]
    rows += [(n + i, [1.0] * (p - 1) + [float(i)]) for i in range(60)] + [(n + 70 + i, [1.0] * (p - 1) + [None]) for i in range(5)]
    rows.append((n + 100, [None] * p))
    for i, values in rows:
        if i % 25:
            values[1] = None
    monkeypatch.setattr(knn, "_PART_ROWS", part)
    monkeypatch.setattr(knn, "_BLOCK_ROWS", 30)
    df = spark.createDataFrame([(i, *v) for i, v in rows], "_rid long, " + ", ".join(f"c{j} double" for j in range(p)))
    got = {x[0]: list(x[1:]) for x in impute.impute_knn(df).collect()}
    want = brute_knn(rows, p)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-9), i


def test_mice_recovers_a_linear_relation(spark):
    df = spark.range(3000).select(
        F.col("id").alias("_rid"),
        (F.col("id") % 97).cast("double").alias("x"),
        (F.col("id") % 31).cast("double").alias("z"),
    )
    df = df.withColumn("y", 3 * F.col("x") - 2 * F.col("z") + 7)
    gaps = df.withColumns(
        {
            "y": F.when(F.col("_rid") % 5 != 0, F.col("y")),
            "z": F.when(F.col("_rid") % 7 != 1, F.col("z")),
        }
    )
    both = impute.impute_mice(gaps).join(df.select("_rid", F.col("y").alias("ty"), F.col("z").alias("tz")), "_rid")
    worst = both.where("_rid % 35 <> 15").agg(F.max(F.abs(F.col("y") - F.col("ty"))), F.max(F.abs(F.col("z") - F.col("tz")))).first()
    assert worst[0] < 0.05 and worst[1] < 0.05
    assert both.where("y IS NULL OR z IS NULL").count() == 0


def test_outliers_do_not_depend_on_partitions(spark):
    df = spark.range(8000).select(
        F.col("id").alias("_rid"),
        F.when(F.col("id") % 400 == 0, F.col("id") * 100.0 + 10_000).otherwise((F.col("id") * 37 % 1000) / 10).alias("v"),
    )
    df = df.withColumn("v", F.when(F.col("_rid") % 50 != 3, F.col("v")))
    runs = [{r["_rid"] for r in outliers.isolation_outliers(df.repartition(n), "v").collect()} for n in (1, 7)]
    assert runs[0] == runs[1]
    assert {i for i in range(8000) if i % 400 == 0} <= runs[0]
    assert 0.03 < len(runs[0]) / 8000 <= 0.05
    assert outliers.isolation_outliers(df.withColumn("t", F.lit("x")), "t").count() == 0


def test_outliers_sampled_trees(spark):
    df = spark.range(120_000).select(F.col("id").alias("_rid"), F.when(F.col("id") < 30, 1e6).otherwise(F.col("id") % 1000).alias("v"))
    found = outliers.isolation_outliers(df, "v")
    assert found.where("_rid < 30").count() == 30


def test_dictionary_values_follow_the_text(spark):
    texts = [
        (0, "show John Doe from Sales"),
        (1, "everyone not in sales"),
        (2, "sales or marketing"),
        (3, "the johns"),
        (4, "anything by doe"),
        (5, "human, resources"),
        (6, "size #5 please"),
        (7, "size a#5 please"),
    ]
    df = spark.createDataFrame(texts, "id long, text string")
    entries = [("dept", "Sales"), ("dept", "Marketing"), ("dept", "Human Resources"), ("name", "John Doe"), ("name", "Jane Doe"), ("code", "#5")]
    dictionary = spark.createDataFrame(entries, "column string, value string")
    got = {(r["id"], r["column"]): (r["value"], r["matched"], r["negated"], r["conflict"]) for r in tag_dictionary_values(df, "text", "id", dictionary).collect()}
    assert got == {
        (0, "name"): ("john doe", "whole", False, False),
        (0, "dept"): ("sales", "whole", False, False),
        (1, "dept"): ("sales", "whole", True, False),
        (2, "dept"): (None, "whole", None, True),
        (4, "name"): (None, "word", None, True),
        (5, "dept"): ("human resources", "word", False, False),
        (6, "code"): ("#5", "whole", False, False),
    }


def test_exploded_keys_are_not_broadcast(spark):
    """Alike values take few bytes in a file, so their many keys looked small enough to send to every task."""
    from quillgrid.operators import similarity
    from quillgrid.session import materialize

    names = spark.range(5_000).select(F.format_string("Customer#%09d", "id").alias("value"))
    values = materialize(names, "names", plain=True)
    for pairs in (similarity.close_pairs(values, values, 80, [], 1), similarity.similar_pairs(values, values, 80)):
        assert "Broadcast" not in pairs._jdf.queryExecution().sparkPlan().toString()
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size(values) > 5_000 * 18 > size(materialize(names, "names"))


def test_a_sketch_for_each_value_stays_in_small_parts(spark, monkeypatch):
    """Beside a distinct count every value has a sketch of its own, so a task must hold few values."""
    from quillgrid.sources import sqlbox
    from registry import sqlbox as queries

    sizes = {}

    def watched(spark, text, **tables):
        parts = tables["dataset"].groupBy(F.spark_partition_id()).agg(F.countDistinct("o_custkey").alias("n")).collect()
        sizes[len(sizes)] = [r["n"] for r in parts]
        return sqlbox.sql(spark, text, **tables)

    monkeypatch.setattr(queries, "sql", watched)
    monkeypatch.setattr(sqlbox.dealt, "__kwdefaults__", {"rows": 100})
    row = queries.sql_approx_distinct_error(spark, "/root/testdata/sf0.01").first()
    assert row["within_five_percent"] and len(sizes[0]) > 100 and max(sizes[0]) <= 40  # 1,500 values


def test_texts_are_searched_once_for_synonyms(spark):
    """The optimizer copied the plain text into each field's search, and all searches into the filter."""
    from quillgrid.operators.text import synonym_fields, synonym_join

    df = spark.createDataFrame([(1, "the price_x and price"), (2, "age"), (3, None), (4, "nothing")], "id long, t string")
    for out in (synonym_join(df, "t", ["id"]), synonym_fields(df, "t")):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert {r["id"]: r["fields"] for r in synonym_fields(df, "t").collect()}[3] == []
