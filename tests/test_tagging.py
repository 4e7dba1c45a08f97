"""Dictionary tagging: shards of any size agree, and a plain search finds the same."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import tagging

NEGATIONS = ("not", "except", "without")


def rows_of(spark, texts, values):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    dictionary = spark.createDataFrame(values, "column string, value string")
    return sorted(map(tuple, tagging.tag_dictionary_values(df, "body", "id", dictionary).collect()))


def plain(texts, values):
    """Whole values by a pattern per value; shared words else."""
    pairs = {(c, v.strip().lower()) for c, v in values if v and re.search(r"\w", v)}
    out = []
    for i, raw in enumerate(texts):
        if raw is None:
            continue
        text = re.sub(r"[_\-]+", " ", raw.lower())
        whole, loose = {}, {}
        for c, v in pairs:
            if re.search(rf"(?<!\w){re.escape(v)}(?!\w)", text):
                whole.setdefault(c, set()).add(v)
            if {w for w in re.findall(r"[\w']+", v) if len(w) > 2} & {w for w in re.findall(r"[\w']+", text) if len(w) > 2}:
                loose.setdefault(c, set()).add(v)
        out += [(i, c, min(v) if len(v) == 1 else None, "whole" if whole else "word", len(v) > 1) for c, v in (whole or loose).items()]
    return sorted(out)


@pytest.mark.parametrize("chars", [1 << 22, 30])
def test_equals_plain_search(spark, monkeypatch, chars):
    r = random.Random(2)
    words = ["red", "blue", "car", "big", "it's", "c++", "x", "a.b", "é", "42", "sea"]
    values = [(r.choice("pq"), " ".join(r.choices(words, k=r.choice([1, 1, 2, 3])))) for _ in range(40)] + [("p", None), ("p", "  "), ("p", "!!"), ("q", " Red ")]
    texts = [r.choice([" ", "_", ", "]).join(r.choices([*words, "other", "Redder"], k=r.randrange(1, 8))) for _ in range(120)] + [None, "", "!!"]
    monkeypatch.setattr(tagging, "SHARD_CHARS", chars)
    assert [(a, b, c, d, f) for a, b, c, d, _, f in rows_of(spark, texts, values)] == plain(texts, values)


def test_negation_and_empty_dictionary(spark):
    got = rows_of(spark, ["all but not the red car", "red\nnot blue", "blue, not red"], [("c", "red"), ("c", "green")])
    assert [r[4] for r in got] == [True, False, True]
    assert rows_of(spark, ["red"], [("c", "!!")]) == []


def test_texts_are_not_shuffled(spark):
    df = spark.range(5).select("id", F.lit("red").alias("body"))
    found = tagging.tag_dictionary_values(df, "body", "id", spark.createDataFrame([("c", "red")], "column string, value string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
