"""Dictionary values in text, by an Aho-Corasick automaton.

The automaton over all values reads each text once, where the text lies; no text
is shuffled. A large dictionary is cut into shards of bounded size, each with a
pass of its own, and only hits are put together.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.values import NOT_WORD, strip
from quillgrid.operators.filters import NEGATION
from quillgrid.session import materialize

# Functions sent to the workers travel by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_CHARS = 4 << 20  # of the values in one automaton, on average
_AFTER_NEGATION = f"(?:^|{NOT_WORD})(?:{NEGATION})({NOT_WORD}.*)"
_LONG_WORD = r"(?:[\p{L}\p{N}_]|')+"
_HIT = T.StructType(
    [
        T.StructField("column", T.StringType()), T.StructField("low", T.StringType()), T.StructField("high", T.StringType()),
        T.StructField("whole", T.BooleanType()), T.StructField("negated", T.BooleanType()),
    ]
)


def tag_dictionary_values(df: DataFrame, text_col: str, rid: str, dictionary: DataFrame) -> DataFrame:
    """Which ``(column, value)`` pairs of a dictionary does each text name?

    Output per text and column: ``rid, column, value, matched, negated,
    conflict``. ``matched`` is ``whole`` when the text holds the whole value; only
    for texts without any whole value it is ``word``: a shared word of three or
    more letters. Several values of one column are a conflict and leave ``value``
    null. A value is negated where it follows a negation word in its line.
    """
    value = F.lower(strip(F.col("value")))
    pairs = dictionary.where(F.col("value").isNotNull()).select("column", value.alias("value")).distinct()
    pairs = materialize(pairs.where(F.col("value").rlike(r"[\p{L}\p{N}_]")), "dictionary")
    chars = pairs.agg(F.sum(F.length("value"))).first()[0] or 0
    shards = max(1, -(-chars // SHARD_CHARS))
    text = F.regexp_replace(F.lower(F.col(f"`{text_col}`")), r"[_\-]+", " ")
    texts = df.select(F.col(f"`{rid}`").alias(rid), text.alias("_text")).where(F.col("_text").isNotNull())
    # what follows a negation word in each line, and the words that may stand for a value
    texts = texts.withColumns(
        {
            "_tails": F.regexp_extract_all("_text", F.lit(_AFTER_NEGATION), 1),
            "_words": F.array_distinct(F.filter(F.regexp_extract_all("_text", F.lit(f"({_LONG_WORD})"), 1), lambda w: F.length(w) >= 3)),
        }
    )
    parts = []
    for shard in range(shards):
        own = pairs.where(F.pmod(F.xxhash64("value"), F.lit(shards)) == shard)
        words = F.array_distinct(F.filter(F.regexp_extract_all("value", F.lit(f"({_LONG_WORD})"), 1), lambda w: F.length(w) >= 3))
        rows = own.groupBy("value").agg(F.collect_list("column").alias("columns")).withColumn("words", words).collect()  # one shard
        parts.append(_hits(texts, rid, [(r["value"], r["columns"], r["words"]) for r in rows]))
    hits = parts[0]
    if shards > 1:
        for part in parts[1:]:
            hits = hits.unionByName(part)
        hits = materialize(hits, "dictionary-hits")
        named = hits.where("whole").select(F.col(f"`{rid}`").alias("_named")).distinct()
        loose = hits.where("not whole").join(named, F.col(f"`{rid}`").eqNullSafe(F.col("_named")), "left_anti")
        hits = (
            hits.where("whole").unionByName(loose).groupBy(F.col(f"`{rid}`").alias(rid), "column", "whole")
            .agg(F.max_by("negated", "high").alias("negated"), F.min("low").alias("low"), F.max("high").alias("high"))
        )
    one = F.col("low") == F.col("high")
    return hits.select(
        F.col(f"`{rid}`").alias(rid),
        "column",
        F.when(one, F.col("low")).alias("value"),
        F.when(F.col("whole"), "whole").otherwise("word").alias("matched"),
        F.when(one, F.col("negated")).alias("negated"),
        (~one).alias("conflict"),
    )


def _is_word(char: str) -> bool:
    return char == "_" or char.isalnum()


def _alone(text: str, start: int, end: int) -> bool:
    """No word character touches the stretch from outside."""
    return not (start > 0 and _is_word(text[start - 1])) and not (end < len(text) and _is_word(text[end]))


def _stands_in(text: str, value: str) -> bool:
    at = text.find(value)
    while at >= 0:
        if _alone(text, at, at + len(value)):
            return True
        at = text.find(value, at + 1)
    return False


class _Tagger:
    """An automaton over the values, and which values hold a long word."""

    def __init__(self, values: list[tuple[str, list[str], list[str]]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.by_word: dict[str, dict[str, tuple[str, str]]] = {}
        for value, columns, words in values:
            self.automaton.add_word(value, (value, columns))
            for word in words:
                ends = self.by_word.setdefault(word, {})
                for column in columns:
                    low, high = ends.get(column, (value, value))
                    ends[column] = min(low, value), max(high, value)
        if values:
            self.automaton.make_automaton()

    def hits(self, text: str, tails: list[str], words: list[str]) -> list[tuple[str, str, str, bool, bool]]:
        """``column, low, high, whole, negated`` of one text."""
        found: dict[str, tuple[str, str]] = {}
        if len(self.automaton):
            for last, (value, columns) in self.automaton.iter(text):
                if _alone(text, last + 1 - len(value), last + 1):
                    for column in columns:
                        low, high = found.get(column, (value, value))
                        found[column] = min(low, value), max(high, value)
        whole = bool(found)
        if not whole:
            for word in words:
                for column, (a, b) in self.by_word.get(word, {}).items():
                    low, high = found.get(column, (a, b))
                    found[column] = min(low, a), max(high, b)
        return [(c, low, high, whole, any(_stands_in(t, high) for t in tails)) for c, (low, high) in found.items()]


def _hits(texts: DataFrame, rid: str, values: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    kind = texts.schema[rid]
    shared = texts.sparkSession.sparkContext.broadcast(values)

    def run(batches):
        tagger = _Tagger(shared.value)
        for batch in batches:
            rows, found = [], []
            for i, row in enumerate(zip(*[batch.column(c).to_pylist() for c in (1, 2, 3)], strict=True)):
                own = tagger.hits(*row)
                found += own
                rows += [i] * len(own)
            columns = list(zip(*found, strict=True)) or [[]] * 5
            kinds = [pa.string()] * 3 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                names=["_id", *_HIT.names],
            )

    plain = texts.toDF("_id", *texts.columns[1:])  # a name that any Arrow version takes
    out = plain.mapInArrow(run, T.StructType([T.StructField("_id", kind.dataType), *_HIT.fields]))
    return out.toDF(rid, *_HIT.names)
