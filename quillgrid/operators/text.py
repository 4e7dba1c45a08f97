"""Operators over a column of sentences. All but the joins are row-local."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.number_words import pair_value, phrase_value, word_value
from quillgrid.functions.values import NOT_WORD, all_of, any_of, quoted, strip, whole_word, words_of
from quillgrid.operators.filters import NEGATION
from quillgrid.operators.prototypes import nearest_prototype  # noqa: F401
from quillgrid.operators.similarity import similar_pairs, similarity
from quillgrid.operators.tagging import tag_dictionary_values  # noqa: F401
from quillgrid.session import materialize


# --- labels by rules ---------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``label`` when every pattern in ``needs`` is found and none of ``unless``.

    With a mapping as label, the first word found by the last pattern picks it.
    """

    label: str | dict[str, str]
    needs: tuple[str, ...]
    unless: tuple[str, ...] = ()


# The request kinds and the words that reveal them, first match wins.
CALCULATIONS = {
    "sum": "SUM", "total": "SUM", "average": "AVERAGE", "avg": "AVERAGE", "mean": "AVERAGE", "median": "MEDIAN",
    "mode": "MODE", "minimum": "MIN", "min": "MIN", "maximum": "MAX", "max": "MAX", "count": "COUNT",
}
CALCULATION = whole_word("|".join(CALCULATIONS))
GROUPING = whole_word(r"group(?:ed)?\s+by|by|per|for each|for every|in each|based on")
EDIT_WORDS = r"replace|fill |set |update |change |make |convert |turn "
SEARCH_START = r"^(?:need |show |find |get |search |list |display |filter |exclude )"
NOT_A_SEARCH = r"replace|fill |set |update |change |make |sort|plot|chart|drop|impute|top |highest |bottom |lowest "
RULES = [
    Rule("SUMMARY", (r"^$",)),
    Rule("ADD_COL", (rf"{whole_word(r'(?:add|create|insert|append)\s+(?:(?:a|an|new)\s+)?(?:new\s+)?column')}|new column",)),
    Rule("ADD_ROW", (rf"{whole_word(r'(?:add|insert|append)\s+(?:(?:a|an|new)\s+)?(?:new\s+)?row')}|new row",)),
    Rule("GROUP_BY", (CALCULATION, GROUPING)),
    Rule(CALCULATIONS, (CALCULATION,)),
    Rule("ANOMALY", (r"anomaly|anomalies|outlier|outliers",)),
    Rule("UPDATE_VALUE", (EDIT_WORDS,), (r"fill missing|impute",)),
    Rule("SHOW_NULLS", (SEARCH_START, r"missing|null|empty|blank"), (NOT_A_SEARCH,)),
    Rule("FILTER", (SEARCH_START,), (NOT_A_SEARCH,)),
    Rule("GROUP_BY", (r"breakdown|grouped by|per |for each",), (r"plot|chart|graph",)),
    Rule("SORT", (r"sort|order by",)),
    Rule("TOP_N", (r"top |highest |bottom |lowest ", r"[0-9]")),
    Rule("DROP_NULLS", (r"missing|null|empty", r"drop|delete")),
    Rule("IMPUTE_KNN", (r"missing|null|empty", r"impute|fill|mice|knn")),
    Rule("SHOW_NULLS", (r"missing|null|empty",)),
    Rule("PLOT", (r"plot|chart|graph|draw",)),
    Rule("CORRELATION", (r"corr",)),
]
NO_RULE = "FILTER"


def _found(text: Column, pattern: str) -> Column:
    """``rlike``, or plain substring searches when the pattern is only a list of words."""
    words = pattern.split("|")
    if all(re.fullmatch(r"[a-z ]+", w) for w in words):
        return any_of([text.contains(w) for w in words])
    return text.rlike(pattern)


def label_by_rules(
    df: DataFrame, text_col: str, rules: list[Rule] | None = None, default: str = NO_RULE, name: str = "label"
) -> DataFrame:
    """Add the label of the first rule that fits the lower-case text."""
    # The folded text is a column of its own, so that the rules share it.
    folded = df.withColumn("_folded", F.coalesce(F.lower(strip(F.col(f"`{text_col}`"))), F.lit("")))
    text = F.col("_folded")
    label = None
    for rule in rules or RULES:
        fits = all_of([_found(text, p) for p in rule.needs] + [~_found(text, p) for p in rule.unless])
        if isinstance(rule.label, dict):
            word = F.regexp_extract(text, f"(?:^|{NOT_WORD})({'|'.join(rule.label)})(?:$|{NOT_WORD})", 1)
            value: Column = F.create_map(*[F.lit(x) for item in rule.label.items() for x in item])[word]
        else:
            value = F.lit(rule.label)
        label = F.when(fits, value) if label is None else label.when(fits, value)
    return folded.withColumn(name, label.otherwise(default)).drop("_folded")


# --- numbers in text ---------------------------------------------------------

# Digits in text, and the words never read as numbers.
DIGITS = r"-?\d+\.?\d*"
SKIPPED_WORDS = ["a", "an", "the", "in", "of", "to", "for", "with", "where", "above", "below"]


def _digit_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({DIGITS})"), 1), lambda t: t.try_cast("double"))


def extract_numbers(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep..., position, number``: every number written in digits, in order."""
    numbers = _digit_numbers(F.col(f"`{text_col}`"))
    return df.select(*quoted(keep), F.posexplode(numbers).alias("_p", "number")).select(
        *quoted(keep), (F.col("_p") + 1).alias("position"), "number"
    )


def extract_word_numbers(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep..., position, number``: positive numbers spelled as one or two words.

    In reading order, each value once, leaving out values also given in digits.
    Everything happens inside the row.
    """
    text = F.lower(F.col(f"`{text_col}`"))
    words = F.filter(words_of(text), lambda w: w.rlike("^[a-z]+$"))
    split = df.select(*quoted(keep), _digit_numbers(text).alias("_digits"), words.alias("_w"))
    values = F.transform("_w", lambda w: F.when(~w.isin(SKIPPED_WORDS), word_value(w)))
    here = split.select("*", values.alias("_v")).where(F.exists("_v", lambda v: v.isNotNull()))

    def at(i: Column) -> Column:
        value, following = F.get(F.col("_v"), i), F.get(F.col("_v"), i + 1)
        point = F.get(F.col("_w"), i) == "point"
        decimal = F.when(following < 10, following / 10)
        pair = F.when(point, decimal).when(i + 1 < F.size("_v"), pair_value(value, following))
        return F.array(value, pair)

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_v") - 1), at))
    fresh = F.array_except(F.array_distinct(F.filter(found, lambda v: v > 0)), F.col("_digits"))
    return here.select(*quoted(keep), F.posexplode(fresh).alias("_p", "number")).select(
        *quoted(keep), (F.col("_p") + 1).alias("position"), "number"
    )


# Comparison phrases, longest of a kind first, and what they mean;
# the shape of the value and its scale.
COMPARISONS = {
    ">=": ">=", "<=": "<=", "!=": "!=", "==": "==", "=": "==", ">": ">", "<": "<",
    "greater than or equal to": ">=", "greater than or equal": ">=",
    "older than or equal to": ">=", "older than or equal": ">=",
    "younger than or equal to": "<=", "younger than or equal": "<=",
    "at least": ">=", "minimum of": ">=",
    "less than or equal to": "<=", "less than or equal": "<=",
    "at most": "<=", "maximum of": "<=",
    "greater than": ">", "older than": ">", "younger than": "<", "above": ">", "more than": ">", "exceeding": ">",
    "over": ">", "less than": "<", "below": "<", "under": "<", "fewer than": "<",
}
COMPARED_VALUE = r"-?\d[\d,]*(?:\.\d+)?|[a-z]+(?:[ -]+[a-z]+){0,2}"
SCALES = {"thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6}
COMPARISON = rf"({'|'.join(COMPARISONS)})\s*\$?\s*({COMPARED_VALUE})\s*(thousand|million|[kKmM])?"


def extract_comparisons(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep..., position, operator, number``: every comparison in the text.

    Numbers may be digits or words and carry a scale ("80k"); a comparison whose
    value is no number has a null number.
    """
    text = F.regexp_replace(F.lower(F.col(f"`{text_col}`")), r"[_\-]+", " ")
    # One pass over the text; the short hits are then taken apart.
    hits = df.select(*quoted(keep), F.posexplode(F.regexp_extract_all(text, F.lit(f"({COMPARISON})"), 1)).alias("_p", "_h"))
    hits = hits.select(*quoted(keep), "_p", *[F.regexp_extract("_h", COMPARISON, i).alias(n) for i, n in ((1, "_o"), (2, "_v"), (3, "_s"))])
    operators = F.create_map(*[F.lit(x) for item in COMPARISONS.items() for x in item])
    scales = F.create_map(*[F.lit(x) for item in SCALES.items() for x in item])
    value = F.col("_v")
    digits = F.regexp_replace(value, ",", "").try_cast("double")
    spelled = phrase_value(F.split(value, "[ -]+"))
    number = F.when(value.rlike(r"^-?\d"), digits).otherwise(spelled)
    factor = F.coalesce(F.try_element_at(scales, F.lower("_s")), F.lit(1.0))
    return hits.select(
        *quoted(keep),
        (F.col("_p") + 1).alias("position"),
        operators[F.col("_o")].alias("operator"),
        (number * factor).alias("number"),
    )


# --- steps -------------------------------------------------------------------

# The words between steps, what a step may not end with, and the
# shortest step.
STEP_SEPARATOR = (
    r"(?i)(?<![\p{L}\p{N}_])(?:then|and then|after that|and next|followed by|afterwards|also)(?![\p{L}\p{N}_])|;"
)
DANGLING = r"(?i)(?:\s+(?:and|then)(?![\p{L}\p{N}_]))+\s*$"
STEP_EDGES = " \t\r\n,;."
SHORTEST_STEP = 3


def split_steps(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep..., step, query``: a compound request cut into numbered steps."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    parts = F.transform(
        F.split(text, STEP_SEPARATOR),
        lambda p: F.trim(F.regexp_replace(strip(p), DANGLING, ""), F.lit(STEP_EDGES)),
    )
    steps = F.filter(parts, lambda p: F.length(p) >= SHORTEST_STEP)
    steps = F.when(F.size(steps) > 0, steps).otherwise(F.array(strip(text)))
    return df.select(*quoted(keep), F.posexplode(steps).alias("_p", "query")).select(
        *quoted(keep), (F.col("_p") + 1).alias("step"), "query"
    )


# --- fuzzy lookups -----------------------------------------------------------

# Accepted score, its lead over the runner-up, candidate score.
LOOKUP_SCORE = 88
LOOKUP_LEAD = 6
CANDIDATE_SCORE = 70


def _sorted_words(col: Column) -> Column:
    text = F.lower(F.regexp_replace(col, r"[_\-]+", " "))
    return F.array_join(F.array_sort(F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), 1)), " ")


def _distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col(f"`{name}`").alias("value")).where(F.col("value").isNotNull()).distinct()


def fuzzy_lookup(
    df: DataFrame, column: str, entries: DataFrame, entry: str, score: int = LOOKUP_SCORE, lead: int = LOOKUP_LEAD
) -> DataFrame:
    """``value, match, score`` for each distinct value with one clearly best entry.

    Words are compared in sorted order. The best entry needs the score and must
    lead the runner-up; a value without such an entry is left out.
    """
    left = materialize(_distinct_values(df, column).withColumn("_k", _sorted_words(F.col("value"))), "lookup-values")
    right = materialize(_distinct_values(entries, entry).withColumn("_k", _sorted_words(F.col("value"))), "lookup-entries")
    keys = [t.where("_k <> ''").select(F.col("_k").alias("value")).distinct() for t in (left, right)]
    pairs = similar_pairs(*keys, score - lead).withColumn("_s", similarity(F.col("a"), F.col("b")))
    # Two entries with the same sorted words share a score, hence no lead.
    named = right.groupBy(F.col("_k").alias("b")).agg(F.min("value").alias("match"), F.count("*").alias("_same"))
    ranked = Window.partitionBy("a").orderBy(F.col("_s").desc(), "b")
    top = (
        pairs.withColumn("_r", F.row_number().over(ranked))
        .where("_r <= 2")
        .groupBy("a")
        .agg(
            F.min_by("b", "_r").alias("b"),
            F.max("_s").alias("_best"),
            F.max(F.when(F.col("_r") == 2, F.col("_s"))).alias("_second"),
        )
    )
    clear = (F.col("_best") >= score) & (F.col("_best") - F.coalesce("_second", F.lit(0.0)) >= lead)
    chosen = top.where(clear).join(named.where("_same = 1"), "b")
    return left.join(chosen, left["_k"] == chosen["a"]).select("value", "match", F.bround("_best", 4).alias("score"))


def fuzzy_candidates(
    df: DataFrame, column: str, entries: DataFrame, entry: str, score: int = CANDIDATE_SCORE
) -> DataFrame:
    """``value, match, how``: every entry a value may mean.

    ``exact`` ignores case; ``part`` means one text holds the other (both of
    three or more letters); ``similar`` reaches the score.
    """
    left, right = (
        materialize(_distinct_values(t, n).withColumn("_k", F.lower("value")), "candidate-values")
        for t, n in ((df, column), (entries, entry))
    )
    left_keys = left.where(F.length("_k") >= 3).select("_k").distinct()
    right_keys = right.select("_k").distinct()
    exact = left.select(F.col("_k").alias("a")).distinct().join(right_keys, F.col("a") == F.col("_k"), "left_semi")
    long_right = right_keys.where(F.length("_k") >= 3)
    inner = _parts(long_right, "b", left_keys).join(left_keys.withColumnRenamed("_k", "a"), F.col("_part") == F.col("a"))
    outer = _parts(left_keys, "a", long_right).join(long_right.withColumnRenamed("_k", "b"), F.col("_part") == F.col("b"))
    similar = similar_pairs(
        left_keys.withColumnRenamed("_k", "value"), right_keys.withColumnRenamed("_k", "value"), score
    )
    pairs = (
        exact.select("a", F.col("a").alias("b"), F.lit(1).alias("_how"))
        .unionByName(inner.select("a", "b", F.lit(2).alias("_how")))
        .unionByName(outer.select("a", "b", F.lit(2).alias("_how")))
        .unionByName(similar.select("a", "b", F.lit(3).alias("_how")))
        .groupBy("a", "b")
        .agg(F.min("_how").alias("_how"))
    )
    how = F.element_at(F.array(F.lit("exact"), F.lit("part"), F.lit("similar")), F.col("_how"))
    named = pairs.join(left.select("value", F.col("_k").alias("a")), "a")
    return named.join(right.select(F.col("value").alias("match"), F.col("_k").alias("b")), "b").select(
        "value", "match", how.alias("how")
    )


def _parts(keys: DataFrame, name: str, needles: DataFrame) -> DataFrame:
    """The pieces of each key that are as long as some needle, to be met by equality."""
    lengths = sorted(needles.agg(F.collect_set(F.length("_k"))).first()[0])  # one number per length
    text = F.col("_k")
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(text))
    parts = F.flatten(
        F.transform(
            fitting,
            lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)),
        )
    )
    return keys.select(text.alias(name), F.explode(F.array_distinct(parts)).alias("_part"))


# Words that mean a field.
SYNONYMS = {
    "salary": ["salary", "salaries", "pay", "wage", "wages", "earning", "earnings", "income", "compensation"],
    "department": ["department", "departments", "team", "teams", "division", "unit", "dept", "group"],
    "age": ["age", "ages", "older", "aged", "years old", "year old"],
    "person": ["name", "names", "staff", "worker", "workers", "person", "people", "individual", "customer", "client"],
    "location": ["city", "region", "location", "place", "country", "state"],
    "date": ["date", "day", "month", "year", "time", "created", "occurred"],
    "price": ["price", "cost", "amount", "value", "revenue", "sales", "profit"],
}


def _fields(text_col: str, synonyms: dict[str, list[str]] | None) -> Column:
    """A list of one entry, the fields of the text. As the argument of a function the text is made plain once, not for each field."""

    def hits(text: Column) -> Column:
        return F.array_compact(F.array(*[F.when(text.rlike(whole_word("|".join(words))), F.lit(f)) for f, words in (synonyms or SYNONYMS).items()]))

    return F.transform(F.array(F.regexp_replace(F.lower(F.col(f"`{text_col}`")), r"[_\-]+", " ")), hits)


def synonym_fields(df: DataFrame, text_col: str, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """Add ``fields``: every field whose words stand in the text, in table order."""
    return df.withColumn("fields", _fields(text_col, synonyms)[0])


def synonym_join(
    df: DataFrame, text_col: str, keep: list[str], synonyms: dict[str, list[str]] | None = None
) -> DataFrame:
    """``keep..., field`` for texts that point to exactly one field. No shuffle."""
    # a filter before the list is taken apart would search every text again
    only = F.filter(_fields(text_col, synonyms), lambda fields: F.size(fields) == 1)
    return df.select(*quoted(keep), F.explode(only).alias("_fields")).select(*quoted(keep), F.col("_fields")[0].alias("field"))


