"""English number words as column expressions (up to three words)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "hundred": 100, "thousand": 1000, "million": 1000000, "billion": 1000000000,
}
DECIMAL_POINT = "point"


def _table() -> Column:
    return F.create_map(*[F.lit(x) for word, value in NUMBER_WORDS.items() for x in (word, float(value))])


def word_value(word: Column) -> Column:
    """One word to its number; null for any other word."""
    return F.try_element_at(_table(), word)


def _pair(a: Column, b: Column) -> Column:
    """Two words below a thousand: "five hundred" multiplies, "forty two" adds."""
    return F.when((a == 100) | (b == 100), a * b).otherwise(a + b)


def pair_value(a: Column, b: Column) -> Column:
    """The number two neighbouring words spell, where at least one is a number word.

    ``a`` and ``b`` are the values of the words (null for other words). A big
    unit ("thousand") multiplies what stands before it; a leading one spells
    nothing.
    """
    both = F.when(a >= 1000, F.lit(None)).when(b >= 1000, a * b).otherwise(_pair(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), both).otherwise(F.coalesce(a, b))


def phrase_value(words: Column) -> Column:
    """The number spelled by up to three words; words that are no numbers are skipped."""
    values = F.filter(F.transform(words, word_value), lambda v: v.isNotNull())
    a, b, c = (F.get(values, i) for i in range(3))
    three = (
        F.when(a >= 1000, F.lit(None))
        .when((b >= 1000) & (c >= 1000), F.lit(None))
        .when(b >= 1000, a * b + c)
        .when(c >= 1000, _pair(a, b) * c)
        .otherwise(a * b + c)
    )
    whole = F.when(F.size(values) >= 3, three).when(F.size(values) == 2, pair_value(a, b)).otherwise(a)
    at = F.array_position(words, DECIMAL_POINT)
    tail = F.transform(F.slice(words, F.greatest(at, F.lit(1)).cast("int") + 1, 2), word_value)
    tenth, hundredth = F.get(tail, 0), F.get(tail, 1)
    head = F.when(at > 1, word_value(F.get(words, (at - 2).cast("int")))).otherwise(F.lit(0.0))
    decimal = (
        F.coalesce(head, F.lit(0.0))
        + F.when(tenth < 10, tenth / 10).otherwise(0.0)
        + F.when(hundredth < 10, hundredth / 100).otherwise(0.0)
    )
    return F.when((at > 0) & (F.size(values) > 0), decimal).otherwise(whole)
