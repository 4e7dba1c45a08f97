"""Text repair: blanks, spelling variants, whole-table cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.values import strip, text_columns
from quillgrid.operators.columns import trim_headers
from quillgrid.operators.ordering import with_position
from quillgrid.operators.rows import drop_duplicates
from quillgrid.operators.similarity import CLOSE_LENGTH, close_pairs, longest_partner, most_edits, nearest_one_edit, similar_pairs, similarity
from quillgrid.session import materialize

# Texts that stand for a missing cell; the default similarity; how
# many nearest values (the value itself included) compete to be the spelling;
# the shortest value that is repaired.
MISSING_TEXTS = ["nan", "None", ""]
CUTOFF = 80
NEAREST = 5
SHORTEST = 3


def normalize_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Trim text cells and turn missing-value texts into nulls."""
    columns = columns if columns is not None else text_columns(df)
    cells = {}
    for name in columns:
        text = strip(F.col(f"`{name}`"))
        cells[name] = F.when(~text.isin(MISSING_TEXTS), text)
    return df.withColumns(cells) if cells else df


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, count`` of each non-null value."""
    value = F.col(f"`{column}`")
    return df.where(value.isNotNull()).groupBy(value.alias("value")).count()


def _counts(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("value")) for n in columns]
    )
    long = df.select(F.explode(cells).alias("_c")).select("_c.*").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))


def _partners(open_values: DataFrame, values: DataFrame, cutoff: int) -> DataFrame:
    """The values of a length that some open value's similar ones can have."""
    n = F.length("value")
    reach = F.sequence(F.ceil(n * cutoff / 100).cast("int"), longest_partner(n, cutoff))
    lengths = open_values.select("column", n.alias("_n"), F.explode(reach).alias("_l")).select("column", "_l").distinct()
    lengths = materialize(lengths, "open-lengths")
    same = (values["column"] == lengths["column"]) & (F.length(values["value"]) == lengths["_l"])
    return values.join(lengths, same, "left_semi")


def _neighbours(open_values: DataFrame, values: DataFrame, cutoff: int) -> DataFrame | None:
    """Pairs ``column, a, b``: for each open value all similar values, or at least
    its ``NEAREST`` most similar ones when there are more; None if no value is open.

    Values leave the search after two edits if ``NEAREST`` values within them are
    more similar than any value with one more edit can be (that one is longer by
    all its edits at best), or if no similar value can be further away.
    """
    if open_values.isEmpty():
        return None
    # beyond the length that the step looks at, partners could be missing
    asked = open_values.where(F.length("value") <= CLOSE_LENGTH - 2)
    pairs = close_pairs(asked, _partners(asked, values, cutoff), cutoff, ["column"], 2).where(F.levenshtein("a", "b") <= 2)
    pairs = materialize(pairs, "close-values")
    best_left = 100.0 * (1 - 3 / (F.length("a") + 3))
    nearer = F.count(F.when(similarity(F.col("a"), F.col("b")) > best_left + 1e-9, 1))
    have = pairs.groupBy("column", F.col("a").alias("value")).agg(nearer.alias("_have"))
    settled = (F.col("_have") >= NEAREST) | (most_edits(F.length("value"), cutoff) <= 2)
    done = materialize(have.where(settled).select("column", "value"), "settled-values", plain=True)
    near = pairs.join(done.withColumnRenamed("value", "a"), ["column", "a"], "left_semi")
    open_values = materialize(open_values.join(done, ["column", "value"], "left_anti"), "open-values", plain=True)
    if open_values.isEmpty():
        return near
    return near.unionByName(similar_pairs(open_values, _partners(open_values, values, cutoff), cutoff, ["column"]))


def spelling_map(df: DataFrame, columns: list[str], cutoff: int = CUTOFF) -> DataFrame:
    """``column, value, canonical`` for every value that is to be replaced.

    Each value looks at its five most similar values (itself included; more
    frequent first on equal similarity) and takes the most frequent of them,
    then the longest, then the most similar. One hop: targets are not followed.

    Values with enough others one edit apart are settled without pairs, and so
    are those too short for more edits. The rest is compared in pairs.
    """
    order = [F.col("n").desc(), F.col("value")]
    counts = materialize(with_position(_counts(df, columns), order, "r"), "value-counts", plain=True)
    values = counts.select("column", "value")
    asked = counts.where(F.length("value") >= SHORTEST)
    near = materialize(nearest_one_edit(counts, cutoff, ["column"], NEAREST - 1), "one-edit")
    seen = F.length("value") < CLOSE_LENGTH
    near = asked.where(seen).join(near, "r")
    short = seen & (most_edits(F.length("value"), cutoff) <= 1)
    settled = near.where(short | (F.col("found") == NEAREST - 1))
    to = counts.select(F.col("r").alias("best"), F.col("value").alias("canonical"))
    fixes = settled.where("best <> r").join(to, "best").select("column", "value", "canonical")
    open_values = asked.where(~short).join(settled.select("r"), "r", "left_anti").select("column", "value")
    pairs = _neighbours(materialize(open_values, "open-values", plain=True), values, cutoff)
    if pairs is None:
        return fixes
    scored = pairs.hint("merge").join(
        counts.select("column", F.col("value").alias("b"), "n"), ["column", "b"]
    ).withColumn("_s", similarity(F.col("a"), F.col("b")))
    nearest = Window.partitionBy("column", "a").orderBy(F.col("_s").desc(), F.col("n").desc(), F.col("b"))
    top = scored.withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= NEAREST)
    best = F.min(F.struct(-F.col("n"), -F.length("b"), -F.col("_s"), F.col("b").alias("canonical")))
    chosen = top.groupBy("column", F.col("a").alias("value")).agg(best.alias("_b"))
    return fixes.unionByName(chosen.select("column", "value", F.col("_b.canonical").alias("canonical")).where("value <> canonical"))


def fuzzy_canonicalize(df: DataFrame, columns: list[str], cutoff: int = CUTOFF) -> DataFrame:
    """Replace spelling variants by the most frequent similar value.

    Only distinct values are compared. The finished map is stored, so Spark
    broadcasts it when it is small and otherwise joins with skew handling.
    """
    if not columns:
        return df
    fixes = materialize(spelling_map(df, columns, cutoff), "spelling-map", plain=True)

    def repair(table: DataFrame, name: str) -> DataFrame:
        fix = fixes.where(F.col("column") == name).select(F.col("value").alias("_from"), F.col("canonical").alias("_to"))
        joined = table.join(fix, table[f"`{name}`"] == fix["_from"], "left")
        return joined.withColumn(name, F.coalesce("_to", F.col(f"`{name}`"))).drop("_from", "_to")

    return reduce(repair, columns, df)


def clean_table(df: DataFrame, columns: list[str] | None = None, cutoff: int = CUTOFF) -> DataFrame:
    """Trim headers, normalise text, repair spelling, drop repeated rows.

    Spelling is repaired in ``columns``; by default in every text column,
    whatever its values.
    """
    out = normalize_text(trim_headers(df))
    return drop_duplicates(fuzzy_canonicalize(out, text_columns(out) if columns is None else columns, cutoff))
