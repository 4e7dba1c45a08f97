"""Finding similar strings without comparing every pair.

similarity(a, b) = 100 * (1 - edits / longer length), edits = Levenshtein
distance. It works on characters, so reordered words are not recognised.

Three exact candidate filters, chosen by the length of the longer string:

* one or two allowed edits: two strings within k edits share a string that
  each reaches by deleting at most k characters (Bocek et al., fast similarity
  search in large dictionaries, 2007);
* more allowed edits: a string cut into k + 1 pieces has one piece unchanged in
  the other string, shifted by at most k (Li et al., PASS-JOIN, 2011).

* beyond ``LONGEST`` characters pieces get too short to tell strings apart:
  strings of near lengths meet in blocks, where the counts of their character
  pairs bound the distance from below (an edit changes four of them at most).

The first two turn the search into an equi-join on short keys, which Spark
spreads; the real distance is then computed for the candidates only.

``nearest_one_edit`` makes no pairs at all: values that differ in one place only
form a group, and each of them needs the group's first few alone.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.session import materialize

# Functions sent to the workers travel by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_DELETIONS = 2
LONGEST = 100  # characters of a string found by its pieces
BLOCK_VALUES = 1_000  # long strings compared in one call, on each side
_PAIR_COUNTERS = 512
CLOSE_LENGTH = 40  # longest string of ``close_pairs``


def similarity(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.lit(100.0) * (F.lit(1.0) - F.levenshtein(a, b) / longer)


def within(a: Column, b: Column, cutoff: int) -> Column:
    """similarity >= cutoff, in whole numbers so that exact hits cannot flip."""
    return F.levenshtein(a, b) * 100 <= F.greatest(F.length(a), F.length(b)) * (100 - cutoff)


def _short_limit(cutoff: int) -> int:
    """Longest string for which at most ``_DELETIONS`` edits are allowed."""
    longest = 1
    while (longest + 1) * (100 - cutoff) // 100 <= _DELETIONS:
        longest += 1
    return longest


def longest_partner(length: Column, cutoff: int) -> Column:
    return F.floor(length * 100 / cutoff).cast("int")


def most_edits(length: Column, cutoff: int) -> Column:
    """Edits between a value of this length and its similar values, at most."""
    return _edits(longest_partner(length, cutoff), cutoff)


def _edits(length: Column, cutoff: int) -> Column:
    return F.floor(length * (100 - cutoff) / 100).cast("int")


def _variants(text: Column, depth: Column) -> Column:
    """The text and all strings left after deleting one or two characters."""
    length = F.length(text)

    def part(first, last) -> Column:
        return F.substring(text, first, last - first + 1)

    one = F.transform(F.sequence(F.lit(1), length), lambda i: F.concat(part(F.lit(1), i - 1), part(i + 1, length)))
    two = F.flatten(
        F.transform(
            F.sequence(F.lit(1), length - 1),
            lambda i: F.transform(
                F.sequence(i + 1, length),
                lambda j: F.concat(part(F.lit(1), i - 1), part(i + 1, j - 1), part(j + 1, length)),
            ),
        )
    )
    none = F.array().cast("array<string>")
    return F.array_distinct(
        F.concat(
            F.array(text),
            F.when((depth >= 1) & (length >= 1), one).otherwise(none),
            F.when((depth >= 2) & (length >= 2), two).otherwise(none),
        )
    )


def _deletion_keys(values: DataFrame, keys: list[str], depth: Column) -> DataFrame:
    return values.select(*keys, "value", F.explode(_variants(F.col("value"), depth)).alias("_key"))


def _piece_start(i: Column, length: Column, pieces: Column) -> Column:
    return F.floor(i * length / pieces).cast("int")


def _index_pieces(values: DataFrame, keys: list[str], cutoff: int) -> DataFrame:
    length = F.length("value")
    edits = most_edits(length, cutoff)
    pieces = values.select(
        *keys, "value", length.alias("_m"), (edits + 1).alias("_p"), F.explode(F.sequence(F.lit(0), edits)).alias("_i")
    )
    start = _piece_start(F.col("_i"), F.col("_m"), F.col("_p"))
    size = _piece_start(F.col("_i") + 1, F.col("_m"), F.col("_p")) - start
    return pieces.select(*keys, "value", "_m", "_i", F.substring(F.col("value"), start + 1, size).alias("_key"))


def _probe_pieces(values: DataFrame, keys: list[str], cutoff: int, limit: int) -> DataFrame:
    """For the longer string of a pair: every place a shorter one's piece may sit."""
    n = F.length("value")
    shortest = F.ceil(n * cutoff / 100).cast("int")
    lengths = values.where(n > limit).select(
        *keys, "value", n.alias("_n"), F.explode(F.sequence(shortest, n)).alias("_m")
    )
    edits = _edits(longest_partner(F.col("_m"), cutoff), cutoff)
    pieces = lengths.select("*", edits.alias("_k"), F.explode(F.sequence(F.lit(0), edits)).alias("_i"))
    start = _piece_start(F.col("_i"), F.col("_m"), F.col("_k") + 1)
    size = _piece_start(F.col("_i") + 1, F.col("_m"), F.col("_k") + 1) - start
    spots = pieces.select(
        "*",
        size.alias("_size"),
        F.explode(
            F.filter(
                F.transform(F.sequence(-F.col("_k"), F.col("_k")), lambda s: start + s),
                lambda at: (at >= 0) & (at + size <= F.col("_n")),
            )
        ).alias("_at"),
    )
    return spots.select(
        *keys, "value", "_m", "_i", F.substring(F.col("value"), F.col("_at") + 1, F.col("_size")).alias("_key")
    ).distinct()


def _share_a_deletion(left: DataFrame, right: DataFrame, keys: list[str], depth: Column) -> DataFrame:
    a = _deletion_keys(left, keys, depth).withColumnRenamed("value", "a")
    b = _deletion_keys(right, keys, depth).withColumnRenamed("value", "b")
    # far more keys than the values' size tells: never sent to every task
    return a.hint("merge").join(b.hint("merge"), [*keys, "_key"]).select(*keys, "a", "b")


def _verified(pairs: DataFrame, cutoff: int) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    size_ok = F.least(F.length(a), F.length(b)) * 100 >= F.greatest(F.length(a), F.length(b)) * cutoff
    return pairs.where(size_ok).distinct().where(within(a, b, cutoff))


def close_pairs(left: DataFrame, right: DataFrame, cutoff: int, keys: list[str], edits: int) -> DataFrame:
    """All similar pairs at most ``edits`` (1 or 2) apart, strings up to ``CLOSE_LENGTH`` long.

    Some pairs further apart are among them: a swap of two letters shares a
    string with one deletion. A key group holds near matches only and cannot
    grow into all pairs of the table.
    """
    short = F.length("value") <= CLOSE_LENGTH
    depth = F.least(_edits(longest_partner(F.length("value"), cutoff), cutoff), F.lit(edits))
    return _verified(_share_a_deletion(left.where(short), right.where(short), keys, depth), cutoff)


def _one_edit_keys(values: DataFrame, keys: list[str], cutoff: int) -> DataFrame:
    """``_x, _y, _kind, r, n``: a 128-bit hash for each group that a value belongs to.

    ``_kind`` 2: the places of a value, each with what is left without its
    character, so a group's values differ in that place alone. 1: what is left without any one
    character. 0: the value itself, in the group of those with one character more.
    Lengths without a value have no such groups.
    """
    value, length = F.col("value"), F.length("value")
    lengths = materialize(values.select(*keys, length.alias("_l")).distinct(), "lengths")
    there = lambda shift, name: lengths.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], (F.col("_l") + shift).alias(name))
    same = lambda name: [F.col(k).eqNullSafe(F.col(f"{name}_{k}")) for k in keys] + [length == F.col(name)]
    known = values.join(there(1, "_shorter"), same("_shorter"), "left").join(there(-1, "_longer"), same("_longer"), "left")
    allowed = lambda longer: longer * (100 - cutoff) >= 100
    group = lambda kind, place, text: F.struct(
        F.xxhash64(F.lit(1), *keys, place, text).alias("_x"), F.xxhash64(F.lit(2), text, place, *keys).alias("_y"), F.lit(kind).alias("_kind")
    )
    without = lambda i: F.concat(F.substring(value, F.lit(1), i - 1), F.substring(value, i + 1, length - i))
    places, own = F.sequence(F.lit(1), length), F.lit(0)
    none = F.filter(F.array(group(0, own, value)), lambda _: F.lit(False))
    groups = F.concat(
        F.when(allowed(length) & (length < CLOSE_LENGTH), F.transform(places, lambda i: group(2, i, without(i)))).otherwise(none),
        F.when(
            allowed(length) & F.col("_shorter").isNotNull(),
            F.transform(F.array_distinct(F.transform(places, without)), lambda text: group(1, own, text)),
        ).otherwise(none),
        F.when(allowed(length + 1) & F.col("_longer").isNotNull(), F.array(group(0, own, value))).otherwise(none),
    )
    return known.where((length >= 1) & (length <= CLOSE_LENGTH)).select("r", "n", F.explode(groups).alias("_g")).select("_g.*", "r", "n")


def _whole_groups(batches, names: list[str]):
    """Tables of sorted batches, cut only where the columns ``names`` change."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in names]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        first = held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in names)
        cut = int(new[-1]) if len(new) else 0
        if cut or first:
            whole = [*held, batch.slice(0, cut)] if cut else held
            held = []
            yield pa.Table.from_batches(whole)
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _group_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Whether a row begins a group."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def nearest_one_edit(values: DataFrame, cutoff: int, keys: list[str], most: int) -> DataFrame:
    """``r, found, best``: how many values, at most ``most``, are similar to a value and one edit apart, and
    the ``r`` of the most frequent, then longest, then most similar, then first of these and itself.

    ``values`` holds distinct ``(keys..., value)`` with their frequency ``n`` and a
    number ``r`` that rises from frequent to rare and then from small to large. Where
    there are more than ``most``, those with one character more go first (they are
    more similar), then those with the smaller ``r``. Values without such a
    neighbour are left out. Only those shorter than ``CLOSE_LENGTH`` have all theirs.
    """

    def meet(batches):
        for rows in _whole_groups(batches, ["_x", "_y"]):
            x, y, kind, r, n = (rows.column(c).to_numpy() for c in ("_x", "_y", "_kind", "r", "n"))
            new = _group_starts([x, y])
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            start, size = starts[group], np.diff([*starts, len(x)])[group]
            place = np.arange(len(x)) - start
            t = np.arange(most)
            # of the same length: the group's first ones but itself
            of_place = np.flatnonzero((kind == 2) & (size > 1))
            a = start[of_place, None] + t + (t >= place[of_place, None])
            a_fits = t < size[of_place, None] - 1
            # one character more: they come after the value itself in its group
            with_own = kind[start] == 0
            own = np.flatnonzero(with_own & (place == 0) & (size > 1))
            b = own[:, None] + 1 + t
            b_fits = t < size[own, None] - 1
            # one character less
            less = np.flatnonzero(with_own & (place > 0))
            at = np.concatenate([of_place, own, less])
            more = np.repeat(np.array([0, 1, -1], np.int8), [len(of_place), len(own), len(less)])
            others = np.concatenate([a[a_fits], b[b_fits], start[less]])
            counts = np.concatenate([a_fits.sum(axis=1), b_fits.sum(axis=1), np.ones(len(less), np.int64)])
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c[others])) for c in (r, n)]
            yield pa.RecordBatch.from_arrays([pa.array(r[at]), pa.array(n[at]), pa.array(more), *lists], names=["r", "n", "more", "others", "ns"])

    def choose(batches):
        for rows in _whole_groups(batches, ["r"]):
            rows = rows.combine_chunks()
            own_r, own_n, more = (rows.column(c).to_numpy() for c in ("r", "n", "more"))
            lists = [rows.column(c).chunk(0) for c in ("others", "ns")]
            others, ns = (c.flatten().to_numpy() for c in lists)
            line = np.repeat(np.arange(len(own_r)), np.diff(lists[0].offsets.to_numpy()))
            order = np.lexsort([others, more[line] != 1, own_r[line]])
            line, others, ns = line[order], others[order], ns[order]
            new = _group_starts([own_r[line]])
            starts = np.flatnonzero(new)
            near = np.arange(len(line)) - starts[np.cumsum(new) - 1] < most
            line, others, ns = line[near], others[near], ns[near]
            starts = np.flatnonzero(_group_starts([own_r[line]]))
            first = line[starts]  # with itself
            a = np.concatenate([own_r[first], own_r[line]])
            b, n = np.concatenate([own_r[first], others]), np.concatenate([own_n[first], ns])
            longer = np.concatenate([np.zeros(len(first), np.int8), more[line]])
            order = np.lexsort([b, a != b, -longer, -n, a])
            best = b[order][_group_starts([a[order]])]
            found = np.diff([*starts, len(line)])
            yield pa.RecordBatch.from_arrays([pa.array(own_r[first]), pa.array(found, pa.int32()), pa.array(best)], names=["r", "found", "best"])

    rows = _one_edit_keys(values, keys, cutoff)
    met = rows.repartition("_x").sortWithinPartitions("_x", "_y", "_kind", "r").mapInArrow(
        meet, "r long, n long, more byte, others array<long>, ns array<long>"
    )
    return met.repartition("r").sortWithinPartitions("r").mapInArrow(choose, "r long, found int, best long")


def similar_pairs(left: DataFrame, right: DataFrame, cutoff: int, keys: list[str] | None = None) -> DataFrame:
    """``keys, a, b``: all pairs with similarity >= cutoff.

    ``left`` and ``right`` hold distinct ``(keys..., value)`` rows; only values
    with equal keys are compared.
    """
    keys = keys or []
    long = _long_pairs(left, right, cutoff, keys)
    left, right = (side.where(F.length("value") <= LONGEST) for side in (left, right))
    limit = _short_limit(cutoff)
    short = F.length("value") <= limit
    depth = _edits(F.least(F.lit(limit), longest_partner(F.length("value"), cutoff)), cutoff)
    out = _share_a_deletion(left.where(short), right.where(short), keys, depth)
    on = [*keys, "_m", "_i", "_key"]
    for longer, shorter, x, y in ((left, right, "a", "b"), (right, left, "b", "a")):
        probe = _probe_pieces(longer, keys, cutoff, limit).withColumnRenamed("value", x)
        index = _index_pieces(shorter, keys, cutoff).withColumnRenamed("value", y)
        out = out.unionByName(probe.hint("merge").join(index.hint("merge"), on).select(*keys, "a", "b"))
    return _verified(out.unionByName(long) if long is not None else out, cutoff)


def _long_pairs(left: DataFrame, right: DataFrame, cutoff: int, keys: list[str]) -> DataFrame | None:
    """Candidates ``keys, a, b`` whose longer string has over ``LONGEST`` characters; None if there is none.

    Strings stand in bands of lengths, each reaching to ``100 / cutoff`` times
    its start, so that partners are at most one band apart. Bands are cut into
    blocks on both sides and compared block by block.
    """
    partner = math.ceil(LONGEST * cutoff / 100)
    if not 0 < cutoff < 100 or left.unionByName(right).where(F.length("value") > LONGEST).isEmpty():
        return None
    band = F.floor(F.log(F.length("value").cast("double")) / F.lit(math.log(100 / cutoff))).cast("int")
    near = F.explode(F.array(band - 1, band, band + 1)).alias("_band")
    a = materialize(left.where(F.length("value") >= partner).select(*keys, F.col("value").alias("a"), near), "long-left")
    b = materialize(right.where(F.length("value") >= partner).select(*keys, F.col("value").alias("b"), band.alias("_band")), "long-right")
    on = [*keys, "_band"]
    blocks = lambda side, name: side.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK_VALUES).cast("int").alias(name))
    plan = materialize(blocks(a, "_na").join(blocks(b, "_nb"), on), "long-blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    rows_a = a.join(plan, on).select(*on, own("a", "_na").alias("_i"), every("_nb").alias("_j"), "a")
    rows_b = b.join(plan, on).select(*on, every("_na").alias("_i"), own("b", "_nb").alias("_j"), "b")
    share = 100 - cutoff
    schema = T.StructType([*[left.schema[k] for k in keys], T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])

    def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(texts), _PAIR_COUNTERS), np.int32)
        for i, t in enumerate(texts):
            points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            pairs = (points[:-1] * np.uint64(0x9E3779B1) + points[1:]) * np.uint64(0x85EBCA6B)
            out[i] = np.bincount(((pairs >> np.uint64(16)) % np.uint64(_PAIR_COUNTERS)).astype(np.int64), minlength=_PAIR_COUNTERS)
        return out, np.array([len(t) for t in texts])

    def compare(_key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        texts, others = one["a"].to_pylist(), two["b"].to_pylist()
        found_a, found_b = [], []
        if texts and others:
            (x, n), (y, m) = counted(texts), counted(others)
            for i in range(len(texts)):
                most = np.maximum(n[i], m) * share // 100
                close = (np.abs(n[i] - m) <= most) & (np.maximum(n[i], m) > LONGEST)
                at = np.flatnonzero(close)
                at = at[np.abs(y[at] - x[i]).sum(axis=1) <= 4 * most[at]]
                found_a += [i] * len(at)
                found_b += at.tolist()
        columns = [(one if len(found_a) else one.slice(0, 0))[k].take(pa.array(found_a, pa.int64())) for k in keys]
        return pa.table([*columns, one["a"].take(pa.array(found_a, pa.int64())), two["b"].take(pa.array(found_b, pa.int64()))], names=schema.names)

    by = [*on, "_i", "_j"]
    return rows_a.groupBy(*by).cogroup(rows_b.groupBy(*by)).applyInArrow(compare, schema)
