"""Exact nearest-row imputation without comparing every pair of rows.

A row with gaps (receiver) is compared with rows that have the missing value
(donors), in the columns both have. Donors stand in a k-d partition that Spark
builds level by level: each level cuts every part that is still too large at
quantiles of the column in which it is widest, rows without that column going to
a part of their own. The rules are a small table, whatever the rows.

1. a receiver looks into the part it belongs to; its k-th neighbour there bounds
   how far its ball reaches;
2. it visits only the other parts that the ball touches; large parts are cut
   into blocks, and each block returns k candidates per receiver and gap;
3. the best k of all are averaged.

Inside a part donors stand in line along the column in which they are widest. A
few receivers at a time, that are near in this column, are compared with the
donors that their balls can reach along it, not with the whole part.

Receivers that miss the same columns as many others get a partition over just
the columns they have, for a column they miss can't keep them out of a part. All
others share one over all columns, so any set of gaps, and any number of sets,
is searched exactly.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.values import any_of, quoted
from quillgrid.session import materialize

# Functions sent to the workers travel by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PART_ROWS = 4_000
_BLOCK_ROWS = 20_000  # donors compared in one call
_CALL_ROWS = 2_000  # receivers of one call: many short calls keep all tasks busy
_ABREAST = 64  # receivers compared at a time, and donors in line that give them a first bound
MOST_PARTS = 1 << 16  # of all partitions together; parts grow beyond that
FREQUENT = 8  # sets of columns with a partition of their own
RARE = 0.1  # a column filled in fewer rows has donors of its own
_WAYS = 64  # a part is cut into at most so many
_LEVELS = 24


class Space:
    """Donors with one of the columns ``targets``, partitioned by the columns ``axes``.

    ``only`` is the set of columns whose receivers look here; none: see ``rest``.
    ``rest`` takes all sets that have no partition of their own.
    """

    def __init__(self, axes: list[int], targets: list[int], low: np.ndarray, high: np.ndarray, only: str = "", rest: bool = False) -> None:
        self.axes, self.targets, self.only, self.rest = axes, targets, only, rest
        # a node's box; not a number where its rows don't have the column
        self.low, self.high = [low.copy()], [high.copy()]
        self.axis, self.cuts, self.child = [-1], [np.zeros(0)], [-1]
        self.open = {0: self._widest(0)}
        self.packed: tuple[np.ndarray, ...] | None = None

    def _arrays(self) -> tuple[np.ndarray, ...]:
        """Low and high ends, first child, children and axis of all nodes, made once for many batches."""
        if self.packed is None:
            many = np.array([len(c) + 2 for c in self.cuts])
            self.packed = np.array(self.low), np.array(self.high), np.array(self.child), many, np.array(self.axis)
        return self.packed

    def _widest(self, node: int) -> int:
        low, high = self.low[node][self.axes], self.high[node][self.axes]
        wide = np.where(high > np.nextafter(low, np.inf), high - low, 0.0)  # not a number compares as false
        return self.axes[int(wide.argmax())] if len(wide) and wide.max() > 0 else -1

    def split(self, node: int, count: int, marks: list[float], part_rows: int) -> None:
        """Cut a node at some of the marks; what can't be cut is a part, whatever its size."""
        axis, self.packed = self.open.pop(node), None
        ways = min(_WAYS, -(-count // part_rows))
        if axis < 0 or count <= 2 * part_rows:  # not again for a few rows more than planned
            return
        if not marks:  # none of its rows has the column
            self.low[node][axis] = self.high[node][axis] = np.nan
            self.open[node] = self._widest(node)
            return
        some = [marks[min(len(marks) - 1, round(i * len(marks) / ways))] for i in range(1, ways)]
        again = [float(np.nextafter(a, np.inf)) for a, b in zip(marks, marks[1:]) if a == b]  # a frequent value gets a part of its own
        low, high = self.low[node][axis], self.high[node][axis]
        cuts = np.array(sorted({c for c in [*some, *[a for a, b in zip(marks, marks[1:]) if a == b], *again] if low < c <= high}))
        if not len(cuts):
            return
        self.axis[node], self.cuts[node], self.child[node] = axis, cuts, len(self.axis)
        edges = [low, *cuts.tolist(), high]
        for a, b in [*zip(edges, edges[1:]), (np.nan, np.nan)]:  # the last child has no value
            below, above = self.low[node].copy(), self.high[node].copy()
            below[axis], above[axis] = a, b
            self.low.append(below), self.high.append(above)
            self.axis.append(-1), self.cuts.append(np.zeros(0)), self.child.append(-1)
            self.open[len(self.axis) - 1] = self._widest(len(self.axis) - 1)

    def place(self, points: np.ndarray, looking: bool = False) -> np.ndarray:
        """The node that each point belongs to. A receiver without the column (``looking``) takes the middle part."""
        at = np.zeros(len(points), np.int64)
        _, _, child, _, axis = self._arrays()
        inner = np.flatnonzero(axis[at] >= 0)
        while len(inner):
            for node, own in _by_space(at[inner]):
                rows = inner[own]
                x, cuts = points[rows, axis[node]], self.cuts[node]
                step = np.searchsorted(cuts, x, side="right")
                step[np.isnan(x)] = (len(cuts) + 1) // 2 if looking else len(cuts) + 1
                at[rows] = child[node] + step
            inner = inner[axis[at[inner]] >= 0]
        return at

    def touched(self, points: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, part) for all parts that a point's ball reaches."""
        low, high, child, many, _ = self._arrays()
        bound = bound * (1 + 1e-9)  # rounding in the two ways to a distance
        have = np.maximum((~np.isnan(points)).sum(axis=1), 1)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        who, at = np.arange(len(points)), np.zeros(len(points), np.int64)
        while len(who):
            near = np.zeros(len(who), bool)
            for a in range(0, len(who), 200_000):
                part = slice(a, a + 200_000)
                here = points[who[part]]
                away = np.maximum(np.maximum(low[at[part]] - here, here - high[at[part]]), 0.0)
                squared = np.nansum(away**2, axis=1) * (points.shape[1] / have[who[part]])
                near[part] = squared <= bound[who[part]]
            who, at = who[near], at[near]
            leaf = child[at] < 0
            found.append((who[leaf], at[leaf]))
            who, at = who[~leaf], at[~leaf]
            step = np.concatenate([np.arange(n) for n in many[at].tolist()]) if len(at) else np.zeros(0, np.int64)
            who, at = np.repeat(who, many[at]), np.repeat(child[at], many[at]) + step
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def fill_from_neighbours(df: DataFrame, cols: list[str], gaps: list[str], k: int, rid: str) -> DataFrame:
    """``df`` with the gaps of ``gaps`` filled; ``cols`` are doubles, ``rid`` is unique."""
    p = len(cols)
    number = lambda c: F.coalesce(F.col(f"`{c}`") + F.lit(0.0), F.lit(float("nan")))
    whole = df.withColumn("_point", F.array(*[number(c) for c in cols]))
    rows = whole.select(F.col(f"`{rid}`").alias("_id"), "_point")
    targets = [cols.index(c) for c in gaps]
    missing = lambda j: F.isnan(F.get("_point", F.lit(j)))
    stats = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(~missing(j)).alias(f"n{j}") for j in range(p)],
        *[f(F.nanvl(F.get("_point", F.lit(j)), F.lit(None))).alias(f"{n}{j}") for j in range(p) for n, f in (("a", F.min), ("b", F.max), ("m", F.avg))],
    ).first()
    means = {j: stats[f"m{j}"] for j in targets}
    spaces = _spaces(rows, stats, targets, p)
    if spaces:
        donors, receivers = _donors(rows, spaces, stats["rows"], k), _receivers(rows, spaces, targets)
        neighbours = _search(donors, receivers, spaces, targets, p, k)
        best = Window.partitionBy("_j", "_point").orderBy("_d", "_donor")
        fills = (
            neighbours.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
            .groupBy("_j", "_point").agg(F.avg("_value").alias("_fill"))
            .groupBy("_point").agg(F.map_from_entries(F.collect_list(F.struct("_j", "_fill"))).alias("_fills"))
        )
        fills = materialize(fills, "neighbour-means")
        gap = any_of([missing(j) for j in targets])
        found = whole.where(gap).join(fills, "_point", "left")
        fill = lambda j: F.try_element_at("_fills", F.lit(j))
    else:
        gap, found, fill = F.lit(False), None, None
    mean = lambda j: F.lit(means[j]).cast("double")
    known = lambda j: F.nanvl(F.get("_point", F.lit(j)), F.lit(None))
    names = quoted(df.columns)
    if found is None:
        return whole.withColumns({c: F.coalesce(known(j), mean(j)) for c, j in zip(gaps, targets)}).select(*names)
    filled = found.withColumns({c: F.coalesce(known(j), fill(j), mean(j)) for c, j in zip(gaps, targets)})
    return whole.where(~gap).select(*names).unionByName(filled.select(*names))


def _spaces(rows: DataFrame, stats, targets: list[int], p: int) -> list[Space]:
    """One partition over all columns for columns filled often, one for each rare one,
    and one for each frequent set of columns that receivers have."""
    filled = [j for j in targets if 0 < stats[f"n{j}"]]
    often = [j for j in filled if stats[f"n{j}"] >= RARE * stats["rows"]]
    low = np.array([np.nan if stats[f"a{j}"] is None else stats[f"a{j}"] for j in range(p)])
    high = np.array([np.nan if stats[f"b{j}"] is None else stats[f"b{j}"] for j in range(p)])
    if p < 2 or not filled:
        return []
    has = F.concat(*[F.when(F.isnan(F.get("_point", F.lit(j))), "0").otherwise("1") for j in range(p)])
    sets = (
        rows.where(any_of([F.isnan(F.get("_point", F.lit(j))) for j in targets])).groupBy(has.alias("has")).count()
        .orderBy(F.col("count").desc(), "has").limit(FREQUENT + 1).collect()
    )
    out = [Space(list(range(p)), [j], low, high) for j in filled if j not in often]
    if often and len(sets) > FREQUENT:
        out.append(Space(list(range(p)), often, low, high, rest=True))
    for r in sets[:FREQUENT]:
        axes = [j for j in range(p) if r["has"][j] == "1"]
        own = [j for j in often if r["has"][j] == "0"]
        if axes and own:
            out.append(Space(axes, own, low, high, only=r["has"]))
    return out


def _has(point: Column, j: int) -> Column:
    return ~F.isnan(F.get(point, F.lit(j)))


def _points(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of coordinate lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _by_space(spaces: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(spaces, kind="stable")
    numbers, starts = np.unique(spaces[order], return_index=True)
    return list(zip(numbers.tolist(), np.split(order, starts[1:])))


def _donors(rows: DataFrame, spaces: list[Space], n: int, k: int) -> DataFrame:
    """``_space, _part, _donor, _point``, with the spaces cut until every part is small."""
    owns = F.array_compact(
        F.array(
            *[
                F.when(any_of([_has(F.col("_point"), j) for j in s.targets]) & any_of([_has(F.col("_point"), j) for j in s.axes]), F.lit(i))
                for i, s in enumerate(spaces)
            ]
        )
    )
    each = rows.select(F.explode(owns).alias("_space"), F.col("_id").alias("_donor"), "_point")
    part_rows = max(_PART_ROWS, n * len(spaces) // MOST_PARTS)
    marks = [i / _WAYS for i in range(1, _WAYS)]
    if n <= 2 * part_rows:  # one part each
        for s in spaces:
            s.open = {}
    for _ in range(_LEVELS):
        waiting = {(i, node) for i, s in enumerate(spaces) for node in s.open}
        if not waiting:
            break

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = _points(batch.column(1))
                node, x = np.zeros(len(points), np.int64), np.full(len(points), np.nan)
                for number, own in _by_space(batch.column(0).to_numpy()):
                    space = spaces[number]
                    node[own] = space.place(points[own])
                    axis = np.array([space.open.get(a, -2) for a in range(len(space.axis))])[node[own]]
                    x[own] = np.where(axis >= 0, points[own, axis], np.nan)
                    node[own[axis == -2]] = -1
                keep = np.flatnonzero(node >= 0)
                value = pa.array(x[keep], from_pandas=True)  # not a number: null
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(node[keep]), value], names=["_space", "_node", "_x"])

        sizes = each.select("_space", "_point").mapInArrow(measure, "_space int, _node long, _x double").groupBy("_space", "_node")
        found = sizes.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_x", marks, 1000).alias("marks")).collect()  # MOST_PARTS at most
        for r in found:
            spaces[r["_space"]].split(r["_node"], r["n"], r["marks"] or [], part_rows)
            waiting.discard((r["_space"], r["_node"]))
        for i, node in waiting:  # no rows there
            spaces[i].open.pop(node, None)
    for s in spaces:
        s.open = {}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _points(batch.column(2))
                part = np.zeros(len(points), np.int64)
                for number, own in _by_space(batch.column(0).to_numpy()):
                    part[own] = spaces[number].place(points[own])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part), *batch.columns[1:]], names=["_space", "_part", "_donor", "_point"])

    placed = materialize(each.mapInArrow(place, "_space int, _part long, _donor long, _point array<double>"), "donors")
    return _without_copies(placed, spaces, k, max(_BLOCK_ROWS, 4 * part_rows))


def _without_copies(placed: DataFrame, spaces: list[Space], k: int, most: int) -> DataFrame:
    """Parts that couldn't be cut hold equal points: of each, rows with the k smallest ids for some
    column are enough. Blocks of such parts are thinned until they are small."""
    targets = [s.targets for s in spaces]
    names = ["_space", "_part", "_donor", "_point"]

    def thin(table: pa.Table) -> pa.Table:
        table = table.select(names).sort_by("_donor")
        points = _points(table["_point"])
        _, same = np.unique(points, axis=0, return_inverse=True)
        keep = np.zeros(len(points), bool)
        for j in targets[table["_space"][0].as_py()]:
            own = np.flatnonzero(~np.isnan(points[:, j]))
            order = own[np.argsort(same.ravel()[own], kind="stable")]
            groups = same.ravel()[order]
            place = np.arange(len(order)) - np.searchsorted(groups, groups)
            keep[order[place < k]] = True
        return table.filter(pa.array(keep))

    before = None
    while True:
        sizes = placed.groupBy("_space", "_part").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
        large = materialize(sizes.select("_space", "_part", F.ceil(F.col("_n") / _BLOCK_ROWS).cast("int").alias("_b")), "large-parts")
        left = large.agg(F.count(F.lit(1)).alias("n"), F.sum("_b").alias("b")).first()
        if not left["n"] or (left["n"], left["b"]) == before:  # none, or no copies are left
            break
        before = (left["n"], left["b"])
        big = placed.join(large, ["_space", "_part"]).withColumn("_block", F.pmod(F.xxhash64("_donor"), F.col("_b")))
        thinned = big.groupBy("_space", "_part", "_block").applyInArrow(thin, "_space int, _part long, _donor long, _point array<double>")
        small = placed.join(large.drop("_b"), ["_space", "_part"], "left_anti")
        placed = materialize(small.select(*names).unionByName(thinned), "donors")
    return placed


def _receivers(rows: DataFrame, spaces: list[Space], targets: list[int]) -> DataFrame:
    """``_space, _point``: distinct points with a gap, in each space that may fill it."""
    has = lambda j: _has(F.col("_point"), j)
    some = any_of([has(j) for j in sorted({a for s in spaces for a in s.axes})])
    own = [_matches(s.only) for s in spaces if s.only]
    looks = []
    for i, s in enumerate(spaces):
        fits = any_of([~has(j) for j in s.targets])
        if s.only:
            fits = fits & _matches(s.only)
        elif s.rest and own:
            fits = fits & ~any_of(own)
        looks.append(F.when(fits, F.lit(i)))
    points = rows.where(some & any_of([~has(j) for j in targets])).select("_point").distinct()
    return points.select(F.explode(F.array_compact(F.array(*looks))).alias("_space"), "_point")


def _matches(only: str) -> Column:
    out = F.lit(True)
    for j, c in enumerate(only):
        out = out & (_has(F.col("_point"), j) if c == "1" else ~_has(F.col("_point"), j))
    return out


def _search(donors: DataFrame, receivers: DataFrame, spaces: list[Space], targets: list[int], p: int, k: int) -> DataFrame:
    """Candidates ``_j, _point, _donor, _value, _d``: k per visited block."""
    looking = "_space int, _point array<double>, _part long, _bound double"

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _points(batch.column(1))
                part = np.zeros(len(points), np.int64)
                for number, own in _by_space(batch.column(0).to_numpy()):
                    part[own] = spaces[number].place(points[own], looking=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), pa.nulls(len(points), pa.float64())], names=["_space", "_point", "_part", "_bound"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                some = batch.slice(a, 2000)
                points, homes = _points(some.column(1)), some.column(2).to_numpy()
                bound = some.column(3).fill_null(float("inf")).to_numpy(zero_copy_only=False)
                which, parts = [], []
                for number, own in _by_space(some.column(0).to_numpy()):
                    who, part = spaces[number].touched(points[own], bound[own])
                    other = part != homes[own[who]]
                    which.append(own[who[other]]), parts.append(part[other])
                taken = some.take(pa.array(np.concatenate(which)))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(np.concatenate(parts)), taken.column(3)], names=some.schema.names)

    at_home = materialize(receivers.mapInArrow(home, looking), "homes")
    first = materialize(_scores(donors, at_home, spaces, targets, p, k), "home-candidates")
    bounds = first.where("_j < 0").groupBy("_space", "_point").agg(F.min("_d").alias("_bound"))
    bounded = at_home.drop("_bound").join(bounds, ["_space", "_point"], "left").select("_space", "_point", "_part", "_bound")
    visits = materialize(bounded.mapInArrow(visit, looking), "visits")
    rest = _scores(donors, visits, spaces, targets, p, k)
    return first.unionByName(rest).where("_j >= 0").drop("_space")


def _scores(donors: DataFrame, visits: DataFrame, spaces: list[Space], targets: list[int], p: int, k: int) -> DataFrame:
    """Candidates of every visit, and for ``_j`` = -1 how far the k-th neighbour is at most (infinite: too few donors)."""
    # Cut every part into blocks of bounded size on both sides.
    cuts = donors.groupBy("_space", "_part").agg(F.ceil(F.count("*") / _BLOCK_ROWS).cast("int").alias("_blocks"))
    calls = visits.groupBy("_space", "_part").agg(F.ceil(F.count("*") / _CALL_ROWS).cast("int").alias("_calls"))
    plan = materialize(cuts.join(calls, ["_space", "_part"]), "blocks")
    block_of = F.pmod(F.xxhash64("_donor"), F.col("_blocks")).cast("int")
    call_of = F.pmod(F.xxhash64("_point"), F.col("_calls")).cast("int")
    left = donors.join(plan, ["_space", "_part"]).select(
        "_space", "_part", block_of.alias("_block"), F.explode(F.sequence(F.lit(0), F.col("_calls") - 1)).alias("_call"), "_point", "_donor"
    )
    right = visits.join(plan, ["_space", "_part"]).select(
        "_space", "_part", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), call_of.alias("_call"), "_point", "_bound"
    )
    owned = [set(s.targets) & set(targets) for s in spaces]
    names = ["_space", "_j", "_point", "_donor", "_value", "_d"]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.float64(), pa.float64()]

    def score(key: tuple, block: pa.Table, callers: pa.Table) -> pa.Table:
        parts = []
        if block.num_rows and callers.num_rows:
            block = block.sort_by("_donor")
            points, asked = _points(block["_point"]), _points(callers["_point"])
            ids = block["_donor"].to_numpy()
            have, number = ~np.isnan(points), key[0].as_py()
            bound = callers["_bound"].combine_chunks().fill_null(float("inf")).to_numpy(zero_copy_only=False)
            bound = bound * (1 + 1e-9)  # rounding; what lies beyond can't be among the nearest
            bounded = bool(np.isfinite(bound).any())
            all_points, all_have, all_ids = points, have, ids
            for rows, reached in _abreast(asked, points, bound if bounded else None, sorted(owned[number]), k):
                some = asked[rows]
                points, have, ids = (all_points, all_have, all_ids) if reached is None else (all_points[reached], all_have[reached], all_ids[reached])
                if not len(points):
                    continue
                squared = _squared(some, points, have)
                radius = np.zeros(len(some))
                for j in sorted(owned[number]):
                    lack, own = np.flatnonzero(np.isnan(some[:, j])), np.flatnonzero(have[:, j])
                    if not len(lack):
                        continue
                    most = min(k, len(own))
                    if most < k:
                        radius[lack] = np.inf
                    if not most:
                        continue
                    whole = len(lack) == len(some) and len(own) == len(points)
                    near = squared if whole else squared[np.ix_(lack, own)]
                    if bounded:
                        row, column = np.nonzero(near <= bound[rows][lack][:, None])
                        crowded = np.flatnonzero(np.bincount(row, minlength=len(lack)) > most)
                        single = ~np.isin(row, crowded)
                        row, column = row[single], column[single]
                    else:
                        crowded, row, column = np.arange(len(lack)), np.zeros(0, np.int64), np.zeros(0, np.int64)
                    if len(crowded):
                        nearest = _smallest(near if len(crowded) == len(lack) else near[crowded], most)
                        row = np.concatenate([row, np.repeat(crowded, most)])
                        column = np.concatenate([column, nearest.ravel()])
                    distance = near[row, column]
                    if not bounded:
                        radius[lack] = np.maximum(radius[lack], distance.reshape(len(lack), most)[:, -1])
                    fine = np.isfinite(distance)
                    donor = own[column[fine]]
                    parts.append((j, rows[lack[row[fine]]], ids[donor], points[donor, j], distance[fine]))
                if bounded:
                    continue
                parts.append((-1, rows, np.zeros(len(some), np.int64), np.zeros(len(some)), radius))
        if not parts:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        which = np.concatenate([x[1] for x in parts])
        columns = [
            pa.array(np.full(len(which), key[0].as_py()), pa.int32()),
            pa.array(np.concatenate([np.full(len(x[1]), x[0]) for x in parts]), pa.int32()),
            callers["_point"].take(pa.array(which)),
            *[pa.array(np.concatenate([x[i] for x in parts]), t) for i, t in ((2, pa.int64()), (3, pa.float64()), (4, pa.float64()))],
        ]
        return pa.table(columns, names=names)

    keys = ["_space", "_part", "_block", "_call"]
    schema = "_space int, _j int, _point array<double>, _donor long, _value double, _d double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)


def _squared(some: np.ndarray, points: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs over the columns that both have, scaled up for the others.

    ``points`` and ``have`` may also hold donors of their own for each row of ``some``.
    """
    p = some.shape[1]
    squared = np.zeros((len(some), points.shape[-2]))
    for axis in np.flatnonzero(have.reshape(-1, p).any(axis=0) & ~np.isnan(some).all(axis=0)).tolist():
        away = some[:, axis, None] - points[..., axis]
        away *= away
        if not (have[..., axis].all() and not np.isnan(some[:, axis]).any()):
            away[np.isnan(away)] = 0.0
        squared += away
    known = (~np.isnan(some)).astype(float)
    shared = known @ have.T if have.ndim == 2 else np.einsum("rp,rnp->rn", known, have)
    squared *= p / np.maximum(shared, 1)
    squared[shared == 0] = np.inf
    return squared


def _abreast(
    asked: np.ndarray, points: np.ndarray, bound: np.ndarray | None, targets: list[int], k: int
) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Rows of ``asked``, some at a time, with the donors (by ascending number) that their balls may reach; none: all.

    Without bounds, donors next in line give them: the k-th of these for every gap.
    """
    everywhere = ~np.isnan(points).any(axis=0) & ~np.isnan(asked).any(axis=0)
    axes = np.flatnonzero(everywhere)
    if not len(axes) or len(points) <= 4 * _ABREAST:
        step = max(1, 4_000_000 // len(points))
        for start in range(0, len(asked), step):
            yield np.arange(start, min(start + step, len(asked))), None
        return
    wide = np.subtract(*np.quantile(points[:, axes], [0.9, 0.1], axis=0))  # far outliers make no column wide
    axis = axes[int(wide.argmax())]
    line = np.argsort(points[:, axis], kind="stable")
    x, p = points[line, axis], points.shape[1]
    order = np.argsort(asked[:, axis], kind="stable")
    for start in range(0, len(order), _ABREAST):
        rows = order[start : start + _ABREAST]
        some, z = asked[rows], asked[rows, axis]
        if bound is None:
            first = np.clip(np.searchsorted(x, z) - _ABREAST // 2, 0, len(x) - _ABREAST)
            near = points[line[first[:, None] + np.arange(_ABREAST)]]
            away, far = _squared(some, near, ~np.isnan(near)), np.zeros(len(rows))
            for j in targets:
                own = np.where(np.isnan(near[..., j]), np.inf, away)
                kth = np.partition(own, k - 1, axis=1)[:, k - 1] if k <= _ABREAST else np.full(len(rows), np.inf)
                far = np.maximum(far, np.where(np.isnan(some[:, j]), kth, 0.0))
        else:
            far = bound[rows]
        reach = np.sqrt(far * ((~np.isnan(some)).sum(axis=1) / p)) * (1 + 1e-9)  # of the columns that both have, the line is one
        low, high = np.searchsorted(x, (z - reach).min(), side="left"), np.searchsorted(x, (z + reach).max(), side="right")
        yield rows, np.sort(line[low:high])


def _smallest(squared: np.ndarray, most: int) -> np.ndarray:
    """Column numbers of the smallest entries per row, lower number first on ties."""
    limit = np.partition(squared, most - 1, axis=1)[:, most - 1 : most]
    row, column = np.nonzero(squared <= limit)
    order = np.lexsort((column, squared[row, column], row))
    starts = np.searchsorted(row, np.arange(len(squared)))
    return column[order][starts[:, None] + np.arange(most)]
