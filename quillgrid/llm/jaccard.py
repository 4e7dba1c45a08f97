"""Exact Jaccard joins of word N-gram sets with set-relation skipping.

Index level: every set is indexed under its rarest N-grams (a prefix that two
similar sets must share), with the position in the set's order. Within a list,
entries whose positions add up to more than two similar sets can differ by are
skipped. Answer level: sets that resemble a leading set are kept as their
difference from it. What is known of the leader gives the followers' answers:
their distances follow from the differences alone, and most need no comparison.

The result is not a list of pairs but what they connect, so copies and large
groups of near copies are never expanded into all pairs.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.batches import bounded, lending, pieces, short
from quillgrid.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTERS = 1 << 22  # of the frequency sketch, which orders N-grams; 8 MB are broadcast
_PART = 1 << 16
FILTER_BITS = 1 << 25  # of the bitmap of shared N-grams; 4 MB are broadcast
TEXT_BITS = 1 << 22  # of the bitmap of wanted texts
SHARED = 3  # N-grams that two prefixes must share at least (fewer for tiny sets)
GROUP_SHINGLES = 400_000  # compared in one call
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x5851F42D4C957F2B  # odd, 3 modulo 8: powers stay far apart in the low bits
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of hashed word N-grams, sorted; a text of fewer words is one N-gram, an empty one has none.

    Hashes have 64 bits. Two different N-grams of the two texts that are
    compared share one with a chance of about 1e-14 per pair of texts.
    """

    def __init__(self, words: int):
        self.words = words
        self.bytes = _mix(np.arange(1, 257, dtype=np.uint64) * _A)
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            base = np.full(n, _BASE, np.uint64)
            back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            base[0] = back[0] = 1
            self.powers, self.inverse = np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        out, held, size = [], [], 0
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
            held.append(raw)
            size += len(raw)
            if size >= 512 << 10:
                out += self._sets(held)
                held, size = [], 0
        return out + self._sets(held) if held else out

    def words_of(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of every word of the texts joined by line breaks, and where each text starts."""
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        self._grow(len(data))
        change = np.diff(_IS_WORD[data].view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.bytes[data] * self.powers[: len(data)], dtype=np.uint64)])
        words = _mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        return starts, ends, words, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])

    def _sets(self, raw: list[bytes]) -> list[np.ndarray]:
        starts, _, words, begin = self.words_of(raw)
        k = self.words
        grams = words[: max(0, len(words) - k + 1)]
        for j in range(1, k):
            grams = _mix(grams * _A + words[j : len(words) - k + 1 + j])
        at = np.searchsorted(starts, begin)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            elif b > a:
                one = words[a : a + 1]
                for j in range(a + 1, b):
                    one = _mix(one * _A + words[j : j + 1])
                out.append(_mix(one + np.uint64(b - a)))
            else:
                out.append(grams[:0])
        return out


def set_id(tokens: np.ndarray) -> int:
    """64-bit hash of a set that isn't empty, as a signed integer."""
    total = int(_mix(tokens + _B).sum(dtype=np.uint64)) + len(tokens) * int(_A)
    return int(_mix(np.array([total & 0xFFFFFFFFFFFFFFFF], np.uint64))[0].astype(np.int64))


def _order(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Tokens from the rarest on; equally rare ones by hash. The order is the same for all sets."""
    rare = levels[(tokens >> np.uint64(42)).astype(np.int64)].astype(np.uint64)
    return tokens[np.argsort((rare << np.uint64(48)) | (tokens >> np.uint64(16)), kind="stable")]


class Threshold:
    """Similarity of at least ``p / q``.

    With d elements in one set but not the other, sets of n and m elements are
    similar when ``(p + q) * d <= (q - p) * (n + m)``.
    """

    def __init__(self, p: int, q: int):
        if not 0 < p <= q:
            raise ValueError("the similarity must be above 0 and 1 at most")
        self.p, self.q = p, q

    def least(self, n: int) -> int:
        """Elements that a set of ``n`` shares with any similar set at least."""
        return -(-self.p * n // self.q)

    def prefix(self, n: int) -> int:
        """Rarest elements to index, so that similar sets share ``SHARED`` of them, or all they have to share."""
        return n - self.least(n) + min(SHARED, self.least(n))

    def similar(self, d: Column, n: Column, m: Column) -> Column:
        return (self.p + self.q) * d <= (self.q - self.p) * (n + m)

    def sizes(self, n: Column, m: Column) -> Column:
        return (self.q * F.least(n, m)) >= (self.p * F.greatest(n, m))

    def differ(self, total: Column) -> Column:
        """Elements by which similar sets differ at most; ``total`` is the sum of their sizes."""
        return F.floor((self.q - self.p) * total / (self.p + self.q)).cast("bigint")

    def reach(self, n: Column) -> Column:
        """``differ`` for a set of ``n`` and its largest partner."""
        return self.differ(n + F.floor(n * self.q / self.p))

    def needed(self, n: Column) -> Column:
        return F.least(F.lit(SHARED), F.ceil(n * self.p / self.q))


def frequency_levels(texts: DataFrame, words: int) -> np.ndarray:
    """How often the N-grams that share a counter occur, over all texts; 16 bits each.

    Only their order matters, and only for speed: any order gives right results.
    """

    def count(batches):
        shingler, total, pack = Shingler(words), np.zeros(COUNTERS, np.uint32), zstandard.ZstdCompressor(level=1)
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for batch in pieces(batches, 0):
            tokens = shingler.sets(batch.column(0).to_pylist())
            if tokens:
                places, n = np.unique((np.concatenate(tokens) >> np.uint64(42)).astype(np.int64), return_counts=True)
                total[places] += n.astype(np.uint32)  # no second table of all counters
        if total.any():
            for part in range(COUNTERS // _PART):
                planes = total[part * _PART : (part + 1) * _PART].view(np.uint8).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([task % 64], pa.int32()), pa.array([pack.compress(planes.tobytes())], pa.binary())],
                    names=["part", "lane", "packed"],
                )

    def add(table: pa.Table) -> pa.Table:
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        total = np.zeros(_PART, np.uint64)
        for raw in table.column("packed"):
            planes = np.frombuffer(unpack.decompress(raw.as_py()), np.uint8).reshape(4, -1)
            total += np.ascontiguousarray(planes.T).view(np.uint32).ravel()
        planes = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).view(np.uint8).reshape(-1, 4).T
        return pa.table({"part": table.column("part")[:1], "lane": pa.array([0], pa.int32()), "packed": [pack.compress(planes.tobytes())]})

    schema = "part int, lane int, packed binary"
    lanes = bounded(texts).mapInArrow(count, schema).groupBy("part", "lane").applyInArrow(add, schema)
    levels, unpack = np.zeros(COUNTERS, np.uint16), zstandard.ZstdDecompressor()
    for row in lanes.groupBy("part").applyInArrow(add, schema).collect():  # 64 rows
        planes = np.frombuffer(unpack.decompress(row["packed"]), np.uint8).reshape(4, -1)
        n = np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.float64)
        large = 32768 + 1024 * np.log2(np.maximum(n, 32768) / 32768)
        levels[row["part"] * _PART : (row["part"] + 1) * _PART] = np.where(n < 32768, n, large).astype(np.uint16)
    return levels


def index_prefixes(df: DataFrame, shared: Broadcast, key: str, text: str, words: int, at: Threshold) -> DataFrame:
    """One row per document: ``key, text_key, sid, n, rank, tokens`` (the indexed prefix, rarest first).

    ``rank`` orders sets as leaders: those whose rarest N-gram is most frequent
    first, since the middle of a group of near copies has no N-gram of its own.
    ``shared`` holds the frequency levels.
    """

    def run(batches):
        shingler, levels = Shingler(words), shared.value
        for batch in pieces(batches, 2):
            sids, sizes, ranks, prefixes = [], [], [], []
            for tokens in shingler.sets(batch.column(2).to_pylist()):
                n = len(tokens)
                sizes.append(n)
                if not n:
                    sids.append(None), ranks.append(None), prefixes.append(tokens.view(np.int64))
                    continue
                ordered, sid = _order(tokens, levels), set_id(tokens)
                sids.append(sid)
                ranks.append((int(levels[int(ordered[0]) >> 42]) << 46) | (sid & ((1 << 46) - 1)))
                prefixes.append(ordered[: at.prefix(n)].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ranks, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["key", "text_key", "sid", "n", "rank", "tokens"],
            )

    rows = df.select(
        F.col(f"`{key}`").cast("bigint").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"), F.col(f"`{text}`").alias("text")
    )
    return bounded(rows).mapInArrow(run, "key long, text_key long, sid long, n long, rank long, tokens array<long>")


def _bitmap(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for the low bits of each value; at most ``bits / 64`` rows reach the driver."""
    low = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = (
        values.select(F.shiftright(low, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), low.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.uint64)
    if words.num_rows:
        out[words.column("word").to_numpy()] = words.column("bit").to_numpy().view(np.uint64)
    return out


def _held(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values.view(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def _shared_postings(index: DataFrame, at: Threshold) -> DataFrame:
    """``tok, sid, n, pos, rank`` with ``lead``, of N-grams in the prefixes of two sets or more.

    Position skipping: the first shared N-grams of similar sets stand at
    positions whose sum is at most what the sets may differ by, and two more
    for each one before. An entry that is too far down to meet even its list's
    first entry is left out.
    """
    spread = index.filter("n > 0").select(F.col("sid").alias("s"), F.explode("tokens").alias("tok"))
    repeated = spread.groupBy("tok").agg(F.min("s").alias("a"), F.max("s").alias("b")).filter("a <> b")
    held = _bitmap(repeated, "tok", FILTER_BITS)

    def kept(batches):
        bits = bitmap.value
        for batch in short(batches):
            lists = batch.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            held = _held(bits, flat) if len(flat) else np.zeros(0, bool)
            row = pa.array(row[held])
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[held]), batch.column(0).take(row), batch.column(1).take(row), pa.array(pos[held], pa.int64()), batch.column(2).take(row)],
                names=["tok", "sid", "n", "pos", "rank"],
            )

    rows = index.filter("n > 0").select("sid", "n", "rank", "tokens")
    with lending(index.sparkSession) as lend:
        bitmap = lend(held)
        postings = bounded(rows).mapInArrow(kept, "tok long, sid long, n long, pos long, rank long").dropDuplicates(["tok", "sid"])
        postings = materialize(postings, "postings")
    lists = postings.groupBy("tok").agg(
        F.min("sid").alias("low"), F.max("sid").alias("high"), F.min("pos").alias("first"),
        F.max_by("sid", "rank").alias("lead"), F.max_by("n", "rank").alias("lead_n"),
    ).filter("low <> high").drop("low", "high")
    near = F.col("pos") + F.col("first") <= at.reach(F.col("n")) + 2 * (SHARED - 1)
    return materialize(postings.join(lists, "tok").filter(near).drop("first"), "shared-postings")


def _leaders(shared: DataFrame, at: Threshold) -> DataFrame:
    """``sid, n, lead``: the leader with whom a set shares most of its prefix, followed to the end of the line."""
    own = shared.filter("sid <> lead").filter(at.sizes(F.col("n"), F.col("lead_n")))
    counted = own.groupBy("sid", "n", "lead").agg(F.count(F.lit(1)).alias("c"))
    enough = F.greatest(at.needed(F.col("n")), F.floor((F.col("n") - F.ceil(F.col("n") * at.p / at.q) + 1) / 4))
    star = counted.filter(F.col("c") >= enough).groupBy("sid", "n").agg(F.max_by("lead", F.struct("c", "lead")).alias("lead"))
    star = materialize(star, "leaders")
    for _ in range(2):
        above = star.select(F.col("sid").alias("l_sid"), F.col("lead").alias("l_lead"))
        star = materialize(
            star.join(above, F.col("lead") == F.col("l_sid"), "left").select("sid", "n", F.coalesce("l_lead", "lead").alias("lead")), "leaders"
        )
    ends = star.select(F.col("sid").alias("l_sid"))
    return star.join(ends, F.col("lead") == F.col("l_sid"), "left_anti")


def _texts(df: DataFrame, bitmap: Broadcast, text: str) -> DataFrame:
    """``text_key, text`` of (at least) the keys in a bitmap; a task passes a text on once."""

    def run(batches):
        bits, seen = bitmap.value, set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            mask = _held(bits, keys)
            for i in np.flatnonzero(mask):
                k = int(keys[i])
                mask[i] = k not in seen
                seen.add(k)
            yield batch.filter(pa.array(mask))

    rows = df.select(F.xxhash64(F.col(f"`{text}`")).alias("text_key"), F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull())
    return bounded(rows).mapInArrow(run, "text_key long, text string")


def _compare(df: DataFrame, pairs: DataFrame, index: DataFrame, levels: np.ndarray, text: str, words: int) -> DataFrame:
    """Exact distances of ``pairs(sid, other, keep)``: ``sid, other, n, m, d, delta``.

    ``delta``, the elements in one set but not the other, rarest first, is given
    where ``d`` is at most ``keep``. The pairs of one ``other`` are compared in
    calls of bounded size, each of which reads the other set once. The pairs are
    stored, since they are needed three times and take a long plan to find.
    """
    keys = index.filter("n > 0").groupBy("sid").agg(F.min("text_key").alias("text_key"), F.min("n").alias("n"))
    left = materialize(pairs.join(keys, "sid"), "pairs")
    parts = left.groupBy("other").agg(F.ceil(F.sum("n") / GROUP_SHINGLES).cast("int").alias("parts"))
    left = left.join(parts, "other").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    heads = parts.join(keys, parts["other"] == keys["sid"]).select(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("other").alias("sid"), F.lit(-1).cast("bigint").alias("keep"), "text_key"
    )
    plan = materialize(left.select("other", "part", "sid", F.col("keep").cast("bigint"), "text_key").unionByName(heads), "comparisons")
    schema = "sid long, other long, n long, m long, d long, delta array<long>"

    def run(table: pa.Table) -> pa.Table:
        shingler, levels = Shingler(words), shared.value
        other = table.column("other")[0].as_py()
        sids, keep = table.column("sid").to_pylist(), table.column("keep").to_pylist()
        held, limits = {}, {}
        for sid, limit, tokens in zip(sids, keep, shingler.sets(table.column("text").to_pylist()), strict=True):
            if len(tokens) and set_id(tokens) == sid:  # text keys may meet by chance
                held[sid] = tokens
                limits[sid] = max(limit, limits.get(sid, -1))
        out = {c: [] for c in ("sid", "other", "n", "m", "d", "delta")}
        head = held.pop(other)
        for sid, tokens in held.items():
            delta = np.setxor1d(tokens, head, assume_unique=True)
            d = len(delta)
            values = (sid, other, len(tokens), len(head), d, _order(delta, levels).view(np.int64) if d <= limits[sid] else None)
            for c, v in zip(out, values, strict=True):
                out[c].append(v)
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    with lending(df.sparkSession) as lend:
        shared = lend(levels)
        rows = plan.join(_texts(df, lend(_bitmap(plan, "text_key", TEXT_BITS)), text), "text_key")
        return materialize(rows.groupBy("other", "part").applyInArrow(run, schema), "distances")


def _follower_links(followers: DataFrame, at: Threshold) -> DataFrame:
    """Links between followers of one leader, from their differences from it alone.

    x and y differ by ``|dx| + |dy| - 2 |dx & dy|``. If the first two add up to
    few enough, both are linked to the leader already. Else they must share
    elements of their differences, so only sets that aren't linked to their
    leader ask, and rare elements of the differences serve as index.
    """
    n, m, d = F.col("n"), F.col("m"), F.col("d")
    per = (at.q - at.p) / (at.p + at.q)
    asks = F.greatest(F.lit(1), d - at.reach(n))
    answers = F.greatest(F.lit(1), F.ceil((d + per * (m - n)) / 2 - 1e-9).cast("bigint"))
    first = lambda frame, c, shared: frame.withColumn("cut", F.greatest(F.size("delta") - shared + 1, F.lit(0)).cast("int")).select(
        F.col("other").alias("lead"), F.col("sid").alias(c), F.explode(F.slice("delta", F.lit(1), F.col("cut"))).alias("tok")
    )
    x = first(followers.filter(~at.similar(d, n, m)), "x", asks)
    y = first(followers, "y", answers)
    pairs = x.join(y, ["lead", "tok"]).filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    own = lambda c: followers.select(
        F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("d").alias(f"d_{c}"), F.col("delta").alias(f"delta_{c}")
    )
    known = pairs.join(own("x"), "x").join(own("y"), "y")
    distance = F.col("d_x") + F.col("d_y") - 2 * F.size(F.array_intersect("delta_x", "delta_y"))
    return known.filter(at.similar(distance, F.col("n_x"), F.col("n_y"))).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _crossing(shared: DataFrame, followers: DataFrame, at: Threshold) -> DataFrame:
    """``sid, other``: pairs of leaders (or single sets) that may have similar sets under them.

    A list keeps one entry for all sets of a leader, with the first position and
    the range of sizes; a list of one leader has nothing to meet.
    """
    lead = followers.select(F.col("sid").alias("f_sid"), F.col("other").alias("f_lead"))
    own = shared.join(lead, F.col("sid") == F.col("f_sid"), "left").withColumn("top", F.coalesce("f_lead", "sid"))
    entries = materialize(
        own.groupBy("tok", "top").agg(F.min("pos").alias("pos"), F.min("n").alias("low"), F.max("n").alias("high")), "entries"
    )
    a = entries.select("tok", *[F.col(c).alias(f"a_{c}") for c in ("top", "pos", "low", "high")])
    b = entries.select("tok", *[F.col(c).alias(f"b_{c}") for c in ("top", "pos", "low", "high")])
    differ = at.differ(F.col("a_high") + F.col("b_high"))
    fit = (F.col("a_high") * at.q >= F.col("b_low") * at.p) & (F.col("b_high") * at.q >= F.col("a_low") * at.p)
    place = F.col("a_pos") + F.col("b_pos")
    met = a.join(b, "tok").filter((F.col("a_top") < F.col("b_top")) & fit & (place <= differ + 2 * (SHARED - 1)))
    counted = met.groupBy("a_top", "b_top").agg(
        F.count(F.lit(1)).alias("c"), F.min(place - differ).alias("over"), F.min(F.least("a_low", "b_low")).alias("least")
    )
    return counted.filter((F.col("c") >= at.needed(F.col("least"))) & (F.col("over") <= 0)).select(
        F.col("a_top").alias("sid"), F.col("b_top").alias("other")
    )


def _xor(a: Column, b: Column) -> Column:
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def _links_below(tops: DataFrame, followers: DataFrame, linked: DataFrame, at: Threshold) -> DataFrame:
    """Links between sets of two different leaders: their distance follows from the three differences.

    Two steps: which sets under the first leader can reach one under the second,
    then which those are. In both a difference either is so small that nothing
    need be shared, or must share elements with the other one; few of these
    serve as index. So a leader's many followers don't meet all of its many
    neighbours.
    """
    none = F.array().cast("array<bigint>")
    near = tops.filter(F.col("delta").isNotNull())
    ends = near.select(F.col("sid").alias("lead"), F.col("n").alias("f_n")).unionByName(near.select(F.col("other").alias("lead"), F.col("m").alias("f_n"))).distinct()
    under = followers.select(F.col("other").alias("lead"), "sid", F.col("n").alias("f_n"), F.col("d").alias("f_d"), F.col("delta").alias("f_delta")).unionByName(
        ends.select("lead", F.col("lead").alias("sid"), "f_n", F.lit(0).cast("bigint").alias("f_d"), none.alias("f_delta"))
    )
    label = linked.select(F.col("node").alias("sid"), "label")
    under = under.join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid")).withColumn("f_reach", at.reach(F.col("f_n")))
    under = materialize(under.join(ends.select("lead").distinct(), "lead", "left_semi"), "under-leaders")
    radius = under.groupBy(F.col("lead").alias("r_lead")).agg(F.max("f_d").alias("radius"))
    pairs = near.select(F.col("sid").alias("lead"), F.col("other").alias("top"), "d", "delta").join(radius, F.col("top") == F.col("r_lead"))
    # the least distance to the second leader that a set may have
    first = _meet(materialize(pairs.select("lead", "top", "delta", F.col("d").alias("size"), F.col("radius").alias("spare")), "asks"), under)
    size = F.size("delta")
    first = first.select(
        F.col("top").alias("lead"), F.col("sid").alias("a_sid"), F.col("f_n").alias("a_n"), F.col("label").alias("a_label"), "spare",
        F.col("f_reach").alias("a_reach"), _xor(F.col("delta"), F.col("f_delta")).alias("delta"),
    )
    first = first.filter(size <= F.col("a_reach") + F.col("spare")).withColumn("size", size.cast("bigint")).withColumn("spare", F.lit(0).cast("bigint"))
    second = _meet(materialize(first, "reaching-sets"), under)
    may = (F.col("a_label") != F.col("label")) & at.sizes(F.col("a_n"), F.col("f_n"))
    distance = F.size(_xor(F.col("delta"), F.col("f_delta")))
    return second.filter(may).filter(at.similar(distance, F.col("a_n"), F.col("f_n"))).select(F.col("a_sid").alias("a"), F.col("sid").alias("b"))


def _meet(asks: DataFrame, under: DataFrame) -> DataFrame:
    """``asks(lead, delta, size, spare, ...)`` with those sets under the leader whose difference may
    be at most ``f_reach + spare`` away from ``delta``.

    That is ``size + f_d - 2 * shared``. What need not share an element is found
    by sizes; else one of the first ``f_d - shared + 1`` elements of the set's
    difference is in ``delta``. ``asks`` and ``under`` are stored tables: both
    are read several times.
    """
    least = asks.groupBy(F.col("lead").alias("l_lead")).agg(F.min(F.col("size") - F.col("spare")).alias("least"))
    sets = materialize(under.join(least, F.col("lead") == F.col("l_lead")).drop("l_lead"), "asked-sets")
    sure = F.col("size") + F.col("f_d") <= F.col("f_reach") + F.col("spare")
    most = sets.groupBy(F.col("lead").alias("l_lead")).agg(F.max(F.col("f_reach") - F.col("f_d")).alias("most"))
    some = asks.join(most, F.col("lead") == F.col("l_lead")).filter(F.col("size") - F.col("spare") <= F.col("most")).drop("l_lead", "most")
    direct = some.join(sets.filter(F.col("f_d") - F.col("f_reach") + F.col("least") <= 0).drop("least"), "lead").filter(sure)
    shared = F.greatest(F.lit(1), F.ceil((F.col("f_d") - F.col("f_reach") + F.col("least")) / 2)).cast("int")
    cut = F.greatest(F.size("f_delta") - shared + 1, F.lit(0))
    keys = sets.select("lead", "sid", "f_d", "f_reach", F.explode(F.slice("f_delta", F.lit(1), cut)).alias("tok"))
    tokens = asks.select("lead", F.xxhash64("delta", *_names(asks)).alias("ask"), "size", "spare", F.explode("delta").alias("tok"))
    met = tokens.join(keys, ["lead", "tok"]).filter(~sure).select("lead", "ask", "sid").distinct()
    found = asks.withColumn("ask", F.xxhash64("delta", *_names(asks))).join(met, ["lead", "ask"]).join(sets.drop("least"), ["lead", "sid"])
    return direct.unionByName(found.drop("ask"))


def _names(asks: DataFrame) -> list[str]:
    """Whole-number columns that tell one row from another."""
    return [c for c, kind in asks.dtypes if kind == "bigint"]


def connect(edges: DataFrame) -> DataFrame:
    """Connected components of ``a, b``: ``node, label`` with the smallest node as label.

    Alternates large-star and small-star steps, which need a number of rounds
    that grows with the logarithm of the longest chain; every step is stored.
    No round is needed after the one that leaves only stars.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("low").alias("b")))
        edges = materialize(small.distinct(), "small-star")
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"))
        if ends.filter("up > 0 and n > 1").isEmpty():  # every node above another one has that edge alone
            break
    tops = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(tops.select(F.col("b").alias("node"), F.col("b").alias("label")))


def similar_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: tuple[int, int] = (8, 10)
) -> DataFrame:
    """Group documents whose sets of distinct word N-grams are similar: ``key, n_shingles, component_id``.

    See ``labelled_groups`` for what is linked and for unusual rows.
    """
    return labelled_groups(df, key, text, words, similarity).select(key, "n_shingles", "component_id")


def labelled_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: tuple[int, int] = (8, 10)
) -> DataFrame:
    """``key, text_key, n_shingles, label, component_id``: a row's group, and what tells rows of one key apart.

    ``text_key`` is ``xxhash64`` of the text, ``label`` names the group (null: a
    text without words), also where several groups have rows of one ``key``.

    Words are runs of anything but ASCII white space, with A-Z in lower case; a
    text of fewer than ``words`` words is one N-gram, a text without words (or
    null) has none and is linked with nothing. Two documents are linked when
    ``q * shared >= p * all`` for ``similarity = (p, q)``; ``component_id`` is the
    smallest ``key`` that links reach, the row's own included.

    ``key`` is a whole number. Null keys are never a component's id unless all
    of its keys are null; equal texts are always linked, repeated rows give
    repeated rows; an empty table gives an empty table. No link is left out:
    there is no cap on lists, candidates or groups.
    """
    at = Threshold(*similarity)
    levels = frequency_levels(df.select(F.col(f"`{text}`").alias("text")), words)
    with lending(df.sparkSession) as lend:
        index = materialize(index_prefixes(df, lend(levels), key, text, words, at), "prefixes")
    shared = _shared_postings(index, at)
    star = _leaders(shared, at)
    # differences beyond a third of the set save nothing: such sets stand alone
    first = _compare(df, star.select("sid", F.col("lead").alias("other"), F.floor(F.col("n") / 3).alias("keep")), index, levels, text, words)
    followers = first.filter(F.col("delta").isNotNull())
    widest = followers.groupBy("other").agg(F.max("d").alias("radius"))
    crossing = _crossing(shared, followers, at)
    for side in ("sid", "other"):
        w = widest.select(F.col("other").alias("w"), F.col("radius").alias(f"radius_{side}"))
        crossing = crossing.join(w, F.col(side) == F.col("w"), "left").drop("w")
    radius = F.coalesce("radius_sid", F.lit(0)) + F.coalesce("radius_other", F.lit(0))
    sizes = index.filter("n > 0").select(F.col("sid"), "n").distinct()
    room = at.reach(F.col("n") + radius)
    keep = F.when(radius > 0, radius + room).otherwise(F.lit(-1))
    tops = _compare(df, crossing.join(sizes, "sid").select("sid", "other", keep.alias("keep")), index, levels, text, words)
    direct = first.unionByName(tops).filter(at.similar(F.col("d"), F.col("n"), F.col("m"))).select(F.col("sid").alias("a"), F.col("other").alias("b"))
    links = materialize(direct.unionByName(_follower_links(followers, at)), "links")
    labels = connect(links)
    below = materialize(_links_below(tops, followers, labels, at), "links-below")
    if not below.isEmpty():
        labels = connect(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(below))
    rows = index.select("key", "text_key", "sid", "n").join(labels, F.col("sid") == F.col("node"), "left")
    rows = materialize(rows.select("key", "text_key", F.col("n").alias("n_shingles"), F.coalesce("label", "sid").alias("label")), "labels")
    first_key = rows.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("key").alias("component_id"))
    return rows.join(first_key, "label", "left").select(
        F.col("key").alias(key), "text_key", "n_shingles", "label", F.when(F.col("label").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id")
    )
