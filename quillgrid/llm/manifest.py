"""A Merkle manifest of a dataset, with leaf places from bitmaps instead of a sort.

Ids of a group are bits of 64-bit words, which Spark merges with ``bit_or``
before the shuffle; only words that hold an id exist, so sparse ids cost a word
each and dense ones an eighth of a byte. Above the words stands a directory of
popcounts in levels of a fixed width (1,024 words, then 65,536 children each),
so that no list of counts grows with the table. An id's place is what the
directory counts before its word, and the ones below its bit. Rows that share
an id are placed among each other by a second index over their digests.

Nodes then meet by (group, place / 16) as keyed slots, level by level. A proof
is the chain of runs above a leaf; a leaf is folded along it to a root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.batches import clashing
from quillgrid.session import materialize

ARITY = 16
_WORD = 6  # bits of an id inside a word
_DIRECTORY = (10, 16, 16, 16)  # bits of each level of popcounts above the words: 64 in all
MADE = {"leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "tampered"}


def digest_of(*columns: Column) -> Column:
    """Lower-case hex SHA-256 of a row's values, each as ``byte count:value`` in UTF-8, null as ``-``."""
    texts = [c.cast("string") for c in columns]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case, other letters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def tampered_row(key: Column) -> Column:
    """Rows whose crc32 of the decimal id is a multiple of 5; null ids aren't."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _same(a: DataFrame, b: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Join on columns that may be null; ``b``'s own copies of them are left out."""
    named = b.select(*[F.col(c).alias(f"r_{c}") if c in columns else F.col(c) for c in b.columns])
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return a.join(named, on, how).drop(*[f"r_{c}" for c in columns])


def rank_in_groups(df: DataFrame, groups: list[str], key: str, weight: str) -> DataFrame:
    """``groups, key, below``: for every distinct key the weight of its group's smaller keys.

    ``df`` has one row for each group and key. Keys are 64-bit numbers in signed
    order and not null, weights positive.
    """
    low = F.col(key).bitwiseAND(F.lit((1 << _WORD) - 1)).cast("int")
    rows = df.select(*groups, F.shiftright(key, _WORD).alias("word"), low.alias("low"), F.col(weight).alias("weight"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("low"))
    words = rows.groupBy(*groups, "word").agg(
        F.bit_or(bit).alias("bits"),
        # ids of more than one row are rare: at most 64 of a word are listed
        F.collect_list(F.when(F.col("weight") > 1, F.struct("low", (F.col("weight") - 1).alias("more")))).alias("repeats"),
    )
    more = F.aggregate("repeats", F.lit(0).cast("bigint"), lambda a, r: a + r["more"])
    words = materialize(words.withColumn("total", F.bit_count("bits") + more), "bitmap-words")
    levels = [words.select(*groups, F.col("word").alias("node"), "total")]
    for bits in _DIRECTORY[:-1]:
        parent = levels[-1].groupBy(*groups, F.shiftright("node", bits).alias("node")).agg(F.sum("total").alias("total"))
        levels.append(materialize(parent, "popcounts"))
    # from the top down: what stands before a node's parent, and before the node among its parent's children
    before = None
    for bits, level in zip(reversed(_DIRECTORY), reversed(levels), strict=True):
        keys = ", ".join(f"`{g}`" for g in groups)
        # at most 65,536 nodes, below and above 0, are left at the top
        own = level.withColumn("parent", F.lit(0).cast("bigint") if before is None else F.shiftright("node", bits))
        inside = F.expr(
            f"coalesce(sum(total) over (partition by {keys}{', ' if keys else ''}parent order by node "
            "rows between unbounded preceding and 1 preceding), 0)"
        )
        own = own.withColumn("inside", inside)
        if before is not None:
            own = _same(own, before.withColumnRenamed("node", "parent").withColumnRenamed("before", "above"), [*groups, "parent"])
        else:
            own = own.withColumn("above", F.lit(0).cast("bigint"))
        before = materialize(own.select(*groups, "node", (F.col("above") + F.col("inside")).alias("before")), "directory")
    placed = _same(words, before.withColumnRenamed("node", "word"), [*groups, "word"])
    keyed = df.select(*groups, key, F.shiftright(key, _WORD).alias("word"), low.alias("low"))
    found = _same(keyed, placed.select(*groups, "word", "bits", "repeats", "before"), [*groups, "word"])
    mask = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.col("low")))
    earlier = F.aggregate(
        F.filter("repeats", lambda r: r["low"] < F.col("low")), F.lit(0).cast("bigint"), lambda a, r: a + r["more"]
    )
    below = F.col("before") + F.bit_count(F.col("bits").bitwiseAND(mask)) + earlier
    return found.select(*groups, key, below.alias("below"))


def leaf_places(leaves: DataFrame) -> DataFrame:
    """``leaves`` (``group, id, leaf, tampered``) with ``place``: from 0 in each group, by id (null last), then by leaf.

    Rows that agree in all columns are counted first and dealt consecutive
    places, so they never meet in one task.
    """
    entries = materialize(leaves.groupBy("group", "id", "leaf", "tampered").agg(F.count(F.lit(1)).alias("copies")), "leaves")
    ids = entries.groupBy("group", "id").agg(
        F.sum("copies").alias("weight"), F.min("leaf").alias("first_leaf"), F.max("leaf").alias("last_leaf")
    )
    ids = materialize(ids, "ids")
    known = ids.filter("id is not null")
    below = rank_in_groups(known, ["group"], "id", "weight")
    all_known = known.groupBy("group").agg(F.sum("weight").alias("below"))
    nulls = _same(ids.filter("id is null").select("group", "id"), all_known, ["group"], "left")
    nulls = nulls.select("group", "id", F.coalesce("below", F.lit(0).cast("bigint")).alias("below"))
    starts = materialize(below.unionByName(nulls), "starts")
    # rows of one id with different digests: ranked by the digest's first 60 bits, then by the rest
    crowded = ids.filter("first_leaf <> last_leaf").select("group", "id")
    single = _same(entries, ids.filter("first_leaf = last_leaf").select("group", "id"), ["group", "id"])
    several = materialize(_same(entries, crowded, ["group", "id"]), "crowded")
    if several.isEmpty():
        return _dealt(_same(single.withColumn("inside", F.lit(0).cast("bigint")), starts, ["group", "id"]))
    several = several.withColumn("prefix", F.conv(F.substring("leaf", 1, 15), 16, 10).cast("bigint"))
    prefixes = several.groupBy("group", "id", "prefix").agg(F.sum("copies").alias("weight"))
    inside = rank_in_groups(prefixes, ["group", "id"], "prefix", "weight")
    ranked = _same(several, inside.withColumnRenamed("below", "inside"), ["group", "id", "prefix"])
    tie = F.expr(
        "coalesce(sum(copies) over (partition by `group`, id, prefix order by leaf, tampered "
        "rows between unbounded preceding and 1 preceding), 0)"
    )
    ranked = ranked.withColumn("inside", F.col("inside") + tie).drop("prefix")
    both = single.withColumn("inside", F.lit(0).cast("bigint")).unionByName(ranked)
    return _dealt(_same(both, starts, ["group", "id"]))


def _dealt(placed: DataFrame) -> DataFrame:
    """A row for each copy, at consecutive places from ``below + inside`` on."""
    first = F.col("below") + F.col("inside")
    return placed.select(
        "group", "id", "leaf", "tampered", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("place")
    )


def _runs(nodes: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, slot, run``: digests of consecutive nodes, each in the place that its key names."""
    keyed = nodes.groupBy(*groups, F.floor(F.col("place") / ARITY).cast("bigint").alias("slot")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("place") % ARITY).cast("int").alias("i"), "digest"))).alias("slots")
    )
    run = F.transform(F.sequence(F.lit(0), F.size("slots") - 1), lambda i: F.element_at("slots", i))
    return keyed.select(*groups, "slot", run.alias("run"))


def _levels(nodes: DataFrame, groups: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level, and ``groups, digest`` of the single node that remains."""
    levels, tops = [], None
    while True:
        sizes = nodes.groupBy(*groups).agg(F.max("place").alias("last"))
        done = _same(nodes, sizes.filter("last = 0").select(*groups), groups).select(*groups, "digest")
        tops = done if tops is None else tops.unionByName(done)
        open_ = _same(nodes, sizes.filter("last > 0").select(*groups), groups)
        runs = materialize(_runs(open_, groups), f"{name}-{len(levels)}")
        if runs.isEmpty():
            return levels, materialize(tops, f"{name}-tops")
        levels.append(runs)
        nodes = runs.select(*groups, F.col("slot").alias("place"), F.sha2(F.concat_ws("", "run"), 256).alias("digest"))


def _paths(levels: list[DataFrame], groups: list[str], above: DataFrame) -> DataFrame:
    """``groups, slot, path``: for every run of the lowest level the runs above it, with the place of its node in each.

    ``above`` has ``groups, path``: what follows behind a group's last node.
    """
    path = None
    for level in reversed(levels):
        runs = level.withColumn("up", F.floor(F.col("slot") / ARITY).cast("bigint"))
        step = lambda run: F.struct((F.col("slot") % ARITY).cast("int").alias("i"), F.col(run).alias("run"))
        if path is None:
            found = _same(runs, above, groups)
            path = found.select(*groups, "slot", "run", "path")
            continue
        parent = path.withColumnRenamed("slot", "up").withColumnRenamed("run", "over")
        # a group's highest runs have nothing above but ``above``
        found = _same(runs, parent, [*groups, "up"], "left")
        tops = _same(found.filter(F.col("path").isNull()).drop("path"), above, groups)
        inner = found.filter(F.col("path").isNotNull()).withColumn("path", F.concat(F.array(step("over")), F.col("path")))
        path = materialize(inner.select(*groups, "slot", "run", "path").unionByName(tops.select(*groups, "slot", "run", "path")), "paths")
    return path


def _fold(digest: Column, path: Column) -> Column:
    """The root above a digest: at each step it takes its place in the run."""
    return F.aggregate(
        path,
        digest,
        lambda acc, s: F.sha2(
            F.concat(
                F.concat_ws("", F.slice(s["run"], F.lit(1), s["i"])), acc, F.concat_ws("", F.slice(s["run"], s["i"] + 2, F.lit(ARITY)))
            ),
            256,
        ),
    )


def _siblings(path: Column) -> Column:
    """All digests beside the path, from the lowest level up, left to right."""
    return F.concat_ws(
        "",
        F.transform(
            path,
            lambda s: F.concat(
                F.concat_ws("", F.slice(s["run"], F.lit(1), s["i"])), F.concat_ws("", F.slice(s["run"], s["i"] + 2, F.lit(ARITY)))
            ),
        ),
    )


def merkle_manifest(leaves: DataFrame) -> DataFrame:
    """``group, id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``leaves``.

    ``leaves`` has ``group`` (text), ``id`` (whole number), ``leaf`` and
    ``tampered`` (digests in hex). In each group leaves stand by id; every
    ``ARITY`` consecutive nodes (the last run: fewer) become the digest of
    their concatenation until one is left, the group's subroot. Subroots by
    group (null first, then by bytes) give the root likewise.
    ``folded_root`` is what ``tampered`` gives in the leaf's place.

    Null ids come last, rows of one id are ordered by their leaf, rows that
    agree in everything give equal numbers of rows; an empty table gives an
    empty table.
    """
    placed = materialize(leaf_places(leaves), "places")
    nodes = placed.select("group", "place", F.col("leaf").alias("digest"))
    levels, subroots = _levels(nodes, ["group"], "runs")
    # groups by bytes: the hex text of their bytes sorts alike; null first
    named = subroots.select("group", "digest", F.when(F.col("group").isNull(), "").otherwise(F.concat(F.lit("x"), F.hex("group"))).alias("name"))
    group_nodes = materialize(_positions(named), "subroots")
    group_levels, roots = _levels(group_nodes.select("place", "digest"), [], "group-runs")
    root = F.col("root")
    root_row = roots.select(F.col("digest").alias("root"))
    none = F.array().cast("array<struct<i:int,run:array<string>>>")
    if group_levels:
        above = _paths(group_levels, [], root_row.select(none.alias("path")))
        own = group_nodes.withColumn("slot", F.floor(F.col("place") / ARITY).cast("bigint"))
        found = own.join(above, "slot")
        step = F.struct((F.col("place") % ARITY).cast("int").alias("i"), F.col("run"))
        tops = found.select("group", F.col("digest").alias("subroot"), F.concat(F.array(step), F.col("path")).alias("path"))
    else:
        tops = group_nodes.select("group", F.col("digest").alias("subroot"), none.alias("path"))
    # the root is folded along each group's own path, so no one-row table is joined to all
    tops = materialize(tops.withColumn("root", _fold(F.col("subroot"), F.col("path"))), "tops")
    own = placed.withColumn("slot", F.floor(F.col("place") / ARITY).cast("bigint"))
    step = F.struct((F.col("place") % ARITY).cast("int").alias("i"), F.col("run"))
    if levels:
        below = _paths(levels, ["group"], tops.select("group", "path"))
        inner = _same(own, below, ["group", "slot"], "left")
        path = F.when(F.col("path").isNull(), none).otherwise(F.concat(F.array(step), F.col("path")))
        inner = inner.withColumn("own_path", path).drop("path", "run")
    else:
        inner = own.withColumn("own_path", none)
    joined = _same(inner, tops, ["group"])
    # a lone leaf is its group's subroot
    whole = F.when(F.size("own_path") == 0, F.col("path")).otherwise(F.col("own_path"))
    out = joined.withColumn("whole", whole)
    folded = _fold(F.col("tampered"), F.col("whole"))
    return out.select(
        "group", "id", "leaf", "subroot", "root", F.sha2(_siblings(F.col("whole")), 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == root).alias("verified"),
    )


def _positions(named: DataFrame) -> DataFrame:
    """``named`` with ``place``: its rank by ``name``, from a range-partitioned sort and offsets."""
    ordered = materialize(
        named.repartitionByRange("name").sortWithinPartitions("name").withColumn("__at", F.monotonically_increasing_id()), "group-order"
    )
    part = F.shiftright("__at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(
        F.col("part").alias("o_part"),
        F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("offset"),
    )  # a row for each partition
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(offsets, part == F.col("o_part")).select("group", "digest", (F.col("offset") + inside).alias("place"))


def document_manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """The manifest of a table of documents: ``key, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A leaf is the digest of ``columns``; the tampered row (see ``tampered_row``)
    differs in the case of its ``text`` alone. Other columns of ``docs`` don't
    matter and may have any name.
    """
    clashing([key], MADE)
    col = lambda c: F.col(f"`{c}`")
    changed = F.when(tampered_row(col(key)), lower_ascii(col("text"))).otherwise(col("text"))
    leaves = docs.select(
        col(group).cast("string").alias("group"), col(key).cast("bigint").alias("id"), digest_of(*map(col, columns)).alias("leaf"),
        digest_of(*[changed if c == "text" else col(c) for c in columns]).alias("tampered"),
    )
    return merkle_manifest(leaves).withColumnRenamed("id", key).drop("group")
