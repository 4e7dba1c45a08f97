"""Mixing sources to target weights by hash-seeded Poisson replication.

Every row of a source is repeated a Poisson number of times. The mean is the
source's repetition rate: its target share of the total over its own size. The
uniform draw behind the count is a hash of the row's key, so a lost executor or
a second run repeats the same choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.session import materialize

_BITS = 52  # of the hash; they fill the fraction of a double exactly


def _uniform(seed: str, *parts: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of an MD5 digest."""
    keyed = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(keyed), 1, _BITS // 4), 16, 10).cast("bigint")
    return bits.cast("double") / F.lit(float(1 << _BITS))


def source_rates(
    df: DataFrame,
    source: str = "source",
    text: str = "text",
    weights: dict[str | None, float] | None = None,
    exponent: float = 0.7,
    total: float | None = None,
) -> DataFrame:
    """One row per source: ``mix_source, size, rate, cdf``.

    ``size`` counts code points over all rows (null text: 0). The target weight
    is ``weights[source]`` (absent: 0) or ``size ** exponent``; weights are
    divided by their sum. ``rate = weight * total / size`` with ``total`` the
    size of everything unless given. A source without a character has rate 1.
    ``cdf`` holds the cumulative Poisson probabilities of 0, 1, 2, ... up to
    where nothing is left at the resolution of the draw.
    """
    sizes = df.groupBy(F.col(f"`{source}`").alias("mix_source")).agg(
        F.coalesce(F.sum(F.char_length(F.col(f"`{text}`"))), F.lit(0)).alias("size")
    )
    if weights is None:
        weight = F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(exponent))).otherwise(0.0)
    else:
        spark = df.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "wanted string, given double")
        sizes = sizes.join(given, sizes["mix_source"].eqNullSafe(given["wanted"]), "left").drop("wanted")
        weight = F.when(F.col("size") > 0, F.coalesce("given", F.lit(0.0))).otherwise(0.0)
    sizes = sizes.withColumn("weight", weight)
    sums = sizes.agg(F.sum("weight").alias("weights"), F.sum("size").alias("all")).first()
    weight_sum, everything = float(sums["weights"] or 0.0), float(sums["all"] or 0.0)
    target = everything if total is None else float(total)
    rate = F.when(F.col("size") > 0, F.col("weight") / F.lit(weight_sum or 1.0) * F.lit(target) / F.col("size"))
    rates = sizes.withColumn("rate", F.coalesce(rate, F.lit(1.0)))
    steps = F.ceil(F.col("rate") + 10.0 * F.sqrt("rate") + 20).cast("int")
    log_factorial = lambda j: F.aggregate(
        F.when(j > 0, F.sequence(F.lit(1), j)).otherwise(F.array().cast("array<int>")),
        F.lit(0.0),
        lambda a, i: a + F.log(i.cast("double")),
    )
    terms = F.transform(
        F.sequence(F.lit(0), steps), lambda j: F.exp(-F.col("rate") + j * F.log("rate") - log_factorial(j))
    )
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))
    cdf = F.aggregate(
        F.col("terms"),
        start,
        lambda a, t: F.struct(
            (a["sum"] + t).alias("sum"), F.concat(a["all"], F.array(a["sum"] + t)).alias("all")
        ),
        lambda a: a["all"],
    )
    return (
        rates.withColumn("terms", F.when(F.col("rate") > 0, terms).otherwise(F.array(F.lit(1.0))))
        .withColumn("cdf", cdf)
        .select("mix_source", "size", "rate", "cdf")
    )


def mix_sources(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: str = "mix",
    **targets,
) -> DataFrame:
    """Repeat and shuffle rows so that the sources reach their target weights.

    Returns the columns of ``df`` and ``mix_copy`` (1, 2, ...) and ``mix_key``,
    the hash by which rows are dealt to partitions and sorted within them: the
    global shuffle. A row whose count is 0 is absent.

    Null sources form a source of their own, null keys and equal keys draw the
    same count (repeated rows are repeated alike), null and empty texts count
    as size 0, an empty table gives an empty table. Names that begin with
    ``mix_`` are not allowed in ``df``.
    """
    taken = [c for c in df.columns if c.lower().startswith("mix_")]
    if taken:
        raise ValueError(f"columns {taken} are made by mix_sources; rename yours")
    rates = materialize(source_rates(df, source, text, **targets), "mix-rates").select("mix_source", F.col("cdf").alias("mix_cdf"))
    names = [F.col(f"`{c}`") for c in df.columns]
    drawn = df.join(rates, F.col(f"`{source}`").eqNullSafe(rates["mix_source"]))
    u = _uniform(seed, F.col(f"`{key}`"))
    drawn = drawn.withColumn("mix_u", u).withColumn("mix_n", F.size(F.filter("mix_cdf", lambda c: c <= F.col("mix_u"))))
    copies = drawn.filter("mix_n > 0").select(*names, F.explode(F.sequence(F.lit(1), F.col("mix_n"))).alias("mix_copy"))
    place = F.md5(
        F.concat_ws("|", F.lit(seed + "-order"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), "mix_copy")
    )
    return copies.withColumn("mix_key", place).repartition("mix_key").sortWithinPartitions("mix_key")
