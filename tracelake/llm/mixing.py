"""Mixing sources to target weights by Poisson replication, in SQL functions only.

A source whose share should be w of a mix of T documents and that has n rows is
repeated r = w * T / n times on average. Each row draws its number of copies
from a Poisson distribution of mean r by inversion: a hash of its id gives a
uniform number, and the copies are how many steps of the cumulative distribution
lie at or below it. Copies are exploded and dealt over all partitions by a hash,
in the order of that hash: a global shuffle that any rerun repeats.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_spread

MOST_SOURCES = 10_000


def hash_unit(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts, the same in any engine: (first 13 hex digits + 1/2) / 16^13, at 52 bits."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**13))


def repetition_rates(docs: DataFrame, weights: Mapping[str, float] | None, source_col: str = "source", epochs: float = 1.0, power: float = 0.5) -> DataFrame:
    """(source, n, rate, cdf): rows and mean copies of each source, and the cumulative Poisson distribution of that mean.

    weights: target shares by source, not necessarily summing to one; sources
    without one get nothing, and a source without rows leaves its share to the others. None: shares proportional to n ** power. The mix
    has epochs * rows documents on average.
    """
    counts = docs.groupBy(F.col(source_col).alias("__s")).agg(F.count("*").alias("n"))
    if weights is None:
        want = F.pow(F.col("n").cast("double"), F.lit(float(power)))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.expr("map('', 0D)")
        want = F.coalesce(F.try_element_at(given, F.coalesce("__s", F.lit(""))), F.lit(0.0))
    counts = counts.withColumn("want", want)
    all_n, all_want = counts.agg(F.sum("n")).scalar(), counts.agg(F.sum("want")).scalar()
    rated = counts.withColumn("rate", F.coalesce(F.col("want") / F.nullif(all_want, F.lit(0.0)) * all_n * F.lit(float(epochs)) / F.col("n"), F.lit(0.0)))
    steps = F.expr("cast(ceil(rate + 12 * sqrt(rate) + 20) as int)")
    # Steps in logarithms, so that a large mean doesn't vanish at the start.
    cdf = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.expr("struct(-rate as lp, 0D as total, cast(array() as array<double>) as cdf)"),
        lambda s, k: F.struct(
            (s["lp"] + F.log(F.col("rate")) - F.log(k + 1)).alias("lp"),
            (s["total"] + F.exp(s["lp"])).alias("total"),
            F.concat(s["cdf"], F.array(s["total"] + F.exp(s["lp"]))).alias("cdf"),
        ),
        lambda s: s["cdf"],
    )
    return rated.select("__s", "n", "rate", F.when(F.col("rate") > 0, cdf).otherwise(F.expr("cast(array() as array<double>)")).alias("cdf"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", epochs: float = 1.0, power: float = 0.5, seed: int = 7) -> DataFrame:
    """docs with each row repeated, plus copy (from 0), copies and shuffle_key; rows with no copies are gone, as the draw decides.

    A null id draws as the text "null"; a null source is a source of its own,
    weighed as "" if weights are given; rows with the same id draw alike. Empty
    input: empty result. Text is not looked at. Columns named like an added one
    are replaced; all others, whatever their names, stay.
    """
    docs = docs.drop(*[c for c in ("copy", "copies", "shuffle_key") if c in docs.columns])
    rates = repetition_rates(docs, weights, source_col, epochs, power).select(F.col("__s"), "n", F.col("rate").alias("__rate"), F.col("cdf").alias("__cdf"))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    if rates.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES:
        drawn = docs.join(F.broadcast(rates.drop("n")), F.col(source_col).eqNullSafe(F.col("__s")))
    else:  # a source with a large share of the rows is still broadcast
        key = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
        drawn = join_spread(docs.withColumn("__s", key(source_col)), rates.withColumn("__s", key("__s")), "__s")
    drawn = drawn.withColumn("__u", hash_unit(F.lit(str(seed)), ident))
    counted = drawn.withColumn("copies", F.when(F.col("__rate") > 0, F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))).otherwise(0)).where("copies > 0")
    copied = counted.drop("__s", "__rate", "__cdf", "__u").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    keyed = copied.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), ident, F.col("copy").cast("string"))))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
