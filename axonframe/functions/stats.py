"""Order statistics as relational expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values of a group up to which approximate percentiles are exact in Spark, and the inverse of their rank error beyond.
ACCURACY = 10_000


def hazen(df: DataFrame, value: str, p: float, by: Sequence[str] = (), out: str = "q") -> DataFrame:
    """(by, out): the percentile with midpoint interpolation: place n * p / 100 + 1/2, within 1..n, linear between.

    Approximate percentiles with a known rank error give each group a narrow band that must hold the value; what lies
    below is counted, and only the band's distinct values are ranked. Both are aggregations with map-side parts, so a
    group is neither moved nor held as a whole; small groups are a band.
    """
    keys, share = list(by), min(100.0, max(0.0, p)) / 100
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = F.percentile_approx("_v", F.array(F.lit(max(0.0, share - 3 / ACCURACY)), F.lit(min(1.0, share + 3 / ACCURACY))), F.lit(ACCURACY))
    facts = rows.groupBy(*keys).agg(F.count("*").alias("_all"), ends.alias("_ends"))
    large = F.col("_all") > ACCURACY
    facts = facts.select(*keys, "_all", F.when(large, F.col("_ends")[0]).alias("_from"), F.when(large, F.col("_ends")[1]).alias("_to"))
    facts = facts.withColumn("_p", F.least(F.greatest(F.col("_all") * F.lit(share) + 0.5, F.lit(1.0)), F.col("_all").cast("double")))
    near = rows.join(facts, keys) if keys else rows.crossJoin(F.broadcast(facts))  # one row
    # values below the band are one value of it, so that they count
    counts = near.where(F.col("_to").isNull() | (F.col("_v") <= F.col("_to"))).withColumn("_v", F.when(F.col("_v") >= F.coalesce("_from", F.col("_v")), F.col("_v")))
    counts = counts.groupBy(*keys, "_v", "_p").agg(F.count("*").alias("_n"))
    ranked = counts.withColumn("_hi", F.sum("_n").over(W.partitionBy(*keys).orderBy(F.asc_nulls_first("_v"))))
    at = lambda k: F.max(F.when((F.col("_hi") - F.col("_n") < k) & (k <= F.col("_hi")), F.col("_v")))
    found = ranked.groupBy(*keys).agg(at(F.floor("_p")).alias("_a"), at(F.ceil("_p")).alias("_b"), F.max("_p").alias("_p"))
    return found.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_p") - F.floor("_p"))).alias(out))


def median(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "med") -> DataFrame:
    return hazen(df, value, 50.0, by, out)


def mad(df: DataFrame, value: str, by: Sequence[str], scale: float = 1.4826) -> DataFrame:
    """(by, med, mad): the median and the scaled median distance from it."""
    keys = list(by)
    med = median(df, value, keys)
    off = median(df.join(med, keys).withColumn("_d", F.abs(F.col(value) - F.col("med"))), "_d", keys, "mad")
    return med.join(off, keys).withColumn("mad", F.col("mad") * scale)
