"""Onsets, trials and epochs, and what is averaged over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scan
from ..model import KEYS, chunked, half_away, own, series, whole


def rising_edges(df: DataFrame, threshold: float | Column, by: Sequence[str] = KEYS) -> DataFrame:
    """(keys, i, t): samples above the threshold whose predecessor isn't; a series that starts above has one at i = 1."""
    over = F.coalesce(F.col("y") > threshold, F.lit(False))
    rows, w = chunked(df.withColumn("_up", over), by, 1, 0)
    rows = own(rows.withColumn("_was", F.coalesce(F.lag("_up").over(w), F.lit(False))), 1, 0)
    return rows.where(F.col("_up") & ~F.col("_was")).select(*by, "i", "t")


def greedy_gap(onsets: DataFrame, samples: int, by: Sequence[str] = KEYS) -> DataFrame:
    """Onsets at least so many samples behind the last one kept; the first is kept. One pass over a series' sorted
    onsets, whose state is the last kept."""
    def kernel(last, columns, ends):
        kept, last = scan.spaced(columns["i"], columns["i"], samples, last)
        return kept, len(columns["i"]), last

    return scan.scanned(onsets.select(*by, F.col("i").cast("long").alias("i"), "t"), by, ["i"], kernel)


def successive_gap(onsets: DataFrame, seconds: float, by: Sequence[str] = KEYS) -> DataFrame:
    """Onsets more than so many seconds behind the previous onset, kept or not; the first is kept."""
    gap = F.col("t") - F.lag("t").over(series(by))
    return onsets.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > seconds)).drop("_gap")


def centred_onsets(stim: DataFrame, threshold: float, seconds: float, fs: float, by: Sequence[str] = KEYS, compat: bool = False) -> DataFrame:
    """Edges of the stimulus less its mean, then the successive rule. compat: onset time i / fs, one sample late."""
    edges = rising_edges(stim.withColumn("y", F.col("y") - F.avg("y").over(whole(by))), threshold, by)
    edges = edges.withColumn("t", (F.col("i") - (0 if compat else 1)) / F.lit(float(fs)))
    return successive_gap(edges, seconds, by)


def windows_at(signal: DataFrame, onsets: DataFrame, pre: int, post: int, fs: float, by: Sequence[str] = KEYS) -> DataFrame:
    """(keys, onset, i, t_rel, y): samples onset - pre .. onset + post; windows that leave the series go whole.

    Each onset is posted to the one or more blocks of samples that its window touches, so the join is an equality on
    (keys, block) with a range test inside, whatever the sides' sizes.
    """
    n, by = pre + post + 1, list(by)
    block = max(n, 256)
    posts = onsets.select(*by, F.col("i").alias("onset")).withColumn("_b", F.explode(F.sequence(F.floor((F.col("onset") - pre) / block), F.floor((F.col("onset") + post) / block))))
    rows = signal.select(*by, "i", "y").withColumn("_b", F.floor(F.col("i") / block)).join(posts, [*by, "_b"])
    rows = rows.where(F.col("i").between(F.col("onset") - pre, F.col("onset") + post))
    k = F.col("i") - F.col("onset")
    rows = rows.withColumn("_n", F.count("*").over(W.partitionBy(*by, "onset"))).where(F.col("_n") == n)
    return rows.select(*by, "onset", (k + pre + 1).alias("i"), (k / F.lit(float(fs))).alias("t_rel"), "y")


def segment_bounds(onsets: DataFrame, pre: float, post: float) -> DataFrame:
    """(.., t_start, t_end): time windows around onsets, neither clipped nor dropped."""
    return onsets.withColumn("t_start", F.col("t") - pre).withColumn("t_end", F.col("t") + post)


def epochs(signal: DataFrame, onsets: DataFrame, fs: float, pre: float, post: float, by: Sequence[str] = KEYS) -> DataFrame:
    """Onset times of another stream to windows of this one: sample round(t * fs) + 1, pre and post in seconds."""
    at = onsets.withColumn("i", F.round(F.col("t") * float(fs)).cast("long") + 1)
    return windows_at(signal, at, half_away(pre * fs), half_away(post * fs), fs, by)


def mean_and_sd(trials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, i, t_rel, mean, sd, n): the sample deviation; 0 for a single trial."""
    n, sd = F.count("y"), F.stddev_samp("y")
    return trials.groupBy(*by, "i", "t_rel").agg(F.avg("y").alias("mean"), F.when(n == 1, 0.0).otherwise(sd).alias("sd"), n.alias("n"))


def baseline_corrected(trials: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each trial less its mean before time 0; NULL where a trial has no such sample (callers that must fail check)."""
    base = F.avg(F.when(F.col("t_rel") < 0, F.col("y"))).over(W.partitionBy(*by))
    return trials.withColumn("y", F.col("y") - base)


def require_prestimulus(trials: DataFrame) -> DataFrame:
    if not trials.where(F.col("t_rel") < 0).head(1):
        raise ValueError("a baseline needs samples before time 0")
    return trials


def channel_mean(df: DataFrame) -> DataFrame:
    return df.groupBy("i").agg(F.first("t").alias("t"), F.avg("y").alias("y"))


def current_source_density(df: DataFrame, spacing_um: float, depths: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, depth, i, y): minus the second difference along depth over spacing squared; the ends repeat their neighbour.

    df: (by, depth 1..depths, i, y). Needs three depths. Where a depth next to it lacks the sample, a depth's density is
    NULL; an end's is NULL where its neighbour's is.
    """
    if depths < 3:
        raise ValueError("current source density needs three channels")
    w, dz = W.partitionBy(*by, "i").orderBy("depth"), spacing_um * 1e-6
    below, above = F.lag("depth").over(w) == F.col("depth") - 1, F.lead("depth").over(w) == F.col("depth") + 1
    csd = -(F.lead("y").over(w) - 2 * F.col("y") + F.lag("y").over(w)) / F.lit(dz * dz)
    rows = df.withColumn("_c", F.when(below & above, csd))
    filled = F.when((F.col("depth") == 1) & above, F.lead("_c").over(w)).when((F.col("depth") == depths) & below, F.lag("_c").over(w)).otherwise(F.col("_c"))
    return rows.withColumn("y", filled).drop("_c")


def ordered_channels(df: DataFrame, order: Sequence[int]) -> DataFrame:
    """df with depth 1.. by the given channels; unknown channels are an error."""
    spark = df.sparkSession
    want = spark.createDataFrame([(int(c), k + 1) for k, c in enumerate(order)], "channel long, depth long")
    unknown = [r["channel"] for r in want.join(df.select("channel").distinct(), "channel", "left_anti").collect()]  # as many as the order lists
    if unknown:
        raise ValueError(f"unknown channels: {sorted(unknown)}")
    return df.join(F.broadcast(want), "channel")


def interval_histogram(events: DataFrame, width: float, by: Sequence[str] = ("cluster",)) -> DataFrame:
    """(by, bin, n): intervals between successive times, counted in bins of the width from 0."""
    gap = F.col("t") - F.lag("t").over(W.partitionBy(*by).orderBy("t"))
    return events.withColumn("_g", gap).where(F.col("_g").isNotNull()).groupBy(*by, F.floor(F.col("_g") / width).alias("bin")).agg(F.count("*").alias("n"))
