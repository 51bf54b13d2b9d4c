"""Spike detection, alignment and waveform features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import neighbours, scan, stats
from ..model import KEYS, chunked, half_away, own, series, whole

METHODS, POLARITIES = ("standard", "mad", "neo", "rolling", "percentile"), ("negative", "positive", "both")
#: What a detection starts from.
DEFAULTS = {"k": 3.5, "refractory_ms": 1.0, "align_ms": 1.5, "components": 3, "min_spikes": 20, "drift_s": 30.0}


def refractory_samples(ms: float, fs: float) -> int:
    return half_away(ms / 1000 * fs)


def energy(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """The nonlinear energy y^2 less the product of the neighbours, in place of y; beyond the ends is 0."""
    rows, w = chunked(df, by, 1, 1)
    return own(rows.withColumn("y", F.col("y") * F.col("y") - F.coalesce(F.lag("y").over(w), F.lit(0.0)) * F.coalesce(F.lead("y").over(w), F.lit(0.0))), 1, 1)


def unit_range(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    low, high = F.min("y").over(whole(by)), F.max("y").over(whole(by))
    return df.withColumn("y", F.when(high > low, (F.col("y") - low) / (high - low)).otherwise(0.0))


def prepared(df: DataFrame, method: str, by: Sequence[str] = KEYS, compat: bool = False) -> DataFrame:
    """What is searched: the signal, or for `neo` its energy (compat: its values scaled to 0..1)."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    return df if method != "neo" else unit_range(df, by) if compat else energy(df, by)


def thresholds(df: DataFrame, method: str, k: float = DEFAULTS["k"], by: Sequence[str] = KEYS) -> DataFrame:
    """(keys, threshold) of prepared signals: mean and deviation, median and MAD, or the 99.9th percentile of sizes."""
    keys = list(by)
    if method == "standard":
        return df.groupBy(*keys).agg((F.avg("y") + k * F.stddev_samp("y")).alias("threshold"))
    if method == "percentile":
        return stats.hazen(df.withColumn("_a", F.abs("y")), "_a", 99.9, keys, "threshold")
    return stats.mad(df, "y", keys).select(*keys, (F.col("med") + k * F.col("mad")).alias("threshold"))


def rolling_thresholds(df: DataFrame, reach: int, k: float = DEFAULTS["k"], by: Sequence[str] = KEYS) -> DataFrame:
    """df with threshold: median and MAD over the samples at most `reach` away."""
    rows, w = chunked(df, by, reach, reach)
    w = w.rowsBetween(-reach, reach)
    rows = own(rows.withColumn("_w", F.collect_list("y").over(w)).withColumn("_m", F.percentile("y", 0.5).over(w)), reach, reach)
    half = lambda a: (F.element_at(a, ((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, (F.size(a) / 2).cast("int") + 1)) / 2
    off = half(F.array_sort(F.transform("_w", lambda x: F.abs(x - F.col("_m")))))
    return rows.withColumn("threshold", F.col("_m") + k * 1.4826 * off).drop("_w", "_m")


def both_thresholds(df: DataFrame, method: str, k: float = DEFAULTS["k"], by: Sequence[str] = KEYS) -> DataFrame:
    """(keys, high, low): for either polarity at once."""
    keys = list(by)
    if method == "mad":
        return stats.mad(df, "y", keys).select(*keys, (F.col("med") + k * F.col("mad")).alias("high"), (F.col("med") - k * F.col("mad")).alias("low"))
    t = thresholds(df, "standard" if method == "rolling" else method, k, keys)
    return t.select(*keys, F.col("threshold").alias("high"), (F.col("threshold") if method == "neo" else -F.col("threshold")).alias("low"))


def peak_candidates(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """(keys, i, t, y): inner local maxima; of a plateau the first sample."""
    w = series(by)
    before = F.lag("y").over(w)
    run = F.when(before.isNull() | (F.col("y") != before), 1).otherwise(0)
    rows = df.withColumn("_r", F.sum(run).over(w))
    runs = rows.groupBy(*by, "_r").agg(F.min("i").alias("i"), F.min("t").alias("t"), F.first("y").alias("y"))
    v = W.partitionBy(*by).orderBy("_r")
    return runs.withColumn("_a", F.lag("y").over(v)).withColumn("_b", F.lead("y").over(v)).where((F.col("y") > F.col("_a")) & (F.col("y") > F.col("_b"))).select(*by, "i", "t", "y")


def suppressed(peaks: DataFrame, distance: int, by: Sequence[str] = KEYS) -> DataFrame:
    """Peaks, tallest first (then earliest), without others at most `distance` samples away.

    Peaks further apart don't meet, so one pass over a series' sorted peaks settles each cluster of them by itself.
    """
    def kernel(state, columns, ends):
        i, y = columns["i"], columns["y"]
        breaks = np.flatnonzero(np.diff(i) > distance) + 1
        done = len(i) if ends else int(breaks[-1]) if len(breaks) else 0
        return scan.tallest(i[:done], y[:done], distance), done, None

    return scan.scanned(peaks.select(*by, F.col("i").cast("long").alias("i"), "t", "y"), by, ["i"], kernel)


def peaks(df: DataFrame, threshold: DataFrame, distance: int, by: Sequence[str] = KEYS) -> DataFrame:
    """Local maxima above their series' threshold, apart by more than the distance."""
    high = peak_candidates(df, by).join(threshold, list(by)).where(F.col("y") > F.col("threshold")).drop("threshold")
    return suppressed(high, distance, by)


def detected(df: DataFrame, method: str = "mad", polarity: str = "negative", k: float = DEFAULTS["k"], distance: int = 1, by: Sequence[str] = KEYS, compat: bool = False) -> DataFrame:
    """(keys, i, t, y, sign): spikes by a method and a polarity; `both` are the peaks of either sign together."""
    if polarity not in POLARITIES:
        raise ValueError(f"unknown polarity {polarity!r}")
    x = prepared(df, method, by, compat)
    flipped = x.withColumn("y", -F.col("y"))
    if polarity != "both":
        side, sign = (flipped, -1) if polarity == "negative" else (x, 1)
        base = thresholds(x if compat else side, method, k, by)
        return peaks(side, base, distance, by).withColumn("y", F.col("y") * sign).withColumn("sign", F.lit(sign))
    two = both_thresholds(x, method, k, by)
    up = peaks(x, two.select(*by, F.col("high").alias("threshold")), distance, by).withColumn("sign", F.lit(1))
    down = peaks(flipped, two.select(*by, (-F.col("low")).alias("threshold")), distance, by).withColumn("y", -F.col("y")).withColumn("sign", F.lit(-1))
    return up.unionByName(down)


def crossings(df: DataFrame, threshold: DataFrame, refractory: int, reach: int, by: Sequence[str] = KEYS) -> DataFrame:
    """(keys, i): samples above the threshold, each moved to the largest within `reach`, a refractory gap apart.

    The largest neighbour is a window; what is kept is one pass over a series' samples above the threshold.
    """
    rows, w = chunked(df, by, reach, reach)
    top = F.max(F.struct("y", (-F.col("i")).alias("ni"))).over(w.rowsBetween(-reach, reach))
    rows = own(rows.withColumn("_j", -top["ni"]), reach, reach).join(threshold, list(by)).where(F.col("y") > F.col("threshold"))

    def kernel(last, columns, ends):
        kept, last = scan.spaced(columns["_i"], columns["i"], refractory + 1, last)
        return kept, len(columns["_i"]), last

    return scan.scanned(rows.select(*by, F.col("_j").cast("long").alias("i"), F.col("i").cast("long").alias("_i")), by, ["_i"], kernel).drop("_i")


def require_enough(spikes: DataFrame, min_spikes: int) -> DataFrame:
    n = spikes.limit(2 * min_spikes).count()
    if n == 0:
        raise ValueError("no spikes above the threshold")
    if n < 2 * min_spikes:
        raise ValueError("too few spikes to cluster")
    return spikes


def snippets(df: DataFrame, at: DataFrame, before: int, after: int, by: Sequence[str] = KEYS, whole_only: bool = True) -> DataFrame:
    """at's rows (keys, i, ...) with wave, the samples i - before .. i + after. Windows that leave the series go, or
    come as NULLs where whole_only is False."""
    n, by, block = before + after + 1, list(by), max(256, before + after + 1)
    extra = [c for c in at.columns if c not in (*by, "i")]
    posts = at.withColumn("_b", F.explode(F.sequence(F.floor((F.col("i") - before) / block), F.floor((F.col("i") + after) / block))))
    posts = posts.select(*by, F.col("i").alias("_at"), *extra, "_b")
    rows = df.select(*by, F.col("i").alias("_i"), F.col("y").alias("_y")).withColumn("_b", F.floor(F.col("_i") / block)).join(posts, [*by, "_b"])
    rows = rows.where(F.col("_i").between(F.col("_at") - before, F.col("_at") + after))
    wave = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_y"))), lambda x: x["_y"])
    out = rows.groupBy(*by, "_at", *extra).agg(wave.alias("wave")).withColumn("wave", F.when(F.size("wave") == n, F.col("wave")))
    if whole_only:
        out = out.where(F.col("wave").isNotNull())
    return out.select(*by, F.col("_at").alias("i"), *extra, "wave")


def aligned(df: DataFrame, spikes: DataFrame, window: int, before: int, after: int, polarity: str = "negative", by: Sequence[str] = KEYS) -> DataFrame:
    """(keys, i, t, centre, wave): each spike's waveform around the extremum of i - before .. i + after, the first of
    equal ones. The spike's time stays; spikes whose search or waveform leaves the series go."""
    near = snippets(df, spikes.select(*by, "i", "t"), before, after, by)
    size = {"negative": lambda x: -x, "positive": lambda x: x, "both": F.abs}[polarity]
    best = F.array_max(F.transform("wave", lambda x, k: F.struct(size(x).alias("v"), (-k).alias("nk"))))
    at = near.select(*by, F.col("i").alias("spike_i"), "t", (F.col("i") - before - best["nk"]).alias("i"))
    return snippets(df, at, window, window, by).select(*by, F.col("spike_i").alias("i"), "t", F.col("i").alias("centre"), "wave")


def first_samples(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("features", F.slice("wave", 1, k))


def haar(df: DataFrame, k: int, levels: int = 3) -> DataFrame:
    """The first k coefficients of a Haar transform, coarse to fine; an odd level repeats its last sample."""
    def halved(even: Column, details: Column) -> Column:
        half = F.sequence(F.lit(0), (F.size(even) / 2).cast("int") - 1)
        pair = lambda sign: F.transform(half, lambda j: (F.element_at(even, 2 * j + 1) + sign * F.element_at(even, 2 * j + 2)) / F.lit(2.0**0.5))
        return F.struct(pair(1).alias("low"), F.concat(pair(-1), details).alias("details"))

    def level(at: Column, _: Column) -> Column:
        low = at["low"]
        even = F.when(F.size(low) % 2 == 1, F.concat(low, F.slice(low, -1, 1))).otherwise(low)
        return F.element_at(F.transform(F.array(even), lambda x: halved(x, at["details"])), 1)  # made once, not for each use

    wave = F.col("wave").cast("array<double>")
    start = F.struct(wave.alias("low"), F.slice(wave, 1, 0).alias("details"))
    return df.withColumn("features", F.aggregate(F.array(*(F.lit(n) for n in range(levels))), start, level, lambda at: F.slice(F.concat(at["low"], at["details"]), 1, k)))


def principal(df: DataFrame, k: int) -> DataFrame:
    """Uncentred projections on the components of the centred covariance; each component's largest weight is positive."""
    rows = df.withColumn("_v", array_to_vector("wave"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows)
    weights = model.pc.toArray()
    signs = np.sign(weights[np.abs(weights).argmax(axis=0), range(weights.shape[1])])
    flips = F.array(*(F.lit(float(s or 1.0)) for s in signs))
    return model.transform(rows).withColumn("features", F.zip_with(vector_to_array("_p"), flips, lambda x, s: x * s)).drop("_v", "_p")


def independent(df: DataFrame, k: int, by: Sequence[str] = (), seed: int = 1, rounds: int = 200) -> DataFrame:
    """Fixed-point independent components (tanh, symmetric decorrelation) of each group's waveforms; zeros where the
    iteration can't be set up. A group is one channel's spikes."""
    schema = df.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",features:array<double>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["wave"].tolist(), float)
        x = x - x.mean(axis=0)
        try:
            u, s, vt = np.linalg.svd(x, full_matrices=False)
            m = min(k, int((s > 1e-9 * max(s[0], 1e-30)).sum()))
            z = u[:, :m] * np.sqrt(len(x))
            w = np.linalg.qr(np.random.default_rng(seed).normal(size=(m, m)))[0]
            for _ in range(rounds):
                g = np.tanh(z @ w.T)
                new = g.T @ z / len(z) - np.diag((1 - g**2).mean(axis=0)) @ w
                a, _, b = np.linalg.svd(new)
                new = a @ b
                done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < 1e-8
                w = new
                if done:
                    break
            out = np.pad(z @ w.T, ((0, 0), (0, k - m)))
        except (np.linalg.LinAlgError, IndexError):
            out = np.zeros((len(x), k))
        return pdf.assign(features=list(out))

    keys = list(by) or [F.lit("all")]
    return df.groupBy(*keys).applyInPandas(run, schema)


def embedded(df: DataFrame, k: int = 2, by: Sequence[str] = (), perplexity: float = 30.0, rounds: int = 300, seed: int = 1) -> DataFrame:
    """Stochastic neighbour embedding in at most 3 dimensions of each group's waveforms, in one task a group, so groups are
    to be one channel's spikes. Up to neighbours.EXACT spikes by all pairs; above by each one's nearest 3 x perplexity,
    found exactly, and in the plane by interpolated forces, so that memory and a round are linear in the spikes."""
    k = min(k, 3)
    schema = df.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",features:array<double>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["wave"].tolist(), float)
        n = len(x)
        if n < 3:
            return pdf.assign(features=[[0.0] * k] * n)
        y = neighbours.embedded(x, k, perplexity, rounds, seed)
        return pdf.assign(features=y.tolist())

    keys = list(by) or [F.lit("all")]
    return df.groupBy(*keys).applyInPandas(run, schema)


def standardised(df: DataFrame, id_: str = "spike", least: float = 1e-8) -> DataFrame:
    """Features column by column less their mean, by their deviation; a deviation below `least` counts as 1."""
    rows = df.select(id_, F.posexplode("features").alias("k", "v"))
    facts = rows.groupBy("k").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    z = (F.col("v") - F.col("m")) / F.when(F.coalesce(F.col("s"), F.lit(0.0)) < least, 1.0).otherwise(F.col("s"))
    out = rows.join(F.broadcast(facts), "k").groupBy(id_).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", z.alias("z")))), lambda x: x["z"]).alias("features"))
    return df.drop("features").join(out, id_)


def alignment_check(df: DataFrame, id_: str = "spike", most: int = 50, before: str = "raw", after: str = "wave") -> DataFrame:
    """(k, before, after): the mean of the first spikes' waveforms, unaligned and aligned."""
    few = df.orderBy(id_).limit(most).select(F.posexplode(F.arrays_zip(F.col(before).alias("b"), F.col(after).alias("a"))).alias("k", "w"))
    return few.groupBy((F.col("k") + 1).cast("long").alias("k")).agg(F.avg("w.b").alias("before"), F.avg("w.a").alias("after"))
