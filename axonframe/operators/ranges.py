"""Cropping, ranges, regions and time axes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, half_away, whole


def check_range(start, end, duration) -> tuple[bool, str]:
    """Whether [start, end] is a range inside [0, duration], and why not."""
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in (start, end)):
        return False, "start and end must be numbers"
    if math.isnan(start) or math.isnan(end):
        return False, "start and end must not be NaN"
    if start >= end:
        return False, "start must be below end"
    if start < 0:
        return False, "start must not be negative"
    if end > duration:
        return False, "end must not exceed the duration"
    return True, ""


def seconds_to_samples(start: float, end: float, fs: float) -> tuple[int, int]:
    return half_away(start * fs), half_away(end * fs)


def sorted_pair(a: float, b: float) -> tuple[float, float]:
    return min(a, b), max(a, b)


def crop(df: DataFrame, start: int, end: int, fs: float, by: Sequence[str] = KEYS, length: Column | None = None) -> DataFrame:
    """Samples start..end of each series, both within; bounds are clamped, a reversed range is the whole series. Time
    starts anew at 0. `length`: samples that count, by default the series' own."""
    n = length if length is not None else F.max("i").over(whole(by))
    low, high = F.greatest(F.lit(start), F.lit(1)), F.least(F.lit(end), n)
    rows = df.withColumn("_low", F.when(low > high, 1).otherwise(low)).withColumn("_high", F.when(low > high, n).otherwise(high))
    rows = rows.where(F.col("i").between(F.col("_low"), F.col("_high"))).withColumn("i", F.col("i") - F.col("_low") + 1)
    return rows.withColumn("t", (F.col("i") - 1) / F.lit(float(fs))).drop("_low", "_high")


def crop_pair(stim: DataFrame, flow: DataFrame, start: int, end: int, fs: float, by: Sequence[str] = KEYS) -> DataFrame:
    """(keys, i, t, stim, flow): both cropped by one range, within the shorter of the two."""
    lengths = stim.groupBy(*by).agg(F.max("i").alias("_n1")).join(flow.groupBy(*by).agg(F.max("i").alias("_n2")), list(by))
    lengths = lengths.select(*by, F.least("_n1", "_n2").alias("_n"))
    both = stim.select(*by, "i", F.col("y").alias("stim")).join(flow.select(*by, "i", F.col("y").alias("flow")), [*by, "i"]).join(lengths, list(by))
    low = F.least(F.greatest(F.lit(start), F.lit(1)), F.col("_n"))
    high = F.least(F.col("_n"), F.greatest(F.lit(end), low))
    rows = both.withColumn("_low", low).where(F.col("i").between(F.col("_low"), high))
    i = F.col("i") - F.col("_low") + 1
    return rows.select(*by, i.alias("i"), ((i - 1) / F.lit(float(fs))).alias("t"), "stim", "flow")


def channels(df: DataFrame, chosen: Sequence[int]) -> DataFrame:
    return df.where(F.col("channel").isin(list(chosen)))


def time_slice(df: DataFrame, a: float, b: float) -> DataFrame:
    return df.where(F.col("t").between(a, b))


def rebased(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Time from the first sample that is left."""
    return df.withColumn("t", F.col("t") - F.min("t").over(whole(by)))


def after(df: DataFrame, t0: float) -> DataFrame:
    return df.where(F.col("t") >= t0)


def above(df: DataFrame, threshold: float, value: str = "y") -> DataFrame:
    return df.withColumn("above", F.col(value) > threshold)


def rectangle(x: float, y: float, w: float, h: float, width: int, height: int) -> Column:
    """Which pixels a rectangle holds: rounded corners, both within, clamped to the image. x runs along columns."""
    x1, y1 = half_away(x), half_away(y)
    x2, y2 = half_away(x + w), half_away(y + h)
    clamp = lambda v, n: max(1, min(n, v))
    return F.col("col").between(clamp(x1, width), clamp(x2, width)) & F.col("row").between(clamp(y1, height), clamp(y2, height))


def gray(df: DataFrame) -> DataFrame:
    """(frame, row, col, v): the plain mean over colour channels c."""
    return df.groupBy("frame", "row", "col").agg(F.avg("v").alias("v"))


def sample_axis(spark, n: int, fs: float) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("i"), ((F.col("id") - 1) / F.lit(float(fs))).alias("t"))


def trial_axis(spark, pre: int, post: int, fs: float) -> DataFrame:
    return spark.range(1, pre + post + 2).select(F.col("id").alias("i"), ((F.col("id") - 1 - pre) / F.lit(float(fs))).alias("t"))


def linear_axis(spark, a: float, b: float, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("i"), (F.lit(a) + (F.col("id") - 1) * ((b - a) / (n - 1))).alias("t"))
