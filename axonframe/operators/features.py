"""Response features of trials or channels: latency, delay, width, areas, rise, decay, amplitude.

All take (keys, t, y) and look at t >= t0. The extremum and the baselines of a series come from one aggregation; each
feature is then conditional aggregates over the series joined with them. compat: as the established tool computes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import KEYS

DIRECTIONS = ("max", "min")


def _check(direction: str) -> str:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    return direction


def facts(df: DataFrame, t0: float, direction: str = "max", by: Sequence[str] = KEYS) -> DataFrame:
    """(keys, peak, t_peak, t_last, base3, base5): of samples from t0 on. Of equal extrema the first counts; t_last is
    the last one's time. base3 and base5 are means of the first samples."""
    sign = 1 if _check(direction) == "max" else -1
    rows = df.where(F.col("t") >= t0).withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy("t")))
    best = F.max(F.struct((F.col("y") * sign).alias("v"), (-F.col("t")).alias("nt")))
    last = F.max(F.struct((F.col("y") * sign).alias("v"), F.col("t").alias("t")))
    rows = rows.where(F.col("y").isNotNull()).groupBy(*by).agg(best.alias("b"), last.alias("l"), F.avg(F.when(F.col("_k") <= 3, F.col("y"))).alias("base3"), F.avg(F.when(F.col("_k") <= 5, F.col("y"))).alias("base5"))
    return rows.select(*by, (F.col("b.v") * sign).alias("peak"), (-F.col("b.nt")).alias("t_peak"), F.col("l.t").alias("t_last"), "base3", "base5")


def _over(df: DataFrame, t0: float, direction: str, by: Sequence[str]) -> DataFrame:
    """Samples from t0 on beside their series' facts."""
    f = facts(df, t0, direction, by)
    return df.where(F.col("t") >= t0).join(f, list(by))


def _all(df: DataFrame, out: DataFrame, by: Sequence[str], *columns: str) -> DataFrame:
    """A row for every series, NULL where it has no samples from t0 on."""
    return df.select(*by).distinct().join(out, list(by), "left").select(*by, *columns)


def _beyond(level: Column, direction: str) -> Column:
    return F.col("y") >= level if direction == "max" else F.col("y") <= level


def peak_latency(df, t0=0.0, direction="max", by=KEYS) -> DataFrame:
    f = facts(df, t0, direction, by)
    return _all(df, f.select(*by, (F.col("t_peak") - t0).alias("latency"), F.col("peak").alias("peak")), by, "latency", "peak")


def onset_delay(df, t0=0.0, fraction=0.5, direction="max", by=KEYS, compat=False) -> DataFrame:
    """Time to the first sample at base3 + fraction * (peak - base3); compat counts the fraction down from the peak."""
    rows = _over(df, t0, direction, by)
    f = 1 - fraction if compat else fraction
    level = F.col("base3") + f * (F.col("peak") - F.col("base3"))
    return _all(df, rows.groupBy(*by).agg((F.min(F.when(_beyond(level, direction), F.col("t"))) - t0).alias("delay")), by, "delay")


def half_width(df, t0=0.0, direction="max", by=KEYS, compat=False) -> DataFrame:
    """Last less first time at or beyond half of peak and base5; compat takes the latency for the peak."""
    rows = _over(df, t0, direction, by)
    top = F.col("t_peak") - t0 if compat else F.col("peak")
    hit = F.when(_beyond((top + F.col("base5")) / 2, direction), F.col("t"))
    return _all(df, rows.groupBy(*by).agg((F.max(hit) - F.min(hit)).alias("width")), by, "width")


def _trapezoid(df: DataFrame, value: Column, by: Sequence[str], name: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy("t")
    rows = df.withColumn("_z", value)
    step = (F.col("_z") + F.lag("_z").over(w)) / 2 * (F.col("t") - F.lag("t").over(w))
    return rows.withColumn("_a", step).groupBy(*by).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias(name))


def area(df, positive=True, baseline: float | None = None, by=KEYS) -> DataFrame:
    """Trapezoid over the whole trace of what lies above (or below) the baseline, by default the mean of the first
    tenth of the samples; NULL where a tenth is none."""
    n = F.count("*").over(W.partitionBy(*by))
    k = F.row_number().over(W.partitionBy(*by).orderBy("t"))
    rows = df.withColumn("_n", F.round(n / 10)).withColumn("_k", k)
    base = F.lit(float(baseline)) if baseline is not None else F.avg(F.when(F.col("_k") <= F.col("_n"), F.col("y"))).over(W.partitionBy(*by))
    rows = rows.withColumn("_b", base)
    gap = F.col("y") - F.col("_b") if positive else F.col("_b") - F.col("y")
    out = _trapezoid(rows, F.when(F.col("_b").isNotNull(), F.greatest(gap, F.lit(0.0))), by, "_area")
    known = rows.groupBy(*by).agg(F.max("_b").alias("_b"))
    return out.join(known, list(by)).select(*by, F.when(F.col("_b").isNotNull(), F.col("_area")).alias("area"))


def rise_time(df, t0=0.0, direction="max", by=KEYS, compat=False) -> DataFrame:
    """From 10 to 90 % of the way from base5 to the peak, first crossings up to the peak. compat: both levels are
    built from the latency and the largest value, and crossings are searched in the whole trace from t0."""
    rows = _over(df, t0, direction, by)
    if compat:
        lat = F.col("t_peak") - t0
        edge = F.max("y").over(W.partitionBy(*by)) if direction == "max" else F.min("y").over(W.partitionBy(*by))
        rows = rows.withColumn("_d", lat - edge).withColumn("_lo", lat - 0.1 * F.col("_d")).withColumn("_hi", lat - 0.9 * F.col("_d"))
        first = lambda c: F.min(F.when(_beyond(F.col(c), direction), F.col("t")))
    else:
        rows = rows.withColumn("_lo", F.col("base5") + 0.1 * (F.col("peak") - F.col("base5"))).withColumn("_hi", F.col("base5") + 0.9 * (F.col("peak") - F.col("base5")))
        first = lambda c: F.min(F.when(_beyond(F.col(c), direction) & (F.col("t") <= F.col("t_peak")), F.col("t")))
    return _all(df, rows.groupBy(*by).agg((first("_hi") - first("_lo")).alias("rise")), by, "rise")


def decay_time(df, t0=0.0, direction="max", by=KEYS, compat=False) -> DataFrame:
    """From the first peak to the first sample at or below half of peak and base5. compat: half of latency and base5,
    from the last peak ('max'), or strictly behind the first ('min')."""
    rows = _over(df, t0, direction, by)
    top = F.col("t_peak") - t0 if compat else F.col("peak")
    half = (top + F.col("base5")) / 2
    start = F.col("t_last") if compat and direction == "max" else F.col("t_peak")
    later = F.col("t") > start if compat and direction == "min" else F.col("t") >= start
    back = F.col("y") <= half if direction == "max" else F.col("y") >= half
    return _all(df, rows.withColumn("_s", start).groupBy(*by).agg((F.min(F.when(later & back, F.col("t"))) - F.max("_s")).alias("decay")), by, "decay")


def peak_amplitude(df, t0=0.0, direction="max", baseline: float | None = None, by=KEYS) -> DataFrame:
    f = facts(df, t0, direction, by)
    base = F.lit(float(baseline)) if baseline is not None else F.col("base5")
    return _all(df, f.select(*by, (F.col("peak") - base).alias("amplitude"), "t_peak"), by, "amplitude", "t_peak")


def response_integral(df, t0=0.0, by=KEYS) -> DataFrame:
    return _all(df, _trapezoid(df.where(F.col("t") >= t0), F.col("y"), by, "integral"), by, "integral")


def baseline_value(df, window: tuple[float, float] | None = (0.0, 0.05), by=KEYS) -> DataFrame:
    """Mean in the closed window, or in the first 50 ms without their end; NULL where that is empty."""
    first = F.min("t").over(W.partitionBy(*by))
    rows = df.withColumn("_in", F.col("t").between(*window) if window else F.col("t") < first + 0.05)
    return rows.groupBy(*by).agg(F.avg(F.when(F.col("_in"), F.col("y"))).alias("baseline"))


FEATURES = ("latency", "delay", "width", "area_above", "area_below", "rise", "decay", "amplitude", "integral")
#: What a table has unless asked for more.
DEFAULT_FEATURES = ("latency", "width", "area_above", "area_below")


def feature_table(df: DataFrame, selected: Sequence[str] = DEFAULT_FEATURES, t0: float = 0.0, window: tuple[float, float] | None = (0.0, 0.05), by: Sequence[str] = KEYS, compat: bool = False) -> DataFrame:
    """(keys, label, the nine features): those not selected are NULL; areas and amplitude use the baseline window."""
    unknown = set(selected) - set(FEATURES)
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    by = list(by)
    base = baseline_value(df, window, by)
    f = facts(df, t0, "max", by).join(base, by, "right")
    w = W.partitionBy(*by).orderBy("t")
    rows = df.join(f, by).withColumn("_k", F.row_number().over(w))
    late, t, y = F.col("t") >= t0, F.col("t"), F.col("y")
    mid = (F.col("peak") + F.col("base5")) / 2
    lo, hi = (F.col("base5") + q * (F.col("peak") - F.col("base5")) for q in (0.1, 0.9))
    level = F.col("base3") + 0.5 * (F.col("peak") - F.col("base3"))
    step = t - F.lag("t").over(w)
    above, below = F.greatest(y - F.col("baseline"), F.lit(0.0)), F.greatest(F.col("baseline") - y, F.lit(0.0))
    rows = rows.withColumn("_u", above).withColumn("_v", below).withColumn("_step", step)
    half = lambda c: (F.col(c) + F.lag(c).over(w)) / 2 * F.col("_step")
    rows = rows.withColumn("_au", half("_u")).withColumn("_av", half("_v")).withColumn("_ay", F.when(F.lag("t").over(w) >= t0, half("y")))
    first = lambda cond: F.min(F.when(late & cond, t))
    last = lambda cond: F.max(F.when(late & cond, t))
    areas = lambda c: F.when(F.max("baseline").isNotNull(), F.coalesce(F.sum(c), F.lit(0.0)))
    values = {
        "latency": F.max("t_peak") - t0,
        "delay": first(y >= level) - t0,
        "width": last(y >= mid) - first(y >= mid),
        "area_above": areas("_au"),
        "area_below": areas("_av"),
        "rise": first((y >= hi) & (t <= F.col("t_peak"))) - first((y >= lo) & (t <= F.col("t_peak"))),
        "decay": first((y <= mid) & (t >= F.col("t_peak"))) - F.max("t_peak"),
        "amplitude": F.max("peak") - F.max("baseline"),
        "integral": F.when(F.max(F.when(late, 1)).isNotNull(), F.coalesce(F.sum("_ay"), F.lit(0.0))),
    }
    if compat:
        parts = {"delay": onset_delay(df, t0, 0.5, "max", by, True), "width": half_width(df, t0, "max", by, True), "rise": rise_time(df, t0, "max", by, True), "decay": decay_time(df, t0, "max", by, True)}
        out = rows.groupBy(*by).agg(*(v.alias(k) for k, v in values.items() if k not in parts))
        for part in parts.values():
            out = out.join(part, by)
    else:
        out = rows.groupBy(*by).agg(*(v.alias(k) for k, v in values.items()))
    return out.select(*by, *((F.col(c) if c in selected else F.lit(None).cast("double")).alias(c) for c in FEATURES))
