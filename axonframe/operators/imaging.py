"""Image stacks: regions, lines, movement, relative fluorescence, kymographs, vessels, smoothing, normalisation.

A stack is (frame, row, col, v), all counted from 1, with a colour channel c where there is one. Frames, pixels and
lines are keys, so work spreads over frames or pixels; only per-frame kernels gather a frame.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..model import half_away


EPS = 2.0**-52


def masked(stack: DataFrame, mask: DataFrame | Column) -> DataFrame:
    """Pixels inside a region: a predicate, or a table (row, col) of the pixels."""
    if isinstance(mask, Column):
        return stack.where(mask)
    return stack.join(mask.select("row", "col"), ["row", "col"], "left_semi")


def roi_intensity(stack: DataFrame, mask) -> DataFrame:
    return masked(stack, mask).groupBy("frame").agg(F.avg("v").alias("value"))


def roi_movement(stack: DataFrame, mask, method: str = "diff") -> DataFrame:
    """(frame, value): mean difference from the frame before (NULL for the first), or the frame's variance."""
    inside = masked(stack, mask)
    if method == "variance":
        return inside.groupBy("frame").agg(F.var_samp("v").alias("value"))
    if method != "diff":
        raise ValueError(f"unknown method {method!r}")
    return inside.withColumn("_d", F.abs(F.col("v") - F.lag("v").over(W.partitionBy("row", "col").orderBy("frame")))).groupBy("frame").agg(F.avg("_d").alias("value"))


def roi_frame_difference(stack: DataFrame, mask) -> DataFrame:
    """What is offered as flow speed: the mean difference from the frame before."""
    return roi_movement(stack, mask, "diff")


def relative_change(trace: DataFrame, mode: str = "first", n: int = 30, percentile: float = 10.0, window: float = 30.0, by: Sequence[str] = ("roi",)) -> DataFrame:
    """(v - F0) / (F0 + eps) of traces (by, frame, v). F0: the mean of the first n frames, a percentile, the mean, or
    a centred moving median that shrinks at the ends. Unknown modes are `first` with 30."""
    by = list(by)
    if mode == "percentile":
        rows = trace.join(stats.hazen(trace, "v", percentile, by, "_f"), by)
    elif mode == "mean":
        rows = trace.withColumn("_f", F.avg("v").over(W.partitionBy(*by)))
    elif mode == "rolling":
        w = max(1, half_away(window))
        back, ahead = (w // 2, w // 2) if w % 2 else (w // 2, w // 2 - 1)
        rows = trace.withColumn("_f", F.percentile("v", 0.5).over(W.partitionBy(*by).orderBy("frame").rowsBetween(-back, ahead)))
    else:
        n = n if mode == "first" else 30
        k = F.row_number().over(W.partitionBy(*by).orderBy("frame"))
        rows = trace.withColumn("_k", k).withColumn("_f", F.avg(F.when(F.col("_k") <= n, F.col("v"))).over(W.partitionBy(*by))).drop("_k")
    return rows.withColumn("v", (F.col("v") - F.col("_f")) / (F.col("_f") + EPS)).drop("_f")


def line_points(x1: float, y1: float, x2: float, y2: float, width: int, height: int) -> list[tuple[int, float, float]]:
    """(p, x, y): points along a line, at least two, clamped to the image."""
    n = max(half_away(math.hypot(x2 - x1, y2 - y1)), 2)
    at = [k / (n - 1) for k in range(n)]
    return [(k + 1, min(max(x1 + (x2 - x1) * a, 1.0), float(width)), min(max(y1 + (y2 - y1) * a, 1.0), float(height))) for k, a in enumerate(at)]


def kymograph(stack: DataFrame, line: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """(frame, p, pos_px, pos_frac, v): bilinear samples along a line; missing pixels count as 0."""
    points = line_points(*line, width, height)
    n, taps = len(points), []
    for p, x, y in points:
        x0, y0 = min(int(x), max(width - 1, 1)), min(int(y), max(height - 1, 1))
        fx, fy = x - x0, y - y0
        taps += [(p, y0 + dy, x0 + dx, (fx if dx else 1 - fx) * (fy if dy else 1 - fy)) for dx in (0, 1) for dy in (0, 1) if (fx if dx else 1 - fx) * (fy if dy else 1 - fy)]
    weights = stack.sparkSession.createDataFrame(taps, "p long, row long, col long, w double")  # 4 rows a point of one line
    rows = stack.join(F.broadcast(weights), ["row", "col"]).groupBy("frame", "p").agg(F.sum(F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0)) * F.col("w")).alias("v"))
    return rows.select("frame", "p", (F.col("p") - 1).alias("pos_px"), ((F.col("p") - 1) / F.lit(float(max(n - 1, 1)))).alias("pos_frac"), "v")


def _gradient(value: str, w: W) -> Column:
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)


def propagation(kymo: DataFrame, method: str = "maxgrad", compat: bool = False, least: int = 10) -> DataFrame:
    """One row (slope, angle, score), NULLs if the kymograph has under two frames or points.

    maxgrad: minus the mean time gradient by the mean space gradient, pixels a frame (compat: the reciprocal);
    correlation: the frame most like the mean profile; others: the diagonal of largest variance with `least` points.
    """
    shape = kymo.agg(F.countDistinct("p").alias("_ns"), F.countDistinct("frame").alias("_nt"), F.min("frame").alias("_f0"))
    if method == "maxgrad":
        across, along = W.partitionBy("p").orderBy("frame"), W.partitionBy("frame").orderBy("p")
        g = kymo.withColumn("_gt", _gradient("v", across)).withColumn("_gs", _gradient("v", along)).agg(F.avg("_gt").alias("gt"), F.avg("_gs").alias("gs"))
        a, b = ("gs", "gt") if compat else ("gt", "gs")
        out = g.select(F.when(F.col(b) != 0, -F.col(a) / F.col(b)).alias("slope"), F.lit(None).cast("double").alias("score"))
    elif method == "correlation":
        mean = kymo.groupBy("p").agg(F.avg("v").alias("m"))
        r = kymo.join(F.broadcast(mean), "p").groupBy("frame").agg(F.corr("v", "m").alias("r")).where(F.col("r").isNotNull() & ~F.isnan("r"))
        best = r.agg(F.max(F.struct(F.round("r", 12).alias("r"), (-F.col("frame")).alias("nf"))).alias("b"))
        out = best.crossJoin(F.broadcast(shape)).select(((-F.col("b.nf") - F.col("_f0")) / F.col("_nt") * F.col("_ns")).alias("slope"), F.col("b.r").alias("score"))  # one row each
    else:
        rows = kymo.crossJoin(F.broadcast(shape)).withColumn("_d", F.col("frame") - F.col("_f0") + 1 - F.col("p"))  # shape is one row
        best = rows.groupBy("_d").agg(F.count("*").alias("n"), F.var_samp("v").alias("var")).where(F.col("n") >= least).agg(F.max(F.struct(F.round("var", 12).alias("var"), (-F.col("_d")).alias("nd"))).alias("b"))
        out = best.crossJoin(F.broadcast(shape)).select((-F.col("b.nd") / F.col("_nt")).alias("slope"), F.col("b.var").alias("score"))
    ok = (F.col("_ns") >= 2) & (F.col("_nt") >= 2)
    return out.crossJoin(F.broadcast(shape)).select(F.when(ok, F.col("slope")).alias("slope"), F.when(ok, F.atan("slope")).alias("angle"), F.when(ok, F.col("score")).alias("score"))


def vessel_diameter(kymo: DataFrame, length: float, polarity: str = "dark", method: str = "fwhm") -> DataFrame:
    """(frame, diameter): the span of samples at or beyond half depth, in the line's units; NULL for a flat profile.
    fwhm needs two samples."""
    w = W.partitionBy("frame")
    low, high = F.min("v").over(w), F.max("v").over(w)
    unit = F.when(high > low, (F.col("v") - low) / (high - low))
    depth = 1 - unit if polarity == "dark" else unit
    hit = F.when(F.col("_z") >= 0.5, F.col("p"))
    rows = kymo.withColumn("_z", depth).groupBy("frame").agg(F.max(hit).alias("b"), F.min(hit).alias("a"), F.count(hit).alias("n"), F.count("*").alias("points"))
    enough = F.col("n") >= (2 if method == "fwhm" else 1)
    return rows.select("frame", F.when(enough, (F.col("b") - F.col("a") + 1) * F.lit(float(length)) / F.col("points")).alias("diameter"))


def gray256(stack: DataFrame, already: bool = False) -> DataFrame:
    """Global min-max to whole numbers 0..255; colour by luma; a constant stack is 0; 8-bit input passes."""
    if already:
        return stack.withColumn("v", F.col("v").cast("short"))
    if "c" in stack.columns:
        weight = F.element_at(F.array(F.lit(0.2989), F.lit(0.5870), F.lit(0.1140)), F.col("c").cast("int"))
        stack = stack.groupBy("frame", "row", "col").agg(F.sum(F.col("v") * weight).alias("v"))
    ends = stack.agg(F.min("v").alias("_a"), F.max("v").alias("_b"))
    scaled = F.when(F.col("_b") > F.col("_a"), F.round((F.col("v") - F.col("_a")) * 255 / (F.col("_b") - F.col("_a")))).otherwise(0)
    return stack.crossJoin(F.broadcast(ends)).withColumn("v", scaled.cast("short")).drop("_a", "_b")  # ends is one row


def gaussian_weights(sigma: float) -> list[float]:
    """Odd kernel of 2 * ceil(2 sigma) + 1 samples, of sum 1."""
    r = math.ceil(2 * sigma)
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def _per_frame(stack: DataFrame, kernel) -> DataFrame:
    keys = ["frame", "c"] if "c" in stack.columns else ["frame"]
    kinds = {f.name: f.dataType.simpleString() for f in stack.schema.fields} | {"v": "double"}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(int) - 1, pdf["col"].to_numpy(int) - 1
        image = np.zeros((r.max() + 1, c.max() + 1))
        image[r, c] = pdf["v"]
        return pdf.assign(v=kernel(image)[r, c])

    return stack.groupBy(*keys).applyInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in stack.columns))


def gaussian_smooth(stack: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Separable, edges repeated, each frame (and colour) by itself: weighted lags along rows, then along columns."""
    weights, keys = gaussian_weights(sigma), ["frame", "c"] if "c" in stack.columns else ["frame"]
    reach = len(weights) // 2
    for along, across in (("col", "row"), ("row", "col")):
        w = W.partitionBy(*keys, across).orderBy(along)
        all_ = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        stack = stack.withColumn("_a", F.first("v").over(all_)).withColumn("_b", F.last("v").over(all_))
        total = F.col("v") * F.lit(weights[reach])
        for k in range(1, reach + 1):
            total = total + (F.coalesce(F.lag("v", k).over(w), F.col("_a")) + F.coalesce(F.lead("v", k).over(w), F.col("_b"))) * F.lit(weights[reach + k])
        stack = stack.withColumn("v", total).drop("_a", "_b")
    return stack


def median_smooth(stack: DataFrame, size: int = 3) -> DataFrame:
    """Median of size x size pixels, zeros beyond the edges."""
    before, after = (size - 1) // 2, size // 2

    def kernel(image: np.ndarray) -> np.ndarray:
        wide = np.pad(image, ((before, after), (before, after)))
        return np.median(np.lib.stride_tricks.sliding_window_view(wide, (size, size)).reshape(*image.shape, -1), axis=-1)

    return _per_frame(stack, kernel)


def normalised(stack: DataFrame, mode: str = "frame", low: float = 1.0, high: float = 99.0) -> DataFrame:
    """minmax: over the stack, not clipped; percentile: clipped to 0..1; frame: each frame's range, constant ones 0."""
    if mode == "frame":
        w = W.partitionBy("frame")
        a, b = F.min("v").over(w), F.max("v").over(w)
        return stack.withColumn("v", F.when(b > a, (F.col("v") - a) / (b - a)).otherwise(0.0))
    if mode == "minmax":
        ends = stack.agg(F.min("v").alias("_a"), F.max("v").alias("_b"))
        return stack.crossJoin(F.broadcast(ends)).withColumn("v", (F.col("v") - F.col("_a")) / (F.col("_b") - F.col("_a") + EPS)).drop("_a", "_b")  # one row
    if mode == "percentile":
        a, b = stats.hazen(stack, "v", low, (), "_a"), stats.hazen(stack, "v", high, (), "_b")
        unit = (F.col("v") - F.col("_a")) / (F.col("_b") - F.col("_a") + EPS)
        return stack.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)).withColumn("v", F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0))).drop("_a", "_b")  # one row each
    raise ValueError(f"unknown mode {mode!r}")


def prepared(stack: DataFrame, to_gray: bool = True, smooth: bool = True, normalise: bool = True, sigma: float = 2.0) -> DataFrame:
    """256 levels, then smoothing, then per-frame range; each optional."""
    if to_gray:
        stack = gray256(stack).withColumn("v", F.col("v").cast("double"))
    if smooth:
        stack = gaussian_smooth(stack, sigma)
    return normalised(stack, "frame") if normalise else stack


#: Analyses by name: those of a region take (stack, mask), those of a line (stack, line, width, height).
REGION = {"intensity": roi_intensity, "movement": roi_movement, "variance": lambda s, m: roi_movement(s, m, "variance"), "flow": roi_frame_difference}
LINE = {"kymograph": kymograph}


def analyse(name: str, stack: DataFrame, mask=None, line=None, width: int = 0, height: int = 0, **options) -> DataFrame:
    if name in REGION:
        if mask is None:
            raise ValueError(f"{name} needs a region")
        return REGION[name](stack, mask)
    if name in ("relative change", "dff"):
        if mask is None:
            raise ValueError(f"{name} needs a region")
        trace = roi_intensity(stack, mask).select(F.lit(1).alias("roi"), "frame", F.col("value").alias("v"))
        return relative_change(trace, **options)
    if line is None:
        raise ValueError(f"{name} needs a line")
    kymo = kymograph(stack, line, width, height)
    if name == "kymograph":
        return kymo
    if name == "propagation":
        return propagation(kymo, **options)
    if name == "diameter":
        return vessel_diameter(kymo, math.hypot(line[2] - line[0], line[3] - line[1]), **options)
    raise ValueError(f"unknown analysis {name!r}")


