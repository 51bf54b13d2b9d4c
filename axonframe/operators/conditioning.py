"""Decimation, filtering and smoothing of signals.

Recurrences run in an Arrow kernel on sorted whole series; long ones are cut into chunks with a halo, in which the filter
settles, so that one series spreads over tasks. Sums with a fixed reach are windows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from ..model import KEYS, chunked, half_away, own

#: Samples of a chunk; a series up to this length is filtered in one piece.
CHUNK = 4_000_000
#: What a chunk leaves out counts for less than a double resolves, so chunks differ from one piece by rounding only.
UNSEEN = 1e-17


@dataclass(frozen=True)
class Filter:
    """kind: none, low, high, band or stop; family: butterworth, chebyshev or fir."""

    kind: str = "none"
    family: str = "butterworth"
    order: int = 4
    cutoff: float | tuple[float, float] | None = None

    def sections(self, fs: float) -> np.ndarray | None:
        if self.kind == "none":
            return None
        cutoff = dsp.default_cutoff(self.kind, fs) if self.cutoff is None else self.cutoff
        if self.family == "fir":
            return dsp.fir(self.kind, self.order, cutoff, fs)
        if self.family not in ("butterworth", "chebyshev"):
            raise ValueError(f"unknown filter family {self.family!r}")
        return dsp.design(self.kind, self.order, cutoff, fs, dsp.RIPPLE if self.family == "chebyshev" else None)


#: Multi-unit presets.
PRESETS = {"standard": Filter("band", "butterworth", 4, (300.0, 3000.0)), "broadband": Filter("band", "butterworth", 4, (500.0, 5000.0))}


def halo(coefficients: np.ndarray, tolerance: float = UNSEEN) -> int:
    """Samples after which what lies further back counts for less than the tolerance."""
    if coefficients.ndim == 1:
        return 2 * len(coefficients)
    radius = max(np.abs(np.roots(s[3:])).max() for s in coefficients)
    return int(np.ceil(np.log(tolerance) / np.log(min(radius, 1 - 1e-7)))) + 8


def filtered(df: DataFrame, coefficients: np.ndarray | None, by: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """(keys, i, t, y) filtered forward and backward. NULL samples take the value before them.

    A sample near a chunk's edge is sent to the neighbour too, as part of its halo; a chunk is no shorter than its halo.
    """
    rows = df.select(*by, "i", "t", "y")
    if coefficients is None:
        return rows
    reach, names, keys = halo(coefficients), [*by, "i", "t", "y"], [*by, "_c"]
    chunk = max(chunk, reach)
    c = F.floor((F.col("i") - 1) / chunk)
    near = F.array_distinct(F.array(c, F.greatest(F.floor((F.col("i") - 1 - reach) / chunk), F.lit(0)), F.floor((F.col("i") - 1 + reach) / chunk)))
    rows = rows.withColumn("_c", F.explode(near))

    def whole_series(table: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
        """The complete series of sorted rows, filtered, and the rows of one that may go on."""
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for name in keys:
            codes = table[name].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        ends = np.append(np.flatnonzero(new)[1:], table.num_rows)
        ends = ends if last else ends[:-1]
        cut = int(ends[-1]) if len(ends) else 0
        y, out, first = table["y"].to_numpy().astype(float), np.empty(cut), 0
        for end in ends.tolist():
            x = held(y[first:end])
            out[first:end] = dsp.zero_phase_fir(coefficients, x) if coefficients.ndim == 1 else dsp.zero_phase(coefficients, x)
            first = end
        done = table.slice(0, cut)
        own = (done["i"].to_numpy() - 1) // chunk == done["_c"].to_numpy()
        done = done.select(names).set_column(len(names) - 1, "y", pa.array(out, from_pandas=True))
        return done.filter(pa.array(own)), table.slice(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if open_ is None else pa.concat_tables([open_, table])
            if table.num_rows:
                done, open_ = whole_series(table, False)
                yield from done.to_batches()
        if open_ is not None and open_.num_rows:
            yield from whole_series(open_, True)[0].to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "i")
    return rows.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


def held(x: np.ndarray) -> np.ndarray:
    """x with missing samples as the one before them, at the start as the first that there is."""
    gone = np.isnan(x)
    if not gone.any() or gone.all():
        return x
    at = np.maximum.accumulate(np.where(gone, -1, np.arange(len(x))))
    return x[np.where(at < 0, np.flatnonzero(~gone)[0], at)]


def decimated(df: DataFrame, n: int, by: Sequence[str] = KEYS) -> DataFrame:
    """Every n-th sample from the first on, renumbered; nothing is smoothed."""
    if n < 1:
        raise ValueError("the factor must be at least 1")
    return df.where((F.col("i") - 1) % n == 0).withColumn("i", F.floor((F.col("i") - 1) / n) + 1)


def decimated_smoothly(df: DataFrame, fs: float, target: float, by: Sequence[str] = KEYS, compat: bool = False) -> tuple[DataFrame, float]:
    """Low-passed at 0.8 of the new Nyquist (4th order), then every round(fs / target)-th sample. The new rate is
    fs / factor; compat: the target, whatever the factor."""
    n = half_away(fs / target)
    if n <= 1:
        return df, fs
    smooth = filtered(df, dsp.design("low", 4, 0.8 * target / 2, fs), by)
    rate = target if compat else fs / n
    return decimated(smooth, n, by).withColumn("t", (F.col("i") - 1) / F.lit(float(rate))), rate


def lfp(df: DataFrame, fs: float, target: float, low_pass: float, line: float | None = 60.0, by: Sequence[str] = KEYS) -> tuple[DataFrame, float]:
    """Decimation, then a low-pass if its cutoff is within the new band, then the line notch."""
    out, rate = decimated_smoothly(df, fs, target, by)
    if 0 < low_pass < rate / 2:
        out = filtered(out, dsp.design("low", 4, low_pass, rate), by)
    if line and line < rate / 2:
        out = filtered(out, dsp.notch(line, rate), by)
    return out, rate


def multi_unit(df: DataFrame, fs: float, spec: Filter = PRESETS["standard"], smooth_ms: float | None = None, by: Sequence[str] = KEYS) -> DataFrame:
    """Band-passed, not rectified, then smoothed."""
    return boxcar(filtered(df, spec.sections(fs), by), box_width(fs, smooth_ms), by)


def flow(df: DataFrame, fs: float, factor: int, spec: Filter, by: Sequence[str] = KEYS) -> DataFrame:
    """Plain decimation, then the filter at the lower rate."""
    return filtered(decimated(df, factor, by), spec.sections(fs / factor), by)


def box_width(fs: float, ms: float | None = None) -> int:
    return max(1, half_away((2.0 if ms is None else ms) / 1000 * fs))


def boxcar(df: DataFrame, width: int, by: Sequence[str] = KEYS) -> DataFrame:
    """Moving sum over `width` samples by `width`, also at the ends; an even width reaches one further ahead."""
    back, ahead = width - 1 - width // 2, width // 2
    rows, w = chunked(df, by, back, ahead)
    return own(rows.withColumn("y", F.sum("y").over(w.rowsBetween(-back, ahead)) / width), back, ahead)


def convolved(df: DataFrame, taps: Sequence[float], by: Sequence[str] = KEYS) -> DataFrame:
    """One causal pass of taps, as a sum of lags; before the first sample there is nothing."""
    rows, w = chunked(df, by, len(taps) - 1, 0)
    total = F.lit(0.0)
    for k, c in enumerate(taps):
        total = total + F.lit(float(c)) * F.coalesce(F.lag("y", k).over(w) if k else F.col("y"), F.lit(0.0))
    return own(rows.withColumn("y", total), len(taps) - 1, 0)


def frequency_response(spark, sos: np.ndarray, fs: float, points: int = 1024) -> DataFrame:
    """(k, hz, gain, phase) of sections at `points` frequencies from 0 below Nyquist."""
    w = F.col("id") * F.lit(np.pi / points)
    gain, phase = F.lit(1.0), F.lit(0.0)
    for s in sos:
        parts = []
        for x in (s[:3], s[3:]):
            re = F.lit(float(x[0])) + F.lit(float(x[1])) * F.cos(w) + F.lit(float(x[2])) * F.cos(2 * w)
            im = -(F.lit(float(x[1])) * F.sin(w) + F.lit(float(x[2])) * F.sin(2 * w))
            parts.append((F.sqrt(re * re + im * im), F.atan2(im, re)))
        gain, phase = gain * parts[0][0] / parts[1][0], phase + parts[0][1] - parts[1][1]
    return spark.range(points).select(F.col("id").alias("k"), (F.col("id") * F.lit(fs / 2 / points)).alias("hz"), gain.alias("gain"), phase.alias("phase"))
