"""Operators over unbounded recordings: rates by window, debounced onsets, causal filters, bursts, SQL views.

Streams are (channel, ts, i, y) or spikes (channel, ts). Late spikes are bounded by watermarks. Rules that depend on the
order of samples take a channel's samples in the order of i: within a micro-batch they are sorted, and a sample that
comes after a later one of an earlier batch is left out. State is one small record a channel, which goes where a channel
is silent for the time `idle`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import dsp, scan


def windowed_rate(spikes: DataFrame, size: str = "10 seconds", slide: str | None = None, late: str = "1 minute", by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """(by, start, end, n): spikes in tumbling or sliding windows. Works on streams and on tables."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return spikes.withWatermark("ts", late).groupBy(*by, w.alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def bursts(spikes: DataFrame, gap: str = "5 seconds", late: str = "1 minute", by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """(by, start, end, n): sessions of spikes with no pause longer than the gap."""
    return spikes.withWatermark("ts", late).groupBy(*by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _stateful(stream: DataFrame, kernel, kinds: str, state_kinds: str, idle: str | None) -> DataFrame:
    """kernel(i, y, state or None) to (i, columns.., state) on a channel's new samples, sorted."""
    names = [k.split()[0] for k in kinds.split(", ")]
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values("i")
        last, *rest = state.get if state.exists else (None,)
        if last is not None:
            pdf = pdf[pdf["i"] > last]
        if len(pdf):
            *columns, after = kernel(pdf["i"].to_numpy("int64"), pdf["y"].to_numpy(float), rest or None)
            state.update((int(pdf["i"].iloc[-1]), *after))
            yield pd.DataFrame({"channel": key[0]} | dict(zip(names[1:], columns, strict=True)))
        if idle:
            state.setTimeoutDuration(idle)

    return stream.groupBy("channel").applyInPandasWithState(run, kinds, "at long, " + state_kinds, "append", timeout)


def debounced_onsets(stream: DataFrame, threshold: float, samples: int, idle: str | None = None) -> DataFrame:
    """(channel, i): onsets a gap apart, by the same greedy rule as in batch; the state is (was above, last kept)."""
    def kernel(i, y, state):
        was, last = state or (False, None)
        up = y > threshold
        edges = i[up & ~np.concatenate(([was], up[:-1]))]
        kept, last = scan.spaced(edges, edges, samples, last)
        return edges[kept], (bool(up[-1]), last)

    return _stateful(stream, kernel, "channel long, i long", "was boolean, last long", idle)


def causal_filter(stream: DataFrame, sos: np.ndarray, idle: str | None = None) -> DataFrame:
    """(channel, i, y): one forward pass of second-order sections whose state is carried from batch to batch."""
    def kernel(i, y, state):
        z, out = (list(state[0]) if state else [0.0] * (2 * len(sos))), y
        for k, section in enumerate(sos):
            out, z[2 * k], z[2 * k + 1] = dsp.passed(section, out, z[2 * k], z[2 * k + 1])
        return i, out, ([float(x) for x in z],)

    return _stateful(stream, kernel, "channel long, i long, y double", "z array<double>", idle)


def register_views(**tables: DataFrame) -> None:
    """Makes tables readable by name in spark.sql."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
