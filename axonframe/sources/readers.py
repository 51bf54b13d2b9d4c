"""Readers: stored exports and series to the engine's logical tables, with the checks that loading makes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import KEYS, require

DEFAULT_FS, STIM_CHANNEL, FLOW_CHANNEL = 1000.0, 6, 8
#: Optional per-channel facts that a load carries along where the export has them.
METADATA = ("title", "unit", "rangemin", "rangemax", "firstsampleoffset", "blocktimes", "com", "comtext", "tickrate")


def validate_export(block: DataFrame | None, index: DataFrame | None) -> bool:
    """Whether the two tables are an export: numeric samples by position, integer slices by channel."""
    if block is None or index is None:
        return False
    kinds = {f.name: f.dataType for f in [*block.schema.fields, *index.schema.fields]}
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return all(isinstance(kinds.get(c), whole) for c in ("pos", "start", "end", "channel")) and isinstance(kinds.get("v"), T.NumericType)


def channel_slice(block: DataFrame, index: DataFrame, channels: Sequence[int] | None = None) -> DataFrame:
    """(channel, i, y): each channel's closed slice of the flat vector.

    Slices are cut into spans of equal length, so the range join is an equality on the span with a test inside; the
    index has a row a channel and is what gets exploded.
    """
    span = 1 << 20
    index = require(index, "channel", "start", "end")
    if channels is not None:
        index = index.where(F.col("channel").isin(list(channels)))
    spans = index.select("channel", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor(F.col("end") / span))).alias("span"))
    rows = block.withColumn("span", F.floor(F.col("pos") / span)).join(spans, "span").where(F.col("pos").between(F.col("start"), F.col("end")))
    return rows.select("channel", (F.col("pos") - F.col("start") + 1).alias("i"), F.col("v").cast("double").alias("y"))


def sampling_rate(index: DataFrame, stim: int, flow: int, default: float = DEFAULT_FS) -> DataFrame:
    """One row (stim_fs, flow_fs, fs, differ): the flow channel's rate holds; `differ` is the warning."""
    rate = lambda c: F.max(F.when(F.col("channel") == c, F.col("fs")))
    row = index.agg(rate(stim).alias("stim_fs"), rate(flow).alias("flow_fs"))
    return row.select(
        F.coalesce("stim_fs", F.lit(default)).alias("stim_fs"),
        F.coalesce("flow_fs", F.lit(default)).alias("flow_fs"),
        F.coalesce("flow_fs", F.lit(default)).alias("fs"),
        (F.coalesce("stim_fs", F.lit(default)) != F.coalesce("flow_fs", F.lit(default))).alias("differ"),
    )


def metadata(index: DataFrame) -> DataFrame:
    """The optional facts that this export has."""
    return index.select("channel", *(c for c in METADATA if c in index.columns))


def load_export(block: DataFrame, index: DataFrame, stim: int = STIM_CHANNEL, flow: int = FLOW_CHANNEL, compat: bool = False) -> DataFrame:
    """(i, t, stim, flow): two channels of an export side by side. Checks come first, so a refused load changes nothing."""
    if not validate_export(block, index):
        raise ValueError("not an export: samples and channel slices are needed")
    have = {r["channel"] for r in index.where(F.col("channel").isin(stim, flow)).select("channel").collect()}  # two rows at most
    if {stim, flow} - have and not compat:
        raise ValueError(f"no such channel: {sorted({stim, flow} - have)}")
    cut = channel_slice(block, index, (stim, flow))
    both = cut.groupBy("i").agg(F.max(F.when(F.col("channel") == stim, F.col("y"))).alias("stim"), F.max(F.when(F.col("channel") == flow, F.col("y"))).alias("flow"))
    fs = sampling_rate(index, stim, flow).select("fs")
    return both.crossJoin(F.broadcast(fs)).select("i", ((F.col("i") - 1) / F.col("fs")).alias("t"), "stim", "flow")  # fs is one row


def union_trials(trials: DataFrame, file: str = "file") -> DataFrame:
    """Trials of several files under new running numbers; files whose time axis differs from the first file's go.

    An axis is compared by a digest of its (i, t) pairs, an order-free sum, so no axis is gathered.
    """
    axis = trials.groupBy(file, "i").agg(F.first("t_rel").alias("t")).groupBy(file).agg(F.count("*").alias("n"), F.sum(F.xxhash64("i", "t").cast("decimal(38,0)")).alias("digest"))
    first = axis.orderBy(file).limit(1).select(F.col("n").alias("n0"), F.col("digest").alias("digest0"))
    good = axis.crossJoin(F.broadcast(first)).where((F.col("n") == F.col("n0")) & (F.col("digest") == F.col("digest0"))).select(file)
    each = trials.select(file, "trial").distinct().join(good, file)
    starts = each.groupBy(file).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(W.orderBy(file).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row a file
    numbers = each.join(starts, file).withColumn("unit", (F.col("start") + F.row_number().over(W.partitionBy(file).orderBy("trial"))).cast("long"))
    return trials.join(numbers, [file, "trial"]).select(F.col("unit").alias("trial"), "i", "t_rel", "y")


def inferred_rate(df: DataFrame, by: Sequence[str] = KEYS, default: float = DEFAULT_FS) -> DataFrame:
    """(keys, fs): one over the first time step; the default where there is none."""
    two = df.where(F.col("i") <= 2).groupBy(*by).agg(F.max(F.when(F.col("i") == 1, F.col("t"))).alias("a"), F.max(F.when(F.col("i") == 2, F.col("t"))).alias("b"))
    return two.select(*by, F.when(F.col("b") > F.col("a"), 1 / (F.col("b") - F.col("a"))).otherwise(F.lit(default)).alias("fs"))


def typed_view(df: DataFrame, kind: str) -> DataFrame:
    """(unit, i, t, y) of trials, of the mean over channels, or of any series with t and one of y, flow, lfp."""
    if kind == "trials":
        return require(df, "trial", "t_rel", "y").select(F.col("trial").alias("unit"), "i", F.col("t_rel").alias("t"), "y")
    if kind == "mean":
        value = next((c for c in ("lfp", "y") if c in df.columns), None)
        time = next((c for c in ("t", "t_lfp") if c in df.columns), None)
        if not value or not time:
            raise ValueError("a response needs t or t_lfp, and lfp or y")
        return df.groupBy("i").agg(F.first(time).alias("t"), F.avg(value).alias("y")).select(F.lit(1).cast("long").alias("unit"), "i", "t", "y")
    value = next((c for c in ("y", "flow", "lfp") if c in df.columns), None)
    if not value or "t" not in df.columns:
        raise ValueError("a series needs t, and y, flow or lfp")
    return df.select(F.lit(1).cast("long").alias("unit"), "i", "t", F.col(value).alias("y"))


def default_selection(df: DataFrame, most: int = 4) -> DataFrame:
    """The first channels, as a reader preselects them."""
    chosen = df.select("channel").distinct().orderBy("channel").limit(most)
    return df.join(F.broadcast(chosen), "channel")


def read_recording(spark: SparkSession, path: str, channels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A stored recording (channel, i, t, y) and its stimulus (channel, i, t, y): `data`, partitioned by channel, and
    `stim` under the path; a stimulus that isn't stored is an empty table. `channels`: only so many, the first."""
    data = spark.read.parquet(f"{path}/data")
    data = data.select(F.col("channel").cast("long").alias("channel"), "i", "t", "y")
    if channels is not None:
        data = default_selection(data, channels)
    try:
        stim = spark.read.parquet(f"{path}/stim").select("channel", "i", "t", "y")
    except AnalysisException:
        stim = data.limit(0)
    return data, stim


def time_or_frame(df: DataFrame, times: DataFrame | None, frame: str = "frame") -> DataFrame:
    """df with t: the time of its frame, or the frame's number where the times don't match the frames in count."""
    if times is None:
        return df.withColumn("t", F.col(frame).cast("double"))
    n = df.agg(F.countDistinct(frame).alias("frames")).crossJoin(times.agg(F.count("*").alias("times")))  # one row
    return df.join(times, frame, "left").crossJoin(F.broadcast(n)).withColumn("t", F.when(F.col("frames") == F.col("times"), F.coalesce("t", F.col(frame).cast("double"))).otherwise(F.col(frame).cast("double"))).drop("frames", "times")


