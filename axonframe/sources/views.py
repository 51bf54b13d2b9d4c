"""Deterministic views of the test tables in the engine's logical shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FS = 10.0


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, i, t, y, s): events of a user in time order; s is 1 where the event is an error."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type", "value")
    i = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return events.select(F.col("user_id").alias("channel"), i.alias("i"), ((i - 1) / FS).alias("t"), F.col("value").cast("double").alias("y"), F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("s"))


def stimulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).select("channel", "i", "t", F.col("s").alias("y"))


def irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, i, t, y) with uneven steps: hours since the channel's first event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    w = W.partitionBy("user_id")
    events = events.withColumn("t0", F.min("ts").over(w))
    return events.select(
        F.col("user_id").alias("channel"),
        F.row_number().over(w.orderBy("ts", "event_id")).cast("long").alias("i"),
        (F.expr("timestampdiff(MICROSECOND, t0, ts)") / 3.6e9).alias("t"),
        F.col("value").cast("double").alias("y"),
    )


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spike, t, cluster, wave): embeddings as waveforms."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("spike"), (F.col("vec_id") / 50.0).alias("t"), F.col("label").cast("int").alias("cluster"), F.col("embedding").cast("array<double>").alias("wave"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, row, col, v): embeddings as 8 x 8 frames, rows and columns from 1."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    return rows.select(F.col("vec_id").alias("frame"), (F.floor(F.col("k") / 8) + 1).cast("long").alias("row"), (F.col("k") % 8 + 1).cast("long").alias("col"), F.col("v").cast("double").alias("v"))


def export_block(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The signals as one flat vector (pos, v) with an index (channel, start, end, fs, title, unit), as exports have it.

    Positions come from the channels' counts, so no window spans all samples.
    """
    sig = signal(spark, sf_dir)
    counts = sig.groupBy("channel").agg(F.max("i").alias("n"))
    order = W.orderBy("channel")
    index = counts.select(
        F.row_number().over(order).cast("long").alias("no"),
        "channel",
        (F.sum("n").over(order) - F.col("n") + 1).alias("start"),
        F.sum("n").over(order).alias("end"),
        F.when(F.col("channel") % 3 != 0, F.lit(FS)).alias("fs"),
        F.concat(F.lit("Ch"), F.col("channel").cast("string")).alias("title"),
    )
    block = sig.join(F.broadcast(index.select("channel", "start")), "channel").select((F.col("start") + F.col("i") - 1).alias("pos"), F.col("y").alias("v"))
    return block, index.drop("channel").withColumnRenamed("no", "channel")
