"""Logical tables and the conventions all operators share.

A signal is a long table (keys..., i, t, y): i counts samples from 1 in each series, t is in seconds, y is a double. A
missing value is NULL, never NaN. Every window is partitioned by the series' keys, so series spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

KEYS = ("channel",)


def series(by: Sequence[str] = KEYS, order: str = "i"):
    """The window over a series in sample order."""
    return W.partitionBy(*by).orderBy(order)


def whole(by: Sequence[str] = KEYS):
    """The window over a whole series."""
    return W.partitionBy(*by)


#: Samples of a chunk of a series whose windows reach a few samples only.
CHUNK = 1 << 22


def chunked(df: DataFrame, by: Sequence[str], back: int, ahead: int) -> tuple[DataFrame, WindowSpec]:
    """df with its chunk `_c`, and the window over a chunk in sample order, so that one series spreads over tasks.

    A sample goes to each chunk that a window from `back` samples before to `ahead` behind one of its own samples
    touches; `own` takes the copies away again.
    """
    size, at = max(CHUNK, back + ahead), F.col("i") - 1
    near = F.array_distinct(F.array(*(F.greatest(F.floor(x / size), F.lit(0)) for x in (at, at - ahead, at + back))))
    return df.withColumn("_c", F.explode(near)), W.partitionBy(*by, "_c").orderBy("i")


def own(df: DataFrame, back: int, ahead: int) -> DataFrame:
    return df.where(F.floor((F.col("i") - 1) / max(CHUNK, back + ahead)) == F.col("_c")).drop("_c")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def half_away(x: float) -> int:
    """Rounding of index arithmetic: halves go away from zero (Python's round goes to even)."""
    return int(abs(x) + 0.5) * (1 if x >= 0 else -1)


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def scratch_path(spark, name: str) -> str:
    """A new path in the cluster's shared folder, or in the warehouse where none is named."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/axonframe-{uuid.uuid4().hex}/{name}"


def write_bytes(spark, path: str, data: bytes) -> None:
    """A file of these bytes, by Spark's own file systems, so the path may be in any store that Spark reaches."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(data, 0, len(data))
    finally:
        out.close()


def shipped(f):
    """f(spark, ...), with the package at hand on the executors and Arrow batches of bounded size."""
    import functools

    @functools.wraps(f)
    def run(spark, *args, **kwargs):
        ship(spark)
        bound_batches(spark)
        return f(spark, *args, **kwargs)

    return run


def bound_batches(spark, size: str = "8m") -> None:
    """Arrow batches of about 8 MB instead of Spark's 64, so that a task's Python holds a few of them at most, however
    long the texts. A size that the session sets itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("64m", "67108864b", "67108864"):
        spark.conf.set(key, size)


def ship(spark) -> None:
    """Hands this package to the executors' Python, where it need not be installed. Once a session; the driver serves
    the file."""
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_axonframe_shipped", False):
        return
    name = os.path.realpath(os.path.join(tempfile.mkdtemp(), "axonframe.zip"))
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(name)
    context._axonframe_shipped = True
