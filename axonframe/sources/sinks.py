"""Writers of cropped signals, trials, recordings and feature tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import require, write_bytes
from .mat import write_mat


def write_cropped(df: DataFrame, path: str) -> None:
    """(i, t, stim, flow). An empty signal is refused."""
    require(df, "i", "t", "stim", "flow")
    if not df.head(1):
        raise ValueError("nothing to write: the signal is empty")
    df.write.mode("overwrite").parquet(path)


def append_trials(trials: DataFrame, path: str) -> None:
    """(trial, i, t_rel, y) behind what is stored; the time axis must be the stored one. New trials are renumbered."""
    spark = trials.sparkSession
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        stored = None
    if stored is None or any(c not in stored.columns for c in ("trial", "i", "t_rel", "y")):
        trials.select("trial", "i", "t_rel", "y").write.mode("overwrite").parquet(path)
        return
    axis = lambda d: d.select("i", "t_rel").distinct()
    if axis(stored).exceptAll(axis(trials)).head(1) or axis(trials).exceptAll(axis(stored)).head(1):
        raise ValueError("the stored trials have another time axis")
    last = stored.agg(F.max("trial")).first()[0] or 0
    trials.select((F.col("trial") + last).alias("trial"), "i", "t_rel", "y").write.mode("append").parquet(path)


def write_recording(data: DataFrame, stim: DataFrame | None, path: str, channels: list[int] | None, parameters: dict[str, str] | None = None) -> None:
    """Selected channels (None: all) and the stimulus, each with its own time base, partitioned by channel; parameters
    beside."""
    chosen = data if channels is None else data.where(F.col("channel").isin(channels))
    chosen.hint("rebalance", "channel").write.mode("overwrite").partitionBy("channel").parquet(f"{path}/data")
    if stim is not None:
        stim.write.mode("overwrite").parquet(f"{path}/stim")
    if parameters:
        data.sparkSession.createDataFrame(sorted(parameters.items()), "name string, value string").write.mode("overwrite").parquet(f"{path}/parameters")


#: Rows of a feature table that a MAT file is written with.
MAT_ROWS = 100_000


def write_features(df: DataFrame, path: str = "signal_features.csv") -> None:
    """CSV with a header, MAT (`data`, cells by row and column, and `colNames`), or Parquet, by the path's ending.

    A MAT file is one variable, made on the driver; longer tables than MAT_ROWS are refused.
    """
    if path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    elif path.endswith(".mat"):
        rows = df.limit(MAT_ROWS + 1).collect()
        if len(rows) > MAT_ROWS:
            raise ValueError(f"a MAT file takes {MAT_ROWS} rows at most")
        plain = lambda v: float("nan") if v is None else v if isinstance(v, str) else float(v)
        write_bytes(df.sparkSession, path, write_mat({"data": [[plain(v) for v in r] for r in rows], "colNames": list(df.columns)}))
    else:
        df.write.mode("overwrite").parquet(path)
