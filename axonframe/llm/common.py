"""What the document operators share: column picking, staged tables and text arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: the bytes 0x20 and 0x09 to 0x0D.
WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, as out=name; exact names win over ones that differ in case."""
    names = df.columns
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.select(*(F.col(f"c{names.index(name)}").alias(out) for out, name in columns.items()))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; the warehouse where none is named, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_axonframe"


class Scratch:
    """Tables of one operator run in the shared folder; lineage ends at each. Results read from them, so they stay until
    the driver ends, which removes them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/axonframe-{uuid.uuid4().hex}"
        path, files = self._place(self.root)
        files.deleteOnExit(path)

    def _place(self, path: str):
        """A path of the JVM and its file system."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def table(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path, files = self._place(f"{self.root}/{name}")
        files.delete(path, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, with n + 1 offsets; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, ends - ends[0]


def blocks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes each; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)
