"""Where a session imports from, exports to, and last was: folders kept in the session's settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

KINDS = ("import", "export", "last")


def _key(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"unknown folder {kind!r}")
    return f"axonframe.folder.{kind}"


def folder(spark: SparkSession, kind: str) -> str:
    """Empty where none is set."""
    return spark.conf.get(_key(kind), "")


def set_folder(spark: SparkSession, path: str, *kinds: str) -> bool:
    """Keeps a folder for each of the kinds, if there is one at the path in whatever store it names; else nothing changes."""
    keys = [_key(k) for k in kinds]
    if not path:
        return False
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not (files.exists(place) and files.getFileStatus(place).isDirectory()):
        return False
    for key in keys:
        spark.conf.set(key, path)
    return True


def has_project(spark: SparkSession) -> bool:
    return bool(folder(spark, "import") or folder(spark, "export"))
