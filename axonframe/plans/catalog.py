"""All queries of the engine and their SQL, by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import images, signals, spiking  # noqa: F401  (they register their queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = signals.QUERIES
ORACLES: dict[str, str] = signals.ORACLES
