"""The document operators' queries, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, fingerprints, licenses, matroska, mixing, packing, sharding, simhash, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprints.query,
    "op2_mixing": mixing.query,
    "op3_simhash": simhash.query,
    "op4_suffixes": suffixes.query,
    "op5_chat": chat.query,
    "op6_licenses": licenses.query,
    "op7_packing": packing.query,
    "op8_toxicity": toxicity.query,
    "op9_sharding": sharding.query,
    "op10_matroska": matroska.query,
}

ORACLES: dict[str, str] = {"op2_mixing": mixing.ORACLE, "op5_chat": chat.ORACLE, "op6_licenses": licenses.ORACLE}
