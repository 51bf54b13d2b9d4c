"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows fall into buckets by a hash of their content. The matrix says how many rows of each bucket go to each shard: it
is drawn from the law that a uniform permutation gives, with both margins exact. Rows are permuted inside buckets,
sent by the matrix and permuted again inside shards.

Defined cases: a null text has no bytes, its CRC is 0; rows that are equal in all key columns are interchangeable, so
either may take either slot; a null id is a key like others; an empty table has no rows; of a long text only its size
and CRC move; other columns, whatever their names, are carried by shuffle_into_shards unless they begin with `_`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SHARDS, BUCKETS, SLICES_BITS, SEED = 24, 1024, 6, 20240917


def large_draw(rng: np.random.Generator, good: int, bad: int, left: int) -> int:
    """A hypergeometric draw for margins beyond numpy's sampler, by inversion around the mode.

    The law's ratios of neighbours give its weights, and their running sum is inverted. What lies over 9 deviations (and
    40 places) from the mode weighs less than a double resolves, so nothing that could be drawn is left out.
    """
    low, high = max(0, left - bad), min(good, left)
    mode = (left + 1) * (good + 1) // (good + bad + 2)
    p = good / (good + bad)
    reach = 40 + int(9 * (left * p * (1 - p) * (good + bad - left) / (good + bad)) ** 0.5)
    a, b = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(a, b, dtype=np.float64)  # weight of x + 1 by that of x
    log = np.concatenate(([0.0], np.cumsum(np.log((good - x) / (x + 1)) + np.log((left - x) / (bad - left + x + 1)))))
    weight = np.cumsum(np.exp(log - log.max()))
    return a + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def communication_matrix(rows_in: list[int], shards: int, seed: int) -> np.ndarray:
    """rows_in[b] x shards counts with row sums rows_in and column sums at most one apart.

    numpy's sampler takes margins below 1e9, `large_draw` any others; both draw from the same law.
    """
    rng, total = np.random.Generator(np.random.PCG64(seed)), int(sum(rows_in))
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    out = np.zeros((len(rows_in), shards), np.int64)
    for b, n in enumerate(rows_in):
        left = int(n)
        for s in range(shards):
            good, bad = int(room[s]), int(room[s + 1 :].sum())
            if not left or not good + bad:
                break
            low, high = max(0, left - bad), min(good, left)
            if low == high:
                x = low
            elif max(good, bad) < 10**9:
                x = int(rng.hypergeometric(good, bad, left))
            else:
                x = large_draw(rng, good, bad, left)
            out[b, s], left = x, left - x
        room -= out[b]
    return out


def shuffle_into_shards(rows: DataFrame, scratch: common.Scratch, key: list[str], shards: int = SHARDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (gapless from 0 in each shard); key columns tell rows apart."""
    draw = lambda k: F.xxhash64(*key, F.lit(seed + k))
    rows = scratch.table("keyed", rows.withColumn("_bucket", F.pmod(draw(0), F.lit(buckets)).cast("int")))
    counts = {r["_bucket"]: r["count"] for r in rows.groupBy("_bucket").count().collect()}  # at most `buckets` rows
    matrix = communication_matrix([counts.get(b, 0) for b in range(buckets)], shards, seed)
    sent = rows.sparkSession.createDataFrame([(b, x.tolist()) for b, x in enumerate(np.cumsum(matrix, axis=1))], "_bucket int, _upto array<bigint>")
    place = F.row_number().over(W.partitionBy("_bucket").orderBy(draw(1), *key))
    rows = rows.withColumn("_place", place).join(F.broadcast(sent), "_bucket")  # the matrix is buckets x shards whatever the rows
    rows = rows.withColumn("shard", F.size(F.filter("_upto", lambda x: x < F.col("_place")))).drop("_bucket", "_upto", "_place")
    rows = scratch.table("sent", rows.withColumn("_slice", F.shiftrightunsigned(draw(2), 64 - SLICES_BITS).cast("int")))
    before = F.sum("count").over(W.partitionBy("shard").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    starts = rows.groupBy("shard", "_slice").count().select("shard", "_slice", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("shard", "_slice").orderBy(draw(2), *key))
    return rows.withColumn("_inside", inside).join(F.broadcast(starts), ["shard", "_slice"]).withColumn("slot", F.col("_start") + F.col("_inside") - 1).drop("_slice", "_start", "_inside")


def query(spark, sf_dir: str) -> DataFrame:
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = common.pick(common.documents(spark, sf_dir), doc_id="doc_id", text="text").select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = shuffle_into_shards(rows, common.Scratch(spark), ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
