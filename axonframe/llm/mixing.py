"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1, a ramp around its share. Its integral is the cumulative
token demand; inverting that at a document's place in its source's token stream gives the document's training
position, and documents are range-sorted by position.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a table without words
has targets and takes of 0; an empty table has no rows; repeated rows are separate documents of the stream, and rows
that are equal in place, id and size are interchangeable. A text counts whole; it is one row, and its words are counted
where it lies. Other columns aren't read, whatever their names; measured(keep=...) carries those named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Weights by the sources' order, repeating; how often a source may be passed over at most; a ramp's tilt by weight.
WEIGHTS, MOST, TILTS = (1, 2, 3), 3, (-0.5, 0.0, 0.5)


def _cycle(rank: Column, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), ((rank - 1) % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, tilts: tuple = TILTS) -> DataFrame:
    """(source_key, source_size, target, tilt), one row a source. The windows run over this catalogue only.

    With sources in order of cap / weight, those before k capped, the others get level * weight; the first k whose
    own cap isn't below that is the fixed point of sharing the excess again and again.
    """
    catalogue = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy("source_key"))
    by = W.orderBy("room", "source_key")
    before, rest = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    out = (
        catalogue.select("*", _cycle(rank, weights).alias("weight"), _cycle(rank, tilts).alias("tilt"), (F.col("source_size") * most).alias("cap"))
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("room"), F.col("level"))).over(W.partitionBy()))
    )
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return out.select("source_key", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"), "tilt")


def demand_inverse(share: Column, tilt: Column) -> Column:
    """Time t at which a ramp of density 1 + tilt * (2t - 1) has asked for this share of its tokens."""
    bent = (-(1 - tilt) + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share)) / (2 * tilt)
    return F.when(tilt == 0, share).otherwise(bent)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, source_key, size, place, and `keep`): place orders a source's documents, whatever the partitions are."""
    keep = keep or []
    rows = common.pick(docs, doc_id=doc_id, text=text, source=source, **{c: c for c in keep})
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    return rows.select("doc_id", key.alias("source_key"), size.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("place"), *keep)


def mix(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, tilts: tuple = TILTS) -> DataFrame:
    """One row a document: sizes' columns, source_size, target, taken, takes (words by pass), positions (by pass).

    A source's token stream is its documents by place, again and again; it ends at the rounded target, inside a
    document if need be. The running sum goes over 4,096 ranges of place in each source, so no source is one task.
    """
    targets = source_targets(sizes, weights, most, tilts)
    rows = sizes.withColumn("slice", F.substring("place", 1, 3))
    sums = rows.groupBy("source_key", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = F.sum("slice_size").over(W.partitionBy("source_key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select("source_key", "slice", F.coalesce(earlier, F.lit(0)).alias("slice_start")).join(targets, "source_key")
    here = F.sum("size").over(W.partitionBy("source_key", "slice").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("end", here).join(starts, ["source_key", "slice"]).withColumn("start", F.col("slice_start") + F.col("end") - F.col("size"))
    rows = rows.withColumn("asked", F.round("target").cast("long"))
    takes, positions = [], []
    for k in range(most):
        at = F.col("start") + k * F.col("source_size")
        takes.append(F.greatest(F.lit(0), F.least(F.col("size"), F.col("asked") - at)).cast("long"))
        positions.append(F.when(at < F.col("asked"), demand_inverse(at / F.col("asked"), F.col("tilt"))))
    rows = rows.withColumn("takes", F.array(*takes)).withColumn("positions", F.array(*positions))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(*sizes.columns, "source_size", "target", taken.alias("taken"), "takes", "positions")


def training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by the first position; documents that the mix leaves out come last, dealt out by id."""
    first = F.when(F.col("taken") > 0, F.element_at("positions", 1))
    rows = mixed.withColumn("position", first)
    keys = [F.coalesce("position", F.lit(2.0)), F.col("place"), F.col("doc_id")]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def query(spark, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark)
    sizes = scratch.table("sizes", measured(common.documents(spark, sf_dir)))
    mixed = scratch.table("mixed", mix(sizes))
    return training_order(mixed).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", (F.round("position", 9) + 0.0).alias("position"))


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
cat AS (
  SELECT k, s, w, 3 * s AS cap, 3 * s / w::DOUBLE AS room, tilt FROM (
    SELECT k, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS w,
      ((row_number() OVER (ORDER BY k) - 1) % 3 - 1) * 0.5::DOUBLE AS tilt FROM sizes GROUP BY k)),
lev AS (
  SELECT *, ((SELECT sum(s) FROM cat) - coalesce(sum(cap) OVER (ORDER BY room, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY room, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev FROM cat),
tgt AS (
  SELECT k, s, tilt, least(cap::DOUBLE, (SELECT max(lev) FROM lev WHERE lev <= room) * w) AS target FROM lev),
run AS (
  SELECT doc_id, size, s, target, tilt, round(target)::BIGINT AS asked,
    (sum(size) OVER (PARTITION BY k ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS st
  FROM sizes JOIN tgt USING (k))
SELECT doc_id, size, s AS source_size, round(target, 6) AS target,
  (greatest(0, least(size, asked - st)) + greatest(0, least(size, asked - st - s)) + greatest(0, least(size, asked - st - 2 * s)))::BIGINT AS taken,
  CASE WHEN asked - st > 0 AND size > 0 THEN round(CASE WHEN tilt = 0 THEN st / asked::DOUBLE
    ELSE (-(1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (st / asked::DOUBLE))) / (2 * tilt) END, 9) + 0.0::DOUBLE END AS position
FROM run
"""
