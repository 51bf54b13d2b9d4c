"""A corpus from raw documents to packed sequences, in five stages, each one operator of axonframe.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return docs' columns. Null
texts count as empty throughout; an empty table passes through; other columns, whatever their names, are kept. Repeated
rows are documents of their own until near_copies keeps one of them; null ids come last where the least id counts. In
mixing, rows without words take nothing and go. Texts of any length are read whole by every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.llm import common, mixing, packing, simhash, suffixes, toxicity
from axonframe.model import shipped


@shipped
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the model, fitted on the labels outside the held-out fifth, calls toxic."""
    return toxicity.accepted(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@shipped
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: SimHash fingerprints at most 4 bits apart, met through the index of their bytes, or a
    Jaccard similarity of five-word shingles of 0.8 or more, which fingerprints at 4 bits often miss."""
    return simhash.kept_of_groups(docs, prints=True)


@shipped
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that occur elsewhere; a character cut in two goes. Rows stay, also
    those whose text becomes empty; n_chars, where there is one, follows the text. Null texts stay null."""
    names = docs.columns
    rows = suffixes.dedup(docs, keep=names, as_text=True)
    text = F.when(F.col("row")[f"f{names.index('text')}"].isNotNull(), F.col("kept"))
    whole = F.col("n_removed") == 0
    out = []
    for k, name in enumerate(names):
        value = F.col("row")[f"f{k}"]
        if name == "text":
            value = F.when(whole, value).otherwise(text)
        elif name == "n_chars":
            value = F.when(whole, value).otherwise(F.length(text)).cast(docs.schema[name].dataType)
        out.append(value.alias(f"c{k}"))
    return rows.select(*out).toDF(*names)


@shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights, in training order: a document comes once for each pass that takes it,
    one that a pass takes in part is cut where that many words end, one that no pass takes goes."""
    scratch, names = common.Scratch(spark), docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    at = {c: F.col(f"c{names.index(c)}") for c in ("doc_id", "text", "source")}
    rows = plain.withColumn("th", F.xxhash64(at["text"]))
    nth = F.row_number().over(W.partitionBy("doc_id", "th").orderBy("source_key"))
    sizes = mixing.measured(rows.select(at["doc_id"].alias("doc_id"), at["text"].alias("text"), at["source"].alias("source"), "th"), keep=["th"])
    sizes = scratch.table("sizes", sizes.withColumn("nth", nth))
    mixed = scratch.table("mixed", mixing.mix(sizes).where(F.col("taken") > 0).select(F.col("doc_id").alias("mix_id"), "th", "nth", "size", "takes", "positions", "place"))
    key = F.when(at["source"].isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), at["source"]))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy(at["doc_id"], "th").orderBy(key)))
    joined = rows.join(mixed, at["doc_id"].eqNullSafe(F.col("mix_id")) & (rows["th"] == mixed["th"]) & (rows["nth"] == mixed["nth"]))
    passes = joined.withColumn("pass", F.explode(F.arrays_zip("takes", "positions"))).where(F.col("pass.takes") > 0)
    words = F.array_join(F.slice(F.regexp_extract_all(at["text"], F.lit(common.GAP + common.WORD), 0), 1, F.col("pass.takes").cast("int")), "")
    part = F.col("pass.takes") < F.col("size")
    out = []
    for k, name in enumerate(names):
        value = F.col(f"c{k}")
        if name == "text":
            value = F.when(part, words).otherwise(value)
        elif name == "n_chars":
            value = F.when(part, F.length(words)).otherwise(value).cast(docs.schema[name].dataType)
        out.append(value.alias(f"o{k}"))
    order = ["position", "place", f"o{names.index('doc_id')}"]
    ready = passes.select(*out, F.col("pass.positions").alias("position"), "place")
    return ready.repartitionByRange(*order).sortWithinPartitions(*order).drop("position", "place").toDF(*names)


@shipped
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1,024, by best fit."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no trained model, fingerprint hash or tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each stage's result written as Parquet and read again."""
    docs, scratch = common.documents(spark, sf_dir), common.Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
