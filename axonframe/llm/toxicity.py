"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are which hashed words, word pairs and pairs with one word between it holds, and which stems: the
first 4 to 8 bytes of longer words, so that inflected forms share what they teach. Per-coordinate rates
and L1 sparsity leave a few thousand weights, which are broadcast for scoring. The model is fitted on a bounded sample
of labelled rows (`SAMPLE`, by a hash order of the ids), each text whole; scoring covers every row.

Defined cases: null and empty texts score as the bias alone; labels that are null or contradict each other count as
the larger; without a toxic training row every score is 0; a null doc_id hashes as the empty text; repeated rows are
scored each, and learned from each, in the order of their texts; an empty table has no rows. Texts are read whole in
blocks of BLOCK bytes or one text. Other columns aren't read, whatever their names; accepted() keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS, SAMPLE, EPOCHS, ALPHA, BETA, L1, L2, HELD_OUT = 20, 12_000, 3, 0.3, 1.0, 4.0, 1.0, 5
STEMS, BLOCK = (4, 5, 6, 7, 8), 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def hashed_grams(body: np.ndarray, ends: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word, stem, pair and skip-pair in texts body[ends[i]:ends[i + 1]]."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _LOWER[body]
    on = _LETTER[low]
    first = np.zeros(len(body) + 1, bool)
    first[ends] = True
    starts = np.flatnonzero(on & (first[:-1] | np.concatenate(([True], ~on[:-1]))))
    stops = np.flatnonzero(on & (first[1:] | np.concatenate((~on[1:], [True])))) + 1
    powers, inverse = _powers(max(BLOCK + 1, 1 << (len(body) + 1).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers[: len(low)])))
    word = mixed((sums[stops] - sums[starts]) * inverse[starts])
    text = np.searchsorted(ends, starts, side="right") - 1
    texts, grams = [text], [mixed(word + np.uint64(1))]
    for k in STEMS:
        longer = np.flatnonzero(stops - starts > k)
        at = starts[longer]
        texts.append(text[longer])
        grams.append(mixed(mixed((sums[at + k] - sums[at]) * inverse[at]) + np.uint64(k + 16)))
    for gap in (1, 2):
        same = np.flatnonzero(text[gap:] == text[:-gap]) if len(text) > gap else np.zeros(0, np.int64)
        texts.append(text[same])
        grams.append(mixed(word[same] * np.uint64(3) + word[same + gap] * np.uint64(2 * gap + 3) + np.uint64(gap)))
    return np.concatenate(texts), (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """Sparse weights; `known` is False where no toxic row was there to learn from."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    known: bool
    bits: int = BITS

    def table(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float64)
        w[self.index] = self.weight
        return w


def fit(examples: list[tuple[np.ndarray, int]], bits: int = BITS) -> Model:
    """FTRL-proximal passes over (distinct features, label), in the order given."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == bias, 0.0, L1)
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for features, label in examples:
            at = np.append(features, bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange((1 << bits) + 1))
    index = np.flatnonzero(w[:bias])
    return Model(index.astype(np.int32), w[index], float(w[bias]), any(y for _, y in examples), bits)


def scores(column: pa.Array, model: Model, table: np.ndarray) -> np.ndarray:
    body, ends = common.utf8(column)
    total = np.zeros(len(ends) - 1)
    if not model.known:
        return total
    for a, b in common.blocks(ends, BLOCK):
        text, gram = hashed_grams(body[ends[a] : ends[b]], ends[a : b + 1] - ends[a], model.bits)
        live = np.flatnonzero(table[gram])
        pair = np.unique(text[live] << model.bits | gram[live])
        total[a:b] = np.bincount(pair >> model.bits, table[pair & (1 << model.bits) - 1], b - a)
    return 1 / (1 + np.exp(-np.clip(total + model.bias, -35, 35)))


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % HELD_OUT


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the first `sample` labelled rows outside the held-out fifth, in a hash order of their ids.

    Ids are chosen first, so only the sample's texts move, to one task that makes their features and the passes.
    """
    known = common.pick(labels, doc_id="doc_id", toxic="toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    chosen = known.withColumn("place", F.md5(F.col("doc_id").cast("string"))).orderBy("place", "doc_id").limit(sample)
    rows = common.pick(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("place", "text", "toxic").repartition(1).sortWithinPartitions("place", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: list[tuple[np.ndarray, int]] = []
        for batch in batches:
            body, ends = common.utf8(batch["text"])
            toxic = batch["toxic"].to_pylist()
            for a, b in common.blocks(ends, BLOCK):
                text, gram = hashed_grams(body[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                pair = np.unique(text << BITS | gram)
                cuts = np.searchsorted(pair, np.arange(b - a + 1) << BITS)
                examples += [((pair[i:j] & (1 << BITS) - 1).astype(np.int32), int(toxic[a + k] > 0)) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))]
        model = fit(examples)
        yield pa.RecordBatch.from_arrays([pa.array([model.index.tobytes()]), pa.array([model.weight.tobytes()]), pa.array([model.bias]), pa.array([model.known])], names=["i", "w", "bias", "known"])

    r = rows.mapInArrow(learn, "i binary, w binary, bias double, known boolean").collect()  # one row of at most 2**BITS weights
    return Model(np.frombuffer(r[0]["i"], np.int32), np.frombuffer(r[0]["w"], np.float64), r[0]["bias"], r[0]["known"]) if r else Model(np.zeros(0, np.int32), np.zeros(0), 0.0, False)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = common.pick(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.table()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores(batch["text"], sent.value, table))], names=["doc_id", "score"])

    out = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model calls toxic, all columns kept."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.table()
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), sent.value, table) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
