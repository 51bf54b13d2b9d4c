"""Document fingerprints by statistically improbable features.

Every 32-byte window of a text has an entropy; how rare that entropy is over the corpus ranks the window. A window is
a feature if it is the rarest of its neighbourhood often enough. Features go into a chain of Bloom filters, and two
chains are likened by their filters' bit overlap, normalised by what chance would give.

Defined cases: null and empty texts have an empty chain, like 1 to each other and 0 to others; a text shorter than a
window is one feature; repeated ids follow each other by their texts, null ids come last; a table of one row is its own
next document, an empty one has no rows; of windows that are equally rare the first wins. Texts are read whole in blocks
of BLOCK bytes or one text, so memory grows with the longest text alone. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a window (a neighbourhood has as many windows); wins that make a feature; bins of entropy, those below
#: LEAST (near-constant windows) never win.
WIDTH, WINS, BINS, LEAST = 32, 8, 1000, 100
#: A filter's bits, bits set by a feature, features that fill it.
FILTER_BITS, PROBES, CAPACITY = 2048, 5, 128
#: Overlap above chance that still counts as none, as a part of the most possible.
MARGIN = 0.1
BLOCK, PARTITION_BYTES = 1 << 18, 24 << 20
_COUNTED = np.array([0, *(round(n * np.log2(n) * (1 << 20)) for n in range(1, WIDTH + 1))], np.int64)
_GAIN = np.diff(_COUNTED)


def entropies(body: np.ndarray) -> np.ndarray:
    """The entropy of each window, 0 (constant) to BINS (all bytes differ).

    A window's sum of n log n over its bytes' counts changes by the byte that leaves and the one that enters; how often
    those occur in between is counted by comparing the text with itself at each lag. Integers, so exact.
    """
    n = len(body) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    before, after = np.zeros(len(body), np.uint8), np.zeros(len(body), np.uint8)
    for lag in range(1, WIDTH):
        same = (body[lag:] == body[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    first = int(_COUNTED[np.bincount(body[:WIDTH])].sum())
    change = _GAIN[before[WIDTH:]] - _GAIN[after[: n - 1]]
    total = np.concatenate(([first], first + np.cumsum(change)))
    return BINS - total * BINS // int(_COUNTED[WIDTH])


def _starts(ends: np.ndarray) -> np.ndarray:
    """Which windows of the joined texts lie in one text."""
    inside = np.zeros(int(ends[-1]) + 1, np.int64)
    long = np.flatnonzero(np.diff(ends) >= WIDTH)
    np.add.at(inside, ends[long], 1)
    np.add.at(inside, ends[long + 1] - WIDTH + 1, -1)
    return np.cumsum(inside)[: max(0, int(ends[-1]) - WIDTH + 1)].astype(bool)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _hashed(rows: np.ndarray) -> np.ndarray:
    words, h = np.ascontiguousarray(rows).view("<u8"), np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        h = mixed(h ^ words[:, k]) + np.uint64(k)
    return mixed(h)


def chosen(body: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the features of texts body[ends[i]:ends[i + 1]], in order, each once in a text.

    The last WIDTH - 1 places of a text start no window, so a neighbourhood that starts in a text meets no other's.
    """
    texts, hashes = [], []
    sizes = np.diff(ends)
    valid = _starts(ends)
    if valid.any():
        n = len(valid)
        worst = np.int64(BINS + 1) << 40
        ranks = rank[entropies(body)]
        key = np.where(valid, (ranks << 40) | np.arange(n), worst)
        key, reach = np.concatenate((key, np.full(WIDTH, worst))), 1
        while reach < WIDTH:
            key[: len(key) - reach] = np.minimum(key[: len(key) - reach], key[reach:])
            reach *= 2
        text = np.repeat(np.arange(len(sizes)), sizes)[:n]
        windows = np.maximum(sizes - WIDTH + 1, 0)
        hoods = np.minimum(np.maximum(windows - WIDTH + 1, 1), windows)  # of each text
        at = np.flatnonzero(valid & (np.arange(n) < (ends[:-1] + hoods)[text]))
        won = key[at] & (1 << 40) - 1
        new = np.flatnonzero(np.concatenate(([True], won[1:] != won[:-1])))
        wins, won = np.diff(np.append(new, len(won))), won[new]
        of, fit = text[won], ranks[won] < BINS
        fit |= np.bincount(of, fit, len(sizes))[of] == 0  # a text of near-constant windows alone has to do with those
        most = np.zeros(len(sizes), np.int64)
        np.maximum.at(most, of[fit], wins[fit])
        won = won[fit & (wins >= np.minimum(WINS, most[of]))]
        texts.append(text[won])
        hashes.append(_hashed(np.lib.stride_tricks.sliding_window_view(body, WIDTH)[won]) if len(won) else np.zeros(0, np.uint64))
    short = np.flatnonzero((sizes > 0) & (sizes < WIDTH))
    if len(short):
        rows = np.zeros((len(short), WIDTH + 8), np.uint8)
        for k, t in enumerate(short):
            rows[k, : sizes[t]] = body[ends[t] : ends[t + 1]]
            rows[k, WIDTH] = sizes[t]
        texts.append(short)
        hashes.append(_hashed(rows))
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text, h = np.concatenate(texts), np.concatenate(hashes)
    order = np.lexsort((np.arange(len(h)), h, text))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    order = np.sort(order[new])
    order = order[np.argsort(text[order], kind="stable")]
    return text[order], h[order]


def chains(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Each text's Bloom filters, an array of (filters, bytes)."""
    out: list[np.ndarray] = []
    ends = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    for a, b in common.blocks(ends, BLOCK):
        text, h = chosen(np.frombuffer(b"".join(texts[a:b]), np.uint8), ends[a : b + 1] - ends[a], rank)
        counts = np.bincount(text, minlength=b - a)
        filters = -(-counts // CAPACITY)
        base, before = np.concatenate(([0], np.cumsum(filters))), np.cumsum(counts) - counts
        place = base[text] + (np.arange(len(text)) - before[text]) // CAPACITY
        bits = np.zeros((int(base[-1]), FILTER_BITS), bool)
        for k in range(PROBES):
            bits[place, (h >> np.uint64(11 * k)).astype(np.int64) % FILTER_BITS] = True
        packed = np.packbits(bits, axis=1)
        out += [packed[base[k] : base[k + 1]] for k in range(b - a)]
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """0 to 1: each filter of the chain with fewer bits takes its best match in the other; bits weigh the mean."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if x.shape == y.shape and np.array_equal(x, y):
        return 1.0
    nx, ny = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
    if (ny.sum(), y.tobytes()) < (nx.sum(), x.tobytes()):
        x, y, nx, ny = y, x, ny, nx
    x, y, total = x.view(np.uint64), y.view(np.uint64), 0.0
    for k in range(len(x)):
        best = 0.0
        for j in range(0, len(y), 4096):
            both = np.bitwise_count(x[k] & y[j : j + 4096]).sum(1, dtype=np.int64)
            most = np.minimum(nx[k], ny[j : j + 4096])
            chance = nx[k] * ny[j : j + 4096] / FILTER_BITS
            floor = chance + MARGIN * (most - chance)
            best = max(best, float(((both - floor) / np.maximum(most - floor, 1e-9)).max()))
        total += min(1.0, best) * int(nx[k])
    return total / int(nx.sum())


def encoded(chain: np.ndarray) -> str:
    return f"sif1:{len(chain)}:" + base64.b64encode(chain.tobytes()).decode()


def rarity(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """(rank by entropy bin, rows, bytes). Over every window of every text; rarer is lower, ties by the bin."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, size = np.zeros(BINS + 1, np.int64), 0, 0
        for batch in batches:
            body, ends = common.utf8(batch["text"])
            rows, size = rows + batch.num_rows, size + len(body)
            for a, b in common.blocks(ends, BLOCK):
                valid = _starts(ends[a : b + 1] - ends[a])
                total += np.bincount(entropies(body[ends[a] : ends[b]])[valid], minlength=BINS + 1)
        yield pa.RecordBatch.from_arrays([pa.array([*range(BINS + 1), -1, -2]), pa.array([*total.tolist(), rows, size])], names=["bin", "n"])

    found = {r["bin"]: r["n"] for r in common.pick(docs, text="text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    order = sorted(range(LEAST, BINS + 1), key=lambda b: (found.get(b, 0), b))
    rank = np.full(BINS + 1, BINS, np.int64)
    rank[order] = np.minimum(np.arange(len(order)), BINS - 1)
    return rank, found.get(-1, 0) or 0, found.get(-2, 0) or 0


def fingerprint(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """(doc_id, fingerprint)."""
    rows = common.pick(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([encoded(c) for c in chains(texts, rank)], pa.string())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint string")


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, guest) in partitions of descending ids, sorted; after its own rows each partition has the first
    row of the next one as a guest, the last partition that of the first. Texts move once.

    Bounds are quantiles of the ids; there is one guest id for each partition, whatever the rows.
    """
    rows = common.pick(docs, doc_id="doc_id", text="text").withColumn("at", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    cuts = rows.agg(F.percentile_approx("at", [(k + 1) / parts for k in range(parts - 1)] or [0.5], 20 * parts + 1000)).first()[0] or []
    bounds = np.unique(np.array(cuts[: parts - 1], np.int64))

    @F.pandas_udf("int")
    def part(at: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, at.to_numpy(), side="left")).astype("int32")

    rows = rows.withColumn("part", part("at"))
    firsts = sorted((r["part"], r["at"]) for r in rows.groupBy("part").agg(F.max("at").alias("at")).collect())
    hosts = [(at, firsts[k - 1][0]) for k, (_, at) in enumerate(firsts)]
    spark = docs.sparkSession
    rows = rows.join(F.broadcast(spark.createDataFrame(hosts, "at long, host int")), "at", "left")
    here, there = F.struct(F.col("part"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))
    rows = rows.withColumn("p", F.explode(F.when(F.col("host").isNull(), F.array(here)).otherwise(F.array(here, there))))
    rows = rows.select("doc_id", "text", "at", F.col("p.part").alias("part"), F.col("p.guest").alias("guest"))
    return rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("guest", F.desc("at"), "text").select("doc_id", "text", "guest")


def edit(text: str, other: str) -> str:
    """text with its last half of code points replaced by the first as many of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def against_next(docs: DataFrame, slice_rows: int = 400) -> DataFrame:
    rank, _, size = rarity(docs)
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))
    rows = in_order(docs, parts)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def compare(ids: pa.Array, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        """Rows of texts, each against its next, of which only the last is not in texts."""
        edited = [edit(a, b) for a, b in zip(texts, nexts, strict=True)]
        raw, n = [e.encode() for e in edited], len(texts)
        own = chains([t.encode() for t in [*texts, nexts[-1]]], rank)
        new = chains(raw, rank)
        return pa.RecordBatch.from_arrays([
            ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
            pa.array([encoded(c) for c in own[:n]]), pa.array([encoded(c) for c in new]),
            pa.array([likeness(own[k], new[k]) for k in range(n)]), pa.array([likeness(own[k], own[k + 1]) for k in range(n)]),
        ], names=["doc_id", *COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, done = None, [], False  # rows whose next is not known yet: one at most, between slices
        for batch in batches:
            for first in range(0, batch.num_rows, slice_rows):
                part = batch.slice(first, slice_rows)
                guests = part["guest"].to_pylist()
                own = guests.index(True) if True in guests else len(guests)
                held = part.slice(0, own)
                all_ids = held["doc_id"] if ids is None else pa.concat_arrays([ids, held["doc_id"]])
                all_texts = texts + [t or "" for t in held["text"].to_pylist()]
                if own < len(guests):
                    if done:
                        continue
                    done, nexts = True, [*all_texts[1:], part["text"][own].as_py() or ""]
                    if all_texts:
                        yield compare(all_ids, all_texts, nexts)
                    ids, texts = None, []
                else:
                    if len(all_texts) > 1:
                        yield compare(all_ids.slice(0, len(all_texts) - 1), all_texts[:-1], all_texts[1:])
                    ids, texts = all_ids.slice(len(all_texts) - 1), all_texts[-1:]

    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def query(spark, sf_dir: str) -> DataFrame:
    return against_next(common.documents(spark, sf_dir))
