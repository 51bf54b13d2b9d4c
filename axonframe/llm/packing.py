"""Packing token sequences by best-fit decreasing over a histogram of piece lengths.

Documents are tokenized, ended by id 0 and cut into full windows; what is left of each is packed. Best fit only looks
at lengths, so the plan is made from how many pieces have each length: a segment tree indexed by remaining capacity
finds the tightest class of open windows, and windows of a class are handled as runs of ids. The plan is bounded by
the window, not by the corpus. Each piece then finds its place by its rank among the pieces of its length.

Ids are those of `tokenizers`. They are read by a faster reader of the same vocabulary and split rule; where that gives
up, on very long runs, `tokenizers` itself reads. The tests hold both equal over every code point.

Defined cases: null or empty texts are one piece of length 1; an empty table has no pieces; repeated rows are packed
each for itself; pieces of equal length, id, start and CRC are interchangeable; null ids are ids like others. Texts are
tokenized whole, however long, one at a time. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WINDOW, SLICES, VOCABULARY = 1024, 64, "byte_bpe_50k.json"
#: The pre-tokenizer's rule of this vocabulary's family, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class CapacityTree:
    """Counts of open windows at the leaves 0..window; finds the least capacity of at least so much."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        k = capacity + self.leaves
        while k:
            self.sums[k] += n
            k >>= 1

    def tightest(self, least: int) -> int | None:
        k = least + self.leaves
        if self.sums[k]:
            return least
        while k > 1 and (k & 1 or not self.sums[k + 1]):
            k >>= 1
        if k <= 1:
            return None
        k += 1
        while k < self.leaves:
            k = 2 * k if self.sums[2 * k] else 2 * k + 1
        return k - self.leaves


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, first window, pieces a window, offset): where pieces of a length go, by rank.

    It is best-fit decreasing piece by piece: a window that gets a piece stays the tightest until the next doesn't fit.
    """
    tree, runs, moves, opened = CapacityTree(window), [deque() for _ in range(window + 1)], [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                each = window // length
                first, free, room = opened, -(-left // each), window
                opened += free
            else:
                first, free = runs[room].popleft()
                tree.add(room, -free)
                each = room // length
            n = min(left, free * each)
            moves.append((length, rank, n, first, each, window - room))
            full, over = divmod(n, each)
            for start, count, pieces in ((first, full, each), (first + full, 1 if over else 0, over), (first + full + bool(over), free - full - bool(over), 0)):
                now = room - pieces * length
                if count and now:
                    (runs[now].append if pieces else runs[now].appendleft)((start, count))
                    tree.add(now, count)
            left, rank = left - n, rank + n
    return moves


@lru_cache
def _encoder(path: str):
    """The vocabulary's two readers, which give the same ids; the second is the slower and takes any text."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file; the rest follow from 256 on
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {x["content"]: x["id"] for x in stored["added_tokens"]}
    ranks = {bytes(letters[c] for c in word): i for word, i in stored["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), Tokenizer.from_file(path)


def token_ids(text: str, path: str) -> list[int]:
    fast, slow = _encoder(path)
    try:
        return fast.encode(text, allowed_special="all")
    except BaseException as e:  # the regex engine gives up on some very long runs, by a panic that is no Exception
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        return slow.encode(text, add_special_tokens=False).ids


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, window: int = WINDOW, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens), full windows first. The vocabulary is read where tasks run."""
    rows = common.pick(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary(name)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                at, start, length, crc, total = [], [], [], [], []
                seen: dict[str, tuple] = {}
                for row, text in enumerate(part["text"].to_pylist()):
                    if (found := seen.get(text or "")) is None:
                        ids = np.array([*token_ids(text or "", path), 0], "<u4")
                        cuts = range(0, len(ids), window)
                        found = seen[text or ""] = (list(cuts), [min(window, len(ids) - a) for a in cuts], [zlib.crc32(ids[a : a + window].tobytes()) for a in cuts], [len(ids)] * len(cuts))
                    at += [row] * len(found[0])
                    for x, y in zip((start, length, crc, total), found, strict=True):
                        x += y
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """cut's rows with sequence_id and offset. A sequence is padded to the window unless its tokens are a power of two.

    Ranks run within (length, slice of a hash), so pieces of one length, however many, are spread over tasks.
    """
    key = ["doc_id", "start", "ids_crc32"]
    rows = cut.withColumn("slice", F.pmod(F.xxhash64(*key), F.lit(SLICES)))
    counts = rows.groupBy("length", "slice").count()
    earlier = F.sum("count").over(W.partitionBy("length").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("length", "slice", F.coalesce(earlier, F.lit(0)).alias("before"))  # window x slices rows at most
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # window rows at most
    moves = plan(histogram, window)
    spark = cut.sparkSession
    types = "length long, first long, pieces long, window long, each long, room long"
    placed = F.broadcast(spark.createDataFrame(moves, types))  # bounded by the window's square
    inside = F.row_number().over(W.partitionBy("length", "slice").orderBy(*key))
    rows = rows.withColumn("inside", inside).join(F.broadcast(starts), ["length", "slice"]).withColumn("rank", F.col("before") + F.col("inside") - 1)
    rows = rows.join(placed, (rows["length"] == placed["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("pieces"))).drop(placed["length"])
    turn = F.col("rank") - F.col("first")
    return rows.select(*cut.columns, (F.col("window") + F.floor(turn / F.col("each"))).cast("long").alias("sequence_id"), (F.col("room") + F.pmod(turn, F.col("each")) * F.col("length")).cast("long").alias("offset"))


def packed(docs: DataFrame, window: int = WINDOW, name: str = VOCABULARY) -> DataFrame:
    """Documents to packed pieces; pieces are staged, as tokenizing is what costs."""
    cut = common.Scratch(docs.sparkSession).table("pieces", pieces(docs, window, name))
    return pack(cut, window)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(common.documents(spark, sf_dir))
