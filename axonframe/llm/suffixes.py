"""Suffix-array dedup: bytes covered by a string of `length` bytes that starts anywhere else are removed.

1. Each text is cut into segments of consecutive windows that share their anchor, the 64-gram of least hash inside the
   window. Equal windows have equal anchors at equal places, so only segments whose anchor occurs again can repeat.
2. Equal segments become one with a count. What is left is dealt out by anchor, and each task sorts its segments'
   suffixes by the difference-cover algorithm: sort the triples at places 1 and 2 modulo 3, recurse on their names,
   merge the suffixes at places 0 modulo 3. Suffixes that stand next to each other are compared on their first bytes.
   Where one anchor has more bytes than a task should sort, its windows are halved by where in them the anchor stands,
   and each half is dealt out by the bytes that all its windows have next to the anchor. Equal windows stay together;
   after eight halvings a group is one window and its copies, so a group of any size comes apart.
3. Repeated windows go back to the segments' places, and from there to byte spans of each document.

Defined cases: null and short texts lose nothing; of equal texts of `length` bytes or more nothing is left in any;
rows that repeat an id are told apart by their texts; an empty table has no rows. Long texts are cut into pieces of
BLOCK bytes that overlap by a window, and places of a segment that follow each other at one distance are one range, so
a text of one letter has few. Other columns aren't read, whatever their names; dedup(keep=...) carries those named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 200, 64
#: Bytes of one group's segments that are dealt out together; bytes sorted at once; bytes of a text looked at at once.
GROUP_BYTES, SORT_BYTES, BLOCK = 1 << 19, 1 << 16, 1 << 18
RUNS = "array<struct<low: long, high: long>>"
PLACES = "array<struct<first: long, step: long, times: long>>"
_BASE, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_PLACE, _WHOLE = np.uint64((1 << 34) - 1), (1 << 64) - 1


def gram_hashes(body: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each `gram` bytes, a power of two, by joining hashes of halves."""
    h = (body.astype(np.uint64) + np.uint64(1)) * _SPREAD
    h ^= h >> np.uint64(29)
    power, n = _BASE, 1
    while n < gram:
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power % (1 << 64), 2 * n
    h ^= h >> np.uint64(32)
    h *= _SPREAD
    return h ^ h >> np.uint64(32)


def segments(body: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, anchor, start, stop, place) of the segments of texts body[ends[i]:ends[i + 1]]; start and stop are in body,
    place is the anchor's from start on.

    Of equal least hashes (by 30 bits) the leftmost is the anchor, so it depends on the window's bytes alone.
    """
    none = np.zeros(0, np.int64)
    if len(body) < length:
        return none, np.zeros(0, np.uint64), none, none, none
    h = gram_hashes(body)
    key, wide, reach = h & ~_PLACE | np.arange(len(h), dtype=np.uint64), length - GRAM + 1, 1
    while 2 * reach <= wide:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if wide > reach:
        key = np.minimum(key[: reach - wide], key[wide - reach :])
    anchor = (key & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(anchor)]
    window = np.flatnonzero(np.arange(len(anchor)) + length <= ends[1:][text])
    if not len(window):
        return none, np.zeros(0, np.uint64), none, none, none
    anchor = anchor[window]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    return text[window[first]], h[anchor[first]], window[first], window[last] + length, anchor[first] - window[first]


def pieces(body: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(i, j, base, bytes, ends): texts i to j - 1 together, or a piece from `base` on of one long text. Pieces overlap
    by length - 1 bytes, so each window lies in one."""
    for i, j in common.blocks(ends, BLOCK):
        if j - i > 1 or ends[j] - ends[i] <= 2 * BLOCK:
            yield i, j, 0, body[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
            continue
        for at in range(0, int(ends[j] - ends[i]) - length + 1, BLOCK):
            part = body[ends[i] + at : min(ends[i] + at + BLOCK + length - 1, ends[j])]
            yield i, j, at, part, np.array([0, len(part)])


def _new(*columns: np.ndarray) -> np.ndarray:
    """The places in sorted columns where a row differs from the one before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    differ = columns[0][1:] != columns[0][:-1]
    for c in columns[1:]:
        differ = differ | (c[1:] != c[:-1])
    return np.flatnonzero(np.concatenate(([True], differ)))


def ranges(group: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, first, step, times): the starts, sorted in each of the sorted groups. Three or more at one distance are
    one range; a start may belong to two."""
    gap = np.where(group[1:] == group[:-1], np.diff(start), -1)
    run = _new(gap)
    edges = np.diff(np.append(run, len(gap)))
    keep = (edges > 1) & (gap[run] > 0)
    run, edges = run[keep], edges[keep]
    cover = np.bincount(run, minlength=len(start) + 1) - np.bincount(run + edges + 1, minlength=len(start) + 1)
    alone = np.flatnonzero(np.cumsum(cover)[: len(start)] == 0)
    own = np.concatenate((group[run], group[alone]))
    order = np.argsort(own, kind="stable")
    one = np.ones(len(alone), np.int64)
    return own[order], np.concatenate((start[run], start[alone]))[order], np.concatenate((gap[run], one))[order], np.concatenate((edges + 1, one))[order]


def _keys(raw: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    digest, view = xxhash.xxh3_64_intdigest, memoryview(raw)
    return np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), np.uint64, len(start))


# --- the difference-cover sort -------------------------------------------------------------------------------------


def _key(*columns: np.ndarray) -> np.ndarray:
    """One number a row, in the order of the columns' rows; what wouldn't fit is ranked first."""
    key, top = columns[0], int(columns[0].max())
    for c in columns[1:]:
        span = int(c.max()) + 1
        if (top + 1) * span >= 1 << 63:
            _, key = np.unique(key, return_inverse=True)
            top = int(key.max())
        key, top = key * span + c, top * span + span - 1
    return key


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The suffixes' starts in order. symbols: int64 from 1; what lies beyond the end is 0."""
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda k: symbols[k:].tolist()), np.int64)
    s = np.concatenate((symbols, np.zeros(4, np.int64)))
    ones = np.arange(1, n + (n % 3 == 1), 3)  # where n % 3 is 1 an empty suffix ends the first part
    twos = np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    triple = _key(s[sample], s[sample + 1], s[sample + 2])
    order = np.argsort(triple)
    sorted_ = triple[order]
    name = np.cumsum(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    if name[-1] < len(sample):
        names = np.empty(len(sample), np.int64)
        names[order] = name
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zeros, kind = np.arange(0, n, 3), sampled % 3
    one, two = sampled[kind == 1], sampled[kind == 2]
    both = np.concatenate((one, zeros))
    pair = _key(s[both], rank[both + 1])
    order = np.argsort(pair[len(one) :])
    zeros = zeros[order]
    before = np.searchsorted(pair[: len(one)], pair[len(one) :][order])
    both = np.concatenate((two, zeros))
    triple = _key(s[both], s[both + 1], rank[both + 2])
    before += np.searchsorted(triple[: len(two)], triple[len(two) :])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(zeros))
    free = np.ones(n, bool)
    free[at] = False
    out[at], out[free] = zeros, sampled
    return out


def repeated_runs(parts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, low, high): the byte runs of the strings that are covered by windows of `length` bytes which start
    anywhere else among the strings."""
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    joined = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8)
    symbols = joined.astype(np.int64) + 2
    sizes = np.array([len(p) + 1 for p in parts])
    ends = np.cumsum(sizes)
    symbols[ends - 1] = 1  # below every byte, so no window matches across strings
    order = suffix_array(symbols)
    whole = (np.arange(len(joined)) + length < np.repeat(ends, sizes))[order]
    row = np.flatnonzero(whole[1:] & whole[:-1])
    left, right = order[row], order[row + 1]
    words = _words(joined)
    for at in [*range(0, length - 8, 8), length - 8]:
        same = words[left + at] == words[right + at]
        left, right = left[same], right[same]
    hit = np.zeros(len(joined) + 1, bool)
    hit[left] = hit[right] = True
    start = np.flatnonzero(hit[:-1] & ~np.concatenate(([False], hit[:-2])))
    stop = np.flatnonzero(hit[:-1] & ~hit[1:]) + length
    part = np.searchsorted(ends, start, side="right")
    base = (ends - sizes)[part]
    return part, start - base, stop - base


def _words(joined: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number."""
    wide = np.concatenate((joined, np.zeros(8, np.uint8)))
    out = np.zeros(len(joined), np.uint64)
    for k in range(8):
        out[k::8] = wide[k : k + (len(joined) - k + 7) // 8 * 8].view("<u8")
    return out


# --- Spark ---------------------------------------------------------------------------------------------------------


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


def _anchored(length: int):
    """One row a text: its distinct (anchor, segment) pairs, with whether it holds the pair twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, ends = common.utf8(batch["text"])
            held: list[list[np.ndarray]] = []
            for i, j, at, part, own in pieces(body, ends, length):
                text, anchor, start, stop, _ = segments(part, own, length)
                held.append([text, anchor, _keys(part.tobytes(), start, stop), np.ones(len(text), np.int64)])
                if at + len(part) < ends[j] - ends[i] and j - i == 1:
                    if len(held) > 16:  # of a long text only what is distinct stays
                        held = [_counted(held)]
                    continue
                text, anchor, seg, times = _counted(held)
                held = []
                counts = np.bincount(text, minlength=j - i)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(i, j - i), batch["th"].slice(i, j - i), _lists(_signed(anchor), counts), _lists(_signed(seg), counts), _lists(pa.array(times.astype(np.int8)), counts),
                ], names=["doc_id", "th", "a", "s", "times"])

    return run


def _counted(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Distinct (text, anchor, segment) in order, with how often they occur, up to 2."""
    text, anchor, seg, times = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((seg, anchor, text))
    text, anchor, seg, times = text[order], anchor[order], seg[order], times[order]
    new = _new(text, anchor, seg)
    return [text[new], anchor[new], seg[new], np.minimum(np.add.reduceat(times, new), 2) if len(new) else times]


def _placed(length: int):
    """Rows (doc_id, th, a, s, n, starts, bytes, place, content) of the segments whose anchors occur again, n times in a piece
    of a text. Content, of anchors with more than one distinct segment, stands in the first row of a segment in a batch."""
    names = ["doc_id", "th", "a", "s", "n", "starts", "bytes", "place", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, ends = common.utf8(batch["text"])
            seen: set[tuple[int, int]] = set()
            for i, j, at, part, own in pieces(body, ends, length):
                raw, base = part.tobytes(), own[:-1]
                text, anchor, start, stop, place = segments(part, own, length)
                cuts = np.searchsorted(text, np.arange(j - i + 1))
                keep, many = np.zeros(len(text), bool), np.zeros(len(text), bool)
                for k in range(j - i):
                    if cuts[k] < cuts[k + 1]:
                        again, multi = (np.array(batch[c][i + k].as_py(), t) for c, t in (("again", np.int64), ("multi", bool)))
                        here, order = anchor[cuts[k] : cuts[k + 1]].view(np.int64), np.argsort(again)
                        found = np.minimum(np.searchsorted(again[order], here), len(again) - 1)
                        keep[cuts[k] : cuts[k + 1]] = again[order][found] == here
                        many[cuts[k] : cuts[k + 1]] = multi[order][found]
                text, anchor, start, stop, place, many = (x[keep] for x in (text, anchor, start, stop, place, many))
                seg = _keys(raw, start, stop)
                order = np.lexsort((start, seg, anchor, text))
                text, anchor, start, stop, place, many, seg = (x[order] for x in (text, anchor, start, stop, place, many, seg))
                if not len(text):
                    continue
                new = _new(text, anchor, seg)
                content = []
                for k in new.tolist():
                    key = (int(anchor[k]), int(seg[k]))
                    content.append(raw[start[k] : stop[k]] if many[k] and key not in seen else None)
                    seen.add(key)
                times = np.diff(np.append(new, len(text)))
                group, first, step, count = ranges(np.repeat(np.arange(len(new)), times), start - base[text] + at)
                places = pa.StructArray.from_arrays([pa.array(first), pa.array(step), pa.array(count)], ["first", "step", "times"])
                row = pa.array(text[new] + i)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].take(row), batch["th"].take(row), _signed(anchor[new]), _signed(seg[new]), pa.array(times),
                    _lists(places, np.bincount(group, minlength=len(new))), pa.array((stop - start)[new]), pa.array(place[new]), pa.array(content, pa.binary()),
                ], names=names)

    return run


def _halved(length: int):
    """Segments of large groups (b, c, place, low, high, content) to those of smaller groups (b, c, place, low, high,
    content) and where they start in which (a, s), the b and c from before.

    The anchor stands `low` to `high` bytes into a group's windows. Those where it stands in the first half of that have
    at least so many bytes behind it, the others at least so many before it; these name the new group.
    """
    names = ["b", "c", "a", "s", "start", "place", "low", "high", "content"]
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for b, c, place, low, high, content in zip(*(batch[n].to_pylist() for n in ("b", "c", "place", "low", "high", "content")), strict=True):
                mid = (low + high) // 2
                for first, last in ((low, mid), (mid + 1, high)):
                    start, stop = max(0, place - last), min(len(content) - length, place - first)
                    if first <= last and start <= stop:
                        near = content[place : place + length - mid] if last == mid else content[place - mid - 1 : place + GRAM]
                        part = content[start : stop + length]
                        out.append((digest(near, b & _WHOLE) ^ (last == mid), digest(part), b, c, start, place - start, first, last, part))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            unsigned = [_signed(np.array(x, np.uint64)) for x in columns[:2]]
            yield pa.RecordBatch.from_arrays([*unsigned, *(pa.array(x, pa.int64()) for x in columns[2:8]), pa.array(columns[8], pa.binary())], names=names)

    return run


def _sorted_here(length: int):
    """Segments in the order of their groups to (b, c, runs): bytes of windows that start in another segment too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []

        def flush(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            rows = [r for k, r in enumerate(rows) if r[0] in (rows[k - 1][0] if k else None, rows[k + 1][0] if k + 1 < len(rows) else None)]
            part, low, high = repeated_runs([r[2] for r in rows], length)
            hit, first = np.unique(part, return_index=True)
            counts = np.diff(np.append(first, len(part)))
            ranges = pa.StructArray.from_arrays([pa.array(low), pa.array(high)], ["low", "high"])
            return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in hit], pa.int64()), pa.array([rows[k][1] for k in hit], pa.int64()), _lists(ranges, counts)], names=["b", "c", "runs"])

        size = 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("b", "c", "content")), strict=True):
                if size >= SORT_BYTES and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield flush(held)

    return run


def spans(text: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, low, high): ranges of each text, those that touch or overlap as one, in order."""
    order = np.lexsort((low, text))
    text, low, high = text[order], low[order], high[order]
    if not len(text):
        return text, low, high
    shift = text * (int(high.max()) + 2)  # apart, so a text's ends don't reach the next one's
    reach = np.maximum.accumulate(high + shift)
    first = np.flatnonzero(np.concatenate(([True], low[1:] + shift[1:] > reach[:-1])))
    last = np.append(first[1:], len(text)) - 1
    return text[first], low[first], reach[last] - shift[last]


def _cut(batches: Iterator[pa.RecordBatch], as_text: bool = False) -> Iterator[pa.RecordBatch]:
    """Texts and their spans to what is left of them; as text, without characters that lost a byte."""
    for batch in batches:
        body, ends = common.utf8(batch["text"])
        found = batch["found"].fill_null([]) if batch["found"].null_count else batch["found"]
        low, high = (found.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        text, low, high = spans(np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(found).to_numpy(zero_copy_only=False)), low, high)
        raw, left = body.tobytes(), []
        cuts = np.searchsorted(text, np.arange(batch.num_rows + 1)).tolist()
        lows, highs, at = (low + ends[:-1][text]).tolist(), (high + ends[:-1][text]).tolist(), ends.tolist()
        for k in range(batch.num_rows):
            edges = [at[k], *(x for c in range(cuts[k], cuts[k + 1]) for x in (lows[c], highs[c])), at[k + 1]]
            left.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        removed = np.zeros(batch.num_rows, np.int64)
        np.add.at(removed, text, high - low)
        kept = pa.array([x.decode("utf-8", "ignore") for x in left], pa.string()) if as_text else pa.array(left, pa.binary())
        pairs = pa.StructArray.from_arrays([pa.array(low), pa.array(high)], ["start", "end"])
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(np.diff(ends)), pa.array(removed), _lists(pairs, np.bincount(text, minlength=batch.num_rows)), kept], names=["row", "n_bytes", "n_removed", "spans", "kept"])


def repeats(distinct: DataFrame, scratch: common.Scratch, length: int = LENGTH) -> DataFrame:
    """(a, s, runs): of distinct segments (a, s, place, content) the bytes of windows that start in another segment of the
    same anchor too. Anchors with more bytes than a group should have are halved level by level."""
    columns = ["b", "c", "place", "low", "high", "content"]
    rows = distinct.select(F.col("a").alias("b"), F.col("s").alias("c"), "place", F.lit(0).cast("long").alias("low"), F.lit(length - GRAM).cast("long").alias("high"), "content")
    places: DataFrame | None = None  # of the groups' segments in those given
    out: list[DataFrame] = []

    def sorted_(rows: DataFrame) -> DataFrame:
        return rows.select("b", "c", "content").repartition("b").sortWithinPartitions("b", "c").mapInArrow(_sorted_here(length), f"b long, c long, runs {RUNS}")

    def named(found: DataFrame, places: DataFrame | None) -> DataFrame:
        if places is None:
            return found.select(F.col("b").alias("a"), F.col("c").alias("s"), "runs")
        moved = F.transform("runs", lambda r: F.struct((r["low"] + F.col("start")).alias("low"), (r["high"] + F.col("start")).alias("high")))
        return places.join(found, ["b", "c"]).select("a", "s", moved.alias("runs"))

    for level in range((length - GRAM).bit_length() + 1):
        # groups whose windows are all one have one segment and nothing to sort
        sizes = rows.where(F.col("low") < F.col("high")).groupBy("b").agg(F.sum(F.length("content")).alias("n"))
        large = scratch.table(f"large{level}", sizes.where(F.col("n") > GROUP_BYTES).select("b"))
        if not large.head(1):
            out.append(named(sorted_(rows), places))
            break
        out.append(named(sorted_(rows.join(large, "b", "left_anti")), places))
        halves = f"{', '.join(n + ' long' for n in ('b', 'c', 'a', 's', 'start', 'place', 'low', 'high'))}, content binary"
        cut = scratch.table(f"cut{level}", rows.join(large, "b", "left_semi").select(*columns).mapInArrow(_halved(length), halves))
        here = cut.select("b", "c", "a", "s", "start")
        if places is not None:
            above = places.select(F.col("b").alias("a"), F.col("c").alias("s"), F.col("a").alias("a0"), F.col("s").alias("s0"), F.col("start").alias("start0"))
            here = scratch.table(f"places{level}", here.join(above, ["a", "s"]).select("b", "c", F.col("a0").alias("a"), F.col("s0").alias("s"), (F.col("start") + F.col("start0")).alias("start")))
        places = here
        # the same half in two segments repeats as a whole
        twice = cut.groupBy("b", "c").agg(F.count("*").alias("n"), F.max(F.length("content")).cast("long").alias("bytes")).where(F.col("n") > 1)
        whole = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("bytes").alias("high")))
        out.append(named(twice.select("b", "c", whole.alias("runs")), places))
        rows = scratch.table(f"rows{level}", cut.select(*columns).dropDuplicates(["b", "c"]))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def dedup(docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """(row, n_bytes, n_removed, spans, kept): row holds docs' columns `keep` (doc_id if not given) as a struct; kept
    are bytes, or text without characters of which a byte went."""
    scratch = common.Scratch(docs.sparkSession)
    names = keep or ["doc_id"]
    rows = common.pick(docs, doc_id="doc_id", text="text", **{f"keep{k}": c for k, c in enumerate(names)})
    rows = rows.withColumn("th", F.xxhash64("text")).withColumn("row", F.struct(*(F.col(f"keep{k}").alias(f"f{k}") for k in range(len(names))))).select("doc_id", "th", "text", "row")
    kind = rows.schema["doc_id"].dataType.simpleString()
    long = rows.where(F.octet_length("text") >= length).select("doc_id", "th", "text")

    anchors = scratch.table("anchors", long.mapInArrow(_anchored(length), f"doc_id {kind}, th long, a array<long>, s array<long>, times array<byte>"))
    each = anchors.select("doc_id", "th", F.explode(F.arrays_zip("a", "s", "times")).alias("x")).select("doc_id", "th", "x.a", "x.s", "x.times")
    again = each.groupBy("a").agg(F.sum("times").alias("n"), (F.min("s") != F.max("s")).alias("multi")).where(F.col("n") > 1)
    again = scratch.table("again", again.select("a", "multi"))
    found = each.select("doc_id", "th", "a").join(again, "a").groupBy("doc_id", "th").agg(F.collect_list("a").alias("again"), F.collect_list("multi").alias("multi"))
    found = scratch.table("found", found)
    scratch.drop("anchors")

    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["th"] == y["th"])
    joined = long.join(found, same(long, found)).select(long["doc_id"], long["th"], "text", "again", "multi")
    placed = scratch.table("placed", joined.mapInArrow(_placed(length), f"doc_id {kind}, th long, a long, s long, n long, starts {PLACES}, bytes long, place long, content binary"))

    distinct = scratch.table("distinct", placed.where(F.col("content").isNotNull()).select("a", "s", "place", "content").dropDuplicates(["a", "s"]))
    copied = placed.groupBy("a", "s").agg(F.sum("n").alias("n"), F.max("bytes").alias("bytes")).where(F.col("n") > 1)
    copied = copied.select("a", "s", F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("bytes").alias("high"))).alias("runs"))
    result = scratch.table("result", copied.unionByName(repeats(distinct, scratch, length)))
    # a range's starts, moved by a run: one run again if they lie close enough
    place = lambda x, r, k: F.struct((x["first"] + k * x["step"] + r["low"]).alias("low"), (x["first"] + k * x["step"] + r["high"]).alias("high"))
    whole = lambda x, r: F.struct((x["first"] + r["low"]).alias("low"), (x["first"] + (x["times"] - 1) * x["step"] + r["high"]).alias("high"))
    each = lambda x, r: F.transform(F.sequence(F.lit(0).cast("long"), x["times"] - 1), lambda k: place(x, r, k))
    shifted = F.flatten(F.transform("starts", lambda x: F.flatten(F.transform("runs", lambda r: F.when(x["step"] <= r["high"] - r["low"], F.array(whole(x, r))).otherwise(each(x, r))))))
    cuts = placed.select("doc_id", "th", "a", "s", "starts").join(result, ["a", "s"]).select("doc_id", "th", shifted.alias("runs"))
    cuts = cuts.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("runs")).alias("found"))
    cuts = scratch.table("cuts", cuts)
    out = rows.join(cuts, same(rows, cuts), "left").select("row", "text", "found")
    kept = "string" if as_text else "binary"
    return out.mapInArrow(lambda b: _cut(b, as_text), f"row {rows.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept {kept}")


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(common.documents(spark, sf_dir))
    return out.select(F.col("row.f0").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
