"""Media columns: Matroska files written from and parsed into packet tables.

A file is a tree of EBML elements, each an id and a size of variable length. `mux` stores 8-bit mono PCM samples as
laced blocks in clusters, with cues; `packets` parses any such tree (Xiph, EBML, fixed-size or no lacing, SimpleBlock
or BlockGroup, known or unknown sizes) into one row a packet: track, timestamp, byte range and flags.

Defined cases: a null or empty payload has a file without clusters; bytes that end within an element raise ValueError,
which `packet_table` returns in the column `error`. Equal texts have equal files and features, repeated rows a row each;
null ids stay; an empty table has no rows. A text is one file, however long, and is held by itself. Other columns aren't
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

# Element ids of the Matroska and EBML specifications (RFC 9559, RFC 8794).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, NUMBER, UID, KIND, LACING, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACKS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACKS}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES}

#: Samples of a packet, packets of a block, blocks of a cluster; samples a second; nanoseconds of a tick.
PACKET, LACED, BLOCKS, HERTZ, TICK = 1000, 8, 4, 8000, 1_000_000


def vint(n: int) -> bytes:
    """A size in as few bytes as hold it; all ones are kept for the unknown size."""
    width = max(1, -(-(n + 1).bit_length() // 7))
    if n == (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


@lru_cache
def _head() -> tuple[bytes, bytes]:
    """The EBML header and the track list, the same in each file."""
    head = element(EBML, number(EBML_VERSION, 1) + number(READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    rate = np.array([HERTZ], ">f8").tobytes()
    track = number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, rate) + number(CHANNELS, 1) + number(DEPTH, 8))
    return head, element(TRACKS, element(TRACK, track))


def _block(frames: list[bytes], ticks: int) -> bytes:
    """Equal frames take fixed-size lacing, others EBML lacing: the first size, then signed differences."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        flags, lace = 0x80, b""
    elif len(set(sizes)) == 1:
        flags, lace = 0x84, bytes([len(frames) - 1])
    else:
        flags, lace = 0x86, bytes([len(frames) - 1]) + vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < 1 << 7 * w - 1)
            lace += (b - a + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return element(SIMPLE_BLOCK, b"\x81" + ticks.to_bytes(2, "big", signed=True) + bytes([flags]) + lace + b"".join(frames))


def mux(payload: bytes) -> bytes:
    """A whole file that holds the payload's bytes as samples, in order."""
    head, tracks = _head()
    info = element(INFO, number(SCALE, TICK) + element(DURATION, np.array([len(payload) * 1000 / HERTZ], ">f8").tobytes()) + element(MUXER, b"axonframe") + element(WRITER, b"axonframe"))
    parts, cues, at = [info, tracks], b"", len(info) + len(tracks)
    for first in range(0, len(payload), PACKET * LACED * BLOCKS):
        start, blocks = first * 1000 // HERTZ, []
        for b in range(first, min(first + PACKET * LACED * BLOCKS, len(payload)), PACKET * LACED):
            frames = [payload[k : k + PACKET] for k in range(b, min(b + PACKET * LACED, len(payload)), PACKET)]
            blocks.append(_block(frames, b * 1000 // HERTZ - start))
        cluster = element(CLUSTER, number(TIMESTAMP, start) + b"".join(blocks))
        cues += element(CUE_POINT, number(CUE_TIME, start) + element(CUE_TRACKS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at)))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(parts) + (element(CUES, cues) if cues else b""))


@dataclass(slots=True)
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    size: int
    keyframe: bool
    cluster: int
    cued: bool


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """(value, next place); keep: an id keeps its length marker. -1: the unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no length marker at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"an element is cut off at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep:
        return n, at + width
    n ^= 1 << 7 * width
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, body, end), parents before their children. An unknown size ends at the next top-level element."""
    stack, end = [], len(data) if end is None else end
    while at < end:
        while stack and at >= stack[-1][1] >= 0:
            stack.pop()
        start = at
        ident, at = _vint(data, at, True)
        size, body = _vint(data, at, False)
        if ident in TOP_LEVEL:
            while stack and stack[-1][0] != SEGMENT:
                stack.pop()
        stop = body + size if size >= 0 else max([-1, *(x[1] for x in stack[-1:])])
        stop = end if stop < 0 else stop
        if stop > end:
            raise ValueError(f"element {ident:x} at byte {start} is cut off")
        yield ident, start, body, stop
        if ident in PARENTS:
            stack.append((ident, stop if size >= 0 else -1))
            at = body
        else:
            at = stop


def _lace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames from byte `at` on. kind: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if not kind:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        sizes = [(end - at) // count] * count
    elif kind == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    else:
        for k in range(count - 1):
            first = at
            n, at = _vint(data, at, False)
            sizes.append(n if k == 0 else sizes[-1] + n - (1 << 7 * (at - first) - 1) + 1)
    if kind != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise ValueError(f"a block's lacing at byte {at} asks for more than it holds")
    starts = np.cumsum([at, *sizes]).tolist()
    return list(zip(starts, sizes, strict=False))


def packets(data: bytes) -> list[Packet]:
    """Every packet by its place in the file. Laced packets share their block's timestamp, as the format says."""
    scale, cluster, base, segment, out, cued = TICK, -1, 0, 0, [], set()
    group: list[int] = []
    for ident, start, body, end in elements(data):
        value = lambda b=body, e=end: int.from_bytes(data[b:e], "big")
        if ident == SEGMENT:
            segment = body
        elif ident == SCALE:
            scale = value()
        elif ident == CLUSTER:
            cluster, base = start, 0
        elif ident == TIMESTAMP:
            base = value()
        elif ident == CUE_CLUSTER:
            cued.add(segment + value())
        elif ident == BLOCK_GROUP:
            group = []
        elif ident == REFERENCE:
            for k in group:
                out[k].keyframe = False
        elif ident in (SIMPLE_BLOCK, BLOCK):
            track, at = _vint(data, body, False)
            if at + 3 > end:
                raise ValueError(f"a block at byte {start} has no header")
            ticks, flags = base + int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
            for offset, size in _lace(data, at + 3, end, flags >> 1 & 3):
                if ident == BLOCK:
                    group.append(len(out))
                out.append(Packet(track, ticks * scale, offset, size, ident == BLOCK or bool(flags & 0x80), cluster, False))
    for p in out:
        p.cued = p.cluster in cued
    return out


def demux(data: bytes, track: int = 1) -> tuple[bytes, list[Packet]]:
    """A track's samples in file order, and its packets."""
    rows = [p for p in packets(data) if p.track == track]
    return b"".join(data[p.offset : p.offset + p.size] for p in rows), rows


def features(samples: bytes, rows: list[Packet]) -> str:
    """Of 8-bit samples: packets, clusters, cued clusters, length in ms, mean, RMS about 128, crossings, entropy in 1/1000 bit."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / max(1, len(x))
    level = np.arange(256)
    mean = int(counts @ level) * 1000 // max(1, len(x))
    rms = round(float(counts @ (level - 128) ** 2 / max(1, len(x))) ** 0.5 * 1000)
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    entropy = round(float(-(p * np.log2(p)).sum()) * 1000) + 0
    clusters = {r.cluster: r.cued for r in rows}
    return f"packets={len(rows)};clusters={len(clusters)};cued={sum(clusters.values())};ms={len(x) * 1000 // HERTZ};mean={mean};rms={rms};crossings={crossings};entropy={entropy}"


PACKET_TYPES = "track long, timestamp_ns long, offset long, size long, keyframe boolean, cluster long, cued boolean"


def packet_table(media: DataFrame, key: str, data: str) -> DataFrame:
    """(key, packet, track, timestamp_ns, offset, size, keyframe, cluster, cued, error), one row a packet; files that
    can't be parsed have one row with `error` set."""
    rows = common.pick(media, key=key, data=data)
    kind = rows.schema["key"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["track", "timestamp_ns", "offset", "size", "keyframe", "cluster", "cued"]
        for batch in batches:
            cols: dict[str, list] = {n: [] for n in ["key", "packet", *names, "error"]}
            for key, data in zip(batch["key"].to_pylist(), batch["data"].to_pylist(), strict=True):
                try:
                    found, error = packets(data or b""), None
                except (ValueError, IndexError) as e:
                    found, error = [None], str(e)
                for k, p in enumerate(found):
                    cols["key"].append(key)
                    cols["packet"].append(k if p else None)
                    cols["error"].append(error)
                    for n in names:
                        cols[n].append(getattr(p, n) if p else None)
            types = {"keyframe": pa.bool_(), "cued": pa.bool_(), "error": pa.string(), "key": batch.schema.field("key").type}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(n, pa.int64())) for n, v in cols.items()], names=list(cols))

    return rows.mapInArrow(parse, f"key {kind}, packet long, {PACKET_TYPES}, error string")


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 if text else 64)


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: its text muxed, parsed again, and what was read back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, ends = common.utf8(batch["text"])
            out: list[list] = [[] for _ in range(7)]
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                media = mux(padded(body[a:b].tobytes()))
                samples, rows = demux(media)
                values = (b - a, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(samples, rows))
                for x, v in zip(out, values, strict=True):
                    x.append(v)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=["doc_id", *COLUMNS])

    rows = common.pick(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


COLUMNS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def query(spark, sf_dir: str) -> DataFrame:
    return digest(common.documents(spark, sf_dir))
