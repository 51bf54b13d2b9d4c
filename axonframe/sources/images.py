"""Multi-page TIFF stacks as pixel tables, by binaryFile and a small baseline decoder."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the TIFF 6.0 format: sizes of field types, and tags.
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 339


def _packbits(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n, k = data[k], k + 1
        if n < 128:
            out += data[k : k + n + 1]
            k += n + 1
        elif n > 128:
            out += data[k : k + 1] * (257 - n)
            k += 1
    return bytes(out)


def pages(data: bytes) -> Iterator[np.ndarray]:
    """Each page as (height, width, samples). Strips: none, PackBits or deflate; 8, 16, 32 or 64 bits."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack(f"{order}H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(f"{order}I", data[4:8])[0]
    while at:
        n = struct.unpack(f"{order}H", data[at : at + 2])[0]
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count, raw = struct.unpack(f"{order}HHI4s", data[at + 2 + 12 * k : at + 14 + 12 * k])
            size = TYPE_SIZES.get(kind, 1) * count
            if size > 4:
                place = struct.unpack(f"{order}I", raw)[0]
                raw = data[place : place + size]
            code = {1: "B", 3: "H", 4: "I"}.get(kind)
            if code:
                tags[tag] = struct.unpack(f"{order}{count}{code}", raw[:size])
        at = struct.unpack(f"{order}I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]
        width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
        bits, packing, shape = tags.get(BITS, (8,))[0], tags.get(COMPRESSION, (1,))[0], tags.get(FORMAT, (1,))[0]
        if packing not in (1, 8, 32773, 32946) or tags.get(PREDICTOR, (1,))[0] != 1 or bits not in (8, 16, 32, 64):
            raise ValueError("this TIFF compression isn't supported")
        unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}[packing]
        body = b"".join(unpack(data[a : a + c]) for a, c in zip(tags[OFFSETS], tags[COUNTS], strict=True))
        kind = {1: "u", 2: "i", 3: "f"}[shape]
        yield np.frombuffer(body, f"{order}{kind}{bits // 8}")[: width * height * samples].reshape(height, width, samples)


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """(stack, frame, c, row, col, v); the frame number is the time. Files spread over tasks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                for f, image in enumerate(pages(bytes(data)), 1):
                    h, w, s = image.shape
                    r, q, c = np.indices((h, w, s)).reshape(3, -1) + 1
                    yield pd.DataFrame({"stack": name, "frame": f, "c": c, "row": r, "col": q, "v": image.reshape(-1).astype(float)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "stack string, frame long, c long, row long, col long, v double")
