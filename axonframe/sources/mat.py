"""MAT files of level 5: numeric arrays, text, logicals, cells and structs, read and written.

The format is a sequence of tagged elements; a variable is a matrix element, often deflated. `read_mat` gives Python
values, `read_variables` a long table of all numbers in files spread over tasks, `write_mat` a file of plain variables.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: element types with their numpy kinds, and array classes.
KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, DEFLATED = 14, 15
CELL, STRUCT, OBJECT, CHARS, SPARSE, DOUBLE = 1, 2, 3, 4, 5, 6
LOGICAL, COMPLEX = 0x02, 0x08


class _Reader:
    def __init__(self, data: bytes, order: str) -> None:
        self.data, self.order, self.at = data, order, 0

    def element(self) -> tuple[int, bytes]:
        """(type, body); small elements hold up to 4 bytes in their tag."""
        if self.at + 8 > len(self.data):
            raise ValueError("an element is cut off")
        first = struct.unpack_from(f"{self.order}I", self.data, self.at)[0]
        if first >> 16:
            kind, size = first & 0xFFFF, first >> 16
            body = self.data[self.at + 4 : self.at + 4 + size]
            self.at += 8
            return kind, body
        kind, size = first, struct.unpack_from(f"{self.order}I", self.data, self.at + 4)[0]
        body = self.data[self.at + 8 : self.at + 8 + size]
        if len(body) < size:
            raise ValueError("an element is cut off")
        self.at += 8 + size + (0 if kind == DEFLATED else -size % 8)
        return kind, body

    def numbers(self) -> np.ndarray:
        kind, body = self.element()
        if kind not in KINDS:
            raise ValueError(f"unknown number type {kind}")
        return np.frombuffer(body, self.order + KINDS[kind])


def _matrix(body: bytes, order: str) -> tuple[str, Any]:
    if not body:
        return "", np.zeros((0, 0))
    r = _Reader(body, order)
    flags = int(r.numbers()[0])
    kind, marks = flags & 0xFF, flags >> 8 & 0xFF
    shape = tuple(int(n) for n in r.numbers())
    name = r.numbers().tobytes().decode("latin-1")
    count = int(np.prod(shape))
    if kind == CELL:
        cells = [_matrix(r.element()[1], order)[1] for _ in range(count)]
        return name, [cells[k :: shape[0]] for k in range(shape[0])] if len(shape) == 2 and min(shape) > 1 else cells
    if kind in (STRUCT, OBJECT):
        if kind == OBJECT:
            r.numbers()
        width, raw = int(r.numbers()[0]), r.numbers().tobytes()
        fields = [raw[k : k + width].split(b"\0")[0].decode("latin-1") for k in range(0, len(raw), width)]
        rows = [{f: _matrix(r.element()[1], order)[1] for f in fields} for _ in range(count)]
        return name, rows[0] if count == 1 else rows
    if kind == SPARSE:
        raise ValueError("sparse arrays aren't supported")
    if kind == CHARS:
        type_, raw = r.element()
        text = raw.decode("utf-8") if type_ == 16 else "".join(map(chr, np.frombuffer(raw, order + KINDS[type_]).tolist()))
        lines = ["".join(text[k::shape[0]]) for k in range(shape[0])] if len(shape) == 2 and shape[0] else []
        return name, lines[0] if len(lines) == 1 else lines if lines else ""
    values = r.numbers().astype(float)
    if marks & COMPLEX:
        values = values + 1j * r.numbers().astype(float)
    return name, values.reshape(shape, order="F").astype(bool if marks & LOGICAL else values.dtype)


def read_mat(data: bytes) -> dict[str, Any]:
    """Variables by name: arrays of doubles, bools, text, lists (cells, struct arrays; cells in rows and columns
    are lists of rows), dicts (structs)."""
    order = {b"IM": "<", b"MI": ">"}.get(data[126:128])
    if order is None:
        raise ValueError("not a level 5 MAT file")
    r, out = _Reader(data[128:], order), {}
    while r.at + 8 <= len(r.data):
        kind, body = r.element()
        if kind == DEFLATED:
            kind, body = _Reader(zlib.decompress(body), order).element()
        if kind == MATRIX:
            name, value = _matrix(body, order)
            out[name] = value
    return out


def _element(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + bytes(-len(body) % 8)


def _variable(name: str, value: Any) -> bytes:
    head = lambda kind, shape, marks=0: _element(6, struct.pack("<II", kind | marks << 8, 0)) + _element(5, struct.pack(f"<{len(shape)}i", *shape)) + _element(1, name.encode("latin-1"))
    if isinstance(value, str):
        return _element(MATRIX, head(CHARS, (1, len(value))) + _element(4, np.array([ord(c) for c in value], "<u2").tobytes()))
    if isinstance(value, dict):
        fields = b"".join(f.encode("latin-1")[:31].ljust(32, b"\0") for f in value)
        return _element(MATRIX, head(STRUCT, (1, 1)) + _element(5, struct.pack("<i", 32)) + _element(1, fields) + b"".join(_variable("", v) for v in value.values()))
    if isinstance(value, list) and len(value) > 1 and all(isinstance(v, list) and len(v) == len(value[0]) > 1 for v in value):  # rows of cells
        cells = [row[k] for k in range(len(value[0])) for row in value]
        return _element(MATRIX, head(CELL, (len(value), len(value[0]))) + b"".join(_variable("", v) for v in cells))
    if isinstance(value, list):
        return _element(MATRIX, head(CELL, (1, len(value))) + b"".join(_variable("", v) for v in value))
    array = np.atleast_2d(np.asarray(value))
    marks = LOGICAL if array.dtype == bool else 0
    return _element(MATRIX, head(DOUBLE, array.shape, marks) + _element(9, array.astype("<f8").tobytes(order="F")))


def write_mat(variables: dict[str, Any], deflate: bool = True) -> bytes:
    """A file of numbers, arrays, text, lists and dicts."""
    out = [b"MATLAB 5.0 MAT-file".ljust(116) + bytes(8) + struct.pack("<H", 0x0100) + b"IM"]
    for name, value in variables.items():
        body = _variable(name, value)
        if deflate:
            packed = zlib.compress(body)
            body = struct.pack("<II", DEFLATED, len(packed)) + packed
        out.append(body)
    return b"".join(out)


def flattened(variables: dict[str, Any], prefix: str = "") -> Iterator[tuple[str, np.ndarray | str]]:
    """Numbers and text by dotted names; list members by their number from 1."""
    for name, value in variables.items():
        path = f"{prefix}{name}"
        if isinstance(value, dict):
            yield from flattened(value, f"{path}.")
        elif isinstance(value, list):
            yield from flattened({str(k + 1): v for k, v in enumerate(value)}, f"{path}.")
        else:
            yield path, value


SCHEMA = "file string, variable string, row long, col long, v double, text string"


def read_variables(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """(file, variable, row, col, v, text) of MAT files; arrays of more dimensions keep rows, the rest runs in col."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"], strict=True):
                for name, value in flattened(read_mat(bytes(data))):
                    if only and name not in only:
                        continue
                    if isinstance(value, str):
                        yield pd.DataFrame({"file": [file], "variable": [name], "row": [1], "col": [1], "v": [None], "text": [value]}).astype({"v": float})
                        continue
                    flat = np.real(value).astype(float).reshape(value.shape[0], -1, order="F")
                    r, c = (x.reshape(-1) + 1 for x in np.indices(flat.shape))
                    v = flat.reshape(-1)
                    yield pd.DataFrame({"file": file, "variable": name, "row": r, "col": c, "v": np.where(np.isnan(v), np.nan, v), "text": None}).astype({"text": object})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
    return rows.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def read_export(spark: SparkSession, path: str, root: str = "") -> tuple[DataFrame, DataFrame]:
    """An export's samples (pos, v) and channel index (channel, start, end, fs, title) from one MAT file."""
    at = f"{root}." if root else ""
    rows = read_variables(spark, path)
    vector = lambda n: rows.where(F.col("variable") == at + n).select((F.greatest("row", "col")).alias("k"), "v")
    block = vector("data").select(F.col("k").alias("pos"), "v")
    index = vector("datastart").select(F.col("k").alias("channel"), F.col("v").cast("long").alias("start"))
    index = index.join(vector("dataend").select(F.col("k").alias("channel"), F.col("v").cast("long").alias("end")), "channel")
    index = index.join(vector("samplerate").select(F.col("k").alias("channel"), F.col("v").alias("fs")), "channel", "left")
    titles = rows.where(F.col("variable").startswith(f"{at}titles.")).select(F.substring_index("variable", ".", -1).cast("long").alias("channel"), F.col("text").alias("title"))
    return block, index.join(titles, "channel", "left")


def _matrix_of(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("variable") == name).select("file", F.col("row").alias("k"), F.col("col").alias("i"), F.col("v").alias("y"))


def _vector_of(rows: DataFrame, name: str, out: str) -> DataFrame:
    return rows.where(F.col("variable") == name).select("file", F.greatest("row", "col").alias("i"), F.col("v").alias(out))


def _series_of(rows: DataFrame, values: str, times: str) -> DataFrame:
    """(file, k, i, t, y): a matrix's rows as series over a time vector."""
    return _matrix_of(rows, values).join(_vector_of(rows, times, "t"), ["file", "i"]).select("file", "k", "i", "t", "y")


def _flat(rows: DataFrame, values: str, times: str) -> DataFrame:
    """(file, i, t, y): a vector over a time vector, whichever way either lies; empty where either is absent."""
    return _vector_of(rows, values, "y").join(_vector_of(rows, times, "t"), ["file", "i"]).select("file", "i", "t", "y")


def _require(rows: DataFrame, *names: str) -> None:
    have = {r["variable"] for r in rows.where(F.col("variable").isin(*names)).select("variable").distinct().collect()}  # no more than names
    if set(names) - have:
        raise ValueError(f"missing variables: {sorted(set(names) - have)}")


def read_lfp(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recordings of local fields as MAT files: data (file, channel, i, t, y), stimulus (file, i, t, y) and rates (file,
    fs, stim_fs). All six variables are needed."""
    rows = read_variables(spark, path, ["lfp_data", "stim_data", "t_lfp", "t_stim", "lfp_fs", "stim_fs"])
    _require(rows, "lfp_data", "stim_data", "t_lfp", "t_stim", "lfp_fs", "stim_fs")
    rates = _vector_of(rows, "lfp_fs", "fs").join(_vector_of(rows, "stim_fs", "stim_fs"), ["file", "i"]).drop("i")
    return _series_of(rows, "lfp_data", "t_lfp").withColumnRenamed("k", "channel"), _flat(rows, "stim_data", "t_stim"), rates


def read_mua(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Multi-unit recordings as MAT files: data (file, channel, i, t, y) by the channels' own numbers, stimulus (file, i,
    t, y), which is empty where one of its three variables is absent, and rates (file, fs)."""
    rows = read_variables(spark, path, ["mua_data", "mua_fs", "t_mua", "mua_channels", "stim_data", "stim_fs", "t_stim"])
    _require(rows, "mua_data", "mua_fs", "t_mua", "mua_channels")
    names = _vector_of(rows, "mua_channels", "channel").select("file", F.col("i").alias("k"), F.col("channel").cast("long").alias("channel"))
    data = _series_of(rows, "mua_data", "t_mua").join(names, ["file", "k"]).select("file", "channel", "i", "t", "y")
    rated = rows.where(F.col("variable") == "stim_fs").select("file").distinct()
    return data, _flat(rows, "stim_data", "t_stim").join(rated, "file", "left_semi"), _vector_of(rows, "mua_fs", "fs").drop("i")


STACK = "stack string, frame long, c long, row long, col long, v double, t double"


def read_stack(spark: SparkSession, path: str) -> DataFrame:
    """(stack, frame, c, row, col, v, t) of image stacks in MAT files: the variable `stack`, else `frames`, else the
    first one, as rows x columns x frames; t is `timeVec`, else `t`, else NULL."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"], strict=True):
                found = read_mat(bytes(data))
                name = next((n for n in ("stack", "frames") if n in found), next(iter(found), None))
                images = np.asarray(found.get(name, np.zeros((0, 0))), float)
                if images.ndim < 2 or images.dtype == object:
                    raise ValueError(f"{file} holds no image stack")
                times = found.get("timeVec", found.get("t"))
                times = None if times is None else np.asarray(times, float).reshape(-1)
                images = images.reshape(*images.shape[:2], -1, order="F")
                r, c = (x.reshape(-1) + 1 for x in np.indices(images.shape[:2]))
                for f in range(images.shape[2] if images.size else 0):
                    at = float(times[f]) if times is not None and f < len(times) else None
                    yield pd.DataFrame({"stack": file, "frame": f + 1, "c": 1, "row": r, "col": c, "v": images[:, :, f].reshape(-1), "t": at}).astype({"t": float})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, STACK)
    return rows.withColumn("t", F.when(~F.isnan("t"), F.col("t"))).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """(stack, row, col) inside the region `roiMask` of MAT files; empty where there is none."""
    inside = read_variables(spark, path, ["roiMask"]).where(F.col("v") != 0)
    return inside.select(F.col("file").alias("stack"), "row", "col")
