"""MAT files come back as they were written, and load as exports."""

import struct

import numpy as np
import pytest

from axonframe.sources import mat, readers


@pytest.mark.parametrize("deflate", [True, False])
def test_values_come_back(deflate):
    values = {"a": np.arange(12.0).reshape(3, 4), "flag": np.array([[True, False]]), "s": "text é", "empty": np.zeros((0, 0)), "cube": np.arange(24.0).reshape(2, 3, 4), "st": {"x": 1.5, "name": "n", "inner": {"y": np.array([1.0, 2.0])}}, "cells": ["one", np.array([[2.0]])]}
    got = mat.read_mat(mat.write_mat(values, deflate))
    assert list(got) == list(values)
    assert np.array_equal(got["a"], values["a"]) and np.array_equal(got["cube"], values["cube"]) and got["flag"].dtype == bool
    assert got["s"] == "text é" and got["st"]["x"][0, 0] == 1.5 and got["st"]["inner"]["y"].tolist() == [[1.0, 2.0]]
    assert got["cells"][0] == "one" and got["empty"].size == 0


def test_small_elements_and_other_numbers():
    """A 2 x 2 array of 16-bit numbers whose name and dimensions use tags with their data inside."""
    small = lambda kind, body: struct.pack("<HH", kind, len(body)) + body.ljust(4, b"\0")
    body = mat._element(6, struct.pack("<II", 10, 0)) + mat._element(5, struct.pack("<2i", 2, 2)) + small(1, b"x") + mat._element(3, np.array([1, 2, 3, -4], "<i2").tobytes())
    data = mat.write_mat({})[:128] + mat._element(14, body)
    assert mat.read_mat(data)["x"].tolist() == [[1.0, 3.0], [2.0, -4.0]]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        mat.read_mat(b"nothing" * 40)
    with pytest.raises(ValueError):
        mat.read_mat(mat.write_mat({"a": np.arange(100.0)}, deflate=False)[:-40])


def test_an_export_loads(spark, tmp_path):
    n = 200
    data = {"data": np.arange(8.0 * n), "datastart": 1 + n * np.arange(8.0), "dataend": n * (1 + np.arange(8.0)), "samplerate": np.full(8, 1000.0), "titles": [f"Ch{k + 1}" for k in range(8)]}
    (tmp_path / "e.mat").write_bytes(mat.write_mat(data))
    block, index = mat.read_export(spark, str(tmp_path / "e.mat"))
    rows = readers.load_export(block, index).orderBy("i").collect()
    assert len(rows) == n and rows[0]["stim"] == 5 * n and rows[-1]["flow"] == 8 * n - 1 and rows[1]["t"] == 0.001
    assert {r["title"] for r in readers.metadata(index).collect()} == {f"Ch{k + 1}" for k in range(8)}
    assert mat.read_variables(spark, str(tmp_path / "e.mat"), ["samplerate"]).count() == 8


def test_cells_in_rows_and_columns():
    table = [["a", 1.0, "x"], ["b", 2.0, "y"]]
    got = mat.read_mat(mat.write_mat({"data": table, "names": ["p", "q", "r"]}))
    assert [[c if isinstance(c, str) else float(c[0, 0]) for c in row] for row in got["data"]] == table
    assert got["names"] == ["p", "q", "r"]


def test_recordings_load(spark, tmp_path):
    y, t = np.arange(12.0).reshape(3, 4), np.arange(4.0) / 10
    stim = {"stim_data": np.array([[0.0], [1.0], [0.0]]), "t_stim": np.arange(3.0), "stim_fs": 1.0}
    (tmp_path / "lfp.mat").write_bytes(mat.write_mat({"lfp_data": y, "t_lfp": t, "lfp_fs": 10.0, **stim}))
    data, s, rates = mat.read_lfp(spark, str(tmp_path / "lfp.mat"))
    assert sorted(tuple(r)[1:] for r in data.collect()) == sorted((c + 1, i + 1, t[i], y[c, i]) for c in range(3) for i in range(4))
    assert sorted(tuple(r)[1:] for r in s.collect()) == [(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 2.0, 0.0)]
    assert [tuple(r)[1:] for r in rates.collect()] == [(10.0, 1.0)]
    with pytest.raises(ValueError):
        mat.read_mua(spark, str(tmp_path / "lfp.mat"))
    for name, extra in (("with", stim), ("without", {k: v for k, v in stim.items() if k != "stim_fs"})):
        (tmp_path / f"{name}.mat").write_bytes(mat.write_mat({"mua_data": y, "t_mua": t, "mua_fs": 10.0, "mua_channels": np.array([7.0, 3.0, 5.0]), **extra}))
        data, s, rates = mat.read_mua(spark, str(tmp_path / f"{name}.mat"))
        assert {(r["channel"], r["i"], r["y"]) for r in data.collect()} == {((7, 3, 5)[c], i + 1, y[c, i]) for c in range(3) for i in range(4)}
        assert s.count() == (3 if name == "with" else 0) and rates.count() == 1


def test_stacks_load_by_their_fields(spark, tmp_path):
    a, b = np.arange(24.0).reshape(2, 3, 4), np.arange(6.0).reshape(2, 3)
    for name, fields, want, times in (("a", {"first": b, "frames": a, "stack": b}, b, None), ("b", {"first": b, "frames": a, "t": np.arange(4.0)}, a, np.arange(4.0)), ("c", {"first": a, "t": np.arange(4.0), "timeVec": np.arange(4.0) + 9}, a, np.arange(4.0) + 9)):
        (tmp_path / f"{name}.mat").write_bytes(mat.write_mat(fields))
        got = {(r["row"], r["col"], r["frame"]): (r["v"], r["t"]) for r in mat.read_stack(spark, str(tmp_path / f"{name}.mat")).collect()}
        full = want.reshape(2, 3, -1)
        assert got == {(r + 1, c + 1, f + 1): (full[r, c, f], None if times is None else times[f]) for r in range(2) for c in range(3) for f in range(full.shape[2])}
    assert mat.read_mask(spark, str(tmp_path / "a.mat")).count() == 0


def test_a_feature_table_that_is_too_long_is_refused(spark, tmp_path, monkeypatch):
    from axonframe.sources import sinks

    monkeypatch.setattr(sinks, "MAT_ROWS", 3)
    with pytest.raises(ValueError):
        sinks.write_features(spark.range(4), str(tmp_path / "f.mat"))
    sinks.write_features(spark.range(3).selectExpr("id", "CASE WHEN id > 0 THEN id / 2 END AS half", "'s' AS name"), str(tmp_path / "f.mat"))
    got = mat.read_mat((tmp_path / "f.mat").read_bytes())
    assert got["colNames"] == ["id", "half", "name"] and np.isnan(got["data"][0][1]).all() and got["data"][2][1] == 1.0
