"""Queries do the whole of their tables."""

import numpy as np
from pyspark.sql import functions as F

from axonframe.operators import trials as D
from axonframe.plans import catalog
from axonframe.sources import views as V
from tests.frames import same


def test_median_smooths_every_frame(spark, sf, duck):
    df = catalog.QUERIES["H18_median"](spark, sf)
    assert df.count() == V.pixels(spark, sf).count()
    same(df, duck, catalog.ORACLES["H18_median"])


def test_every_channel_is_sliced(spark, sf, duck, monkeypatch):
    same(catalog.QUERIES["A03_channel_slice"](spark, sf), duck, catalog.ORACLES["A03_channel_slice"])
    block = spark.createDataFrame([(p, float(p)) for p in range(1, 91)], "pos long, v double")
    index = spark.createDataFrame([(c, 3 * c - 2, 3 * c) for c in range(1, 31)], "channel long, start long, end long")
    monkeypatch.setattr(V, "export_block", lambda spark, d: (block, index))
    got = sorted(map(tuple, catalog.QUERIES["A03_channel_slice"](spark, "").collect()))
    assert got == [(c, i, 3.0 * c - 3 + i) for c in range(1, 31) for i in (1, 2, 3)]


def test_depths_hold_every_sample(spark, sf, duck):
    order = (5, 3, 9, 2, 7)
    samples = {(order.index(r["channel"]) + 1, r["i"]): r["y"] for r in V.signal(spark, sf).where(F.col("channel").isin(*order)).collect()}
    assert max(i for _, i in samples) > 40
    same(catalog.QUERIES["E07_channel_order"](spark, sf), duck, catalog.ORACLES["E07_channel_order"])

    def density(depth, i):
        depth = min(max(depth, 2), 4)
        y = [samples.get((k, i)) for k in (depth - 1, depth, depth + 1)]
        return None if None in y else -(y[0] - 2 * y[1] + y[2]) / 0.25

    got = {(r["depth"], r["i"]): r["y"] for r in catalog.QUERIES["E06_csd"](spark, sf).collect()}
    assert got.keys() == samples.keys()
    for (depth, i), y in got.items():
        want = density(depth, i)
        assert (y is None) == (want is None) and (y is None or abs(y - want) < 2e-6)


def test_source_density_needs_its_neighbours(spark):
    rows = [(1, 1, 1.0), (2, 1, 3.0), (3, 1, 4.0), (1, 2, 1.0), (3, 2, 5.0), (4, 2, 9.0), (5, 2, 2.0), (5, 3, 1.0)]
    got = {(r["depth"], r["i"]): r["y"] for r in D.current_source_density(spark.createDataFrame(rows, "depth long, i long, y double"), 1e6, 5).collect()}
    assert got == {(1, 1): 1.0, (2, 1): 1.0, (3, 1): None, (1, 2): None, (3, 2): None, (4, 2): 11.0, (5, 2): 11.0, (5, 3): None}


def test_merge_search_labels_every_spike(spark, sf):
    rows = catalog.QUERIES["G29_merge_search"](spark, sf).collect()
    assert sorted(r["spike"] for r in rows) == sorted(r["spike"] for r in V.waves(spark, sf).collect())


def test_every_waveform_is_embedded(spark, sf):
    rows = catalog.QUERIES["G18_embedded"](spark, sf).collect()
    assert sorted(r["spike"] for r in rows) == sorted(r["spike"] for r in V.waves(spark, sf).collect())
    assert all(np.isfinite([r["f1"], r["f2"]]).all() for r in rows)


def test_model_selection_covers_the_whole_range(spark, monkeypatch):
    centres = 20 * np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1)])
    noise = np.random.default_rng(5).normal(scale=0.1, size=(320, 3))
    rows = [(k, k % 40 / 10, k % 8, (centres[k % 8] + noise[k]).tolist() + [0.0] * 61) for k in range(320)]
    waves = spark.createDataFrame(rows, "spike long, t double, cluster int, wave array<double>")
    monkeypatch.setattr(V, "waves", lambda spark, d: waves)
    for name in ("G21_gmm", "G23_drift_binned", "G24_drift_dynamic"):
        got = catalog.QUERIES[name](spark, "").collect()
        assert len({r["cluster"] for r in got}) > 5, name
