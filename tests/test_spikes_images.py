"""Spike sorting on planted units, image measures on planted stacks, kernels, and replayed streams."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.functions import cluster as kernels
from axonframe.functions import dsp, stats
from axonframe.operators import clusters, imaging, spikes
from axonframe.plans.images import tiff
from axonframe.sources import images
from axonframe.streaming import live


def train(spark, seed=1, n=30_000, fs=10_000.0):
    """Two negative-going units at known samples in low noise."""
    rng = np.random.default_rng(seed)
    x = rng.normal(scale=0.05, size=n)
    k = np.arange(-10, 21)
    shapes = [-np.exp(-(k**2) / 8) + 0.4 * np.exp(-((k - 8) ** 2) / 20), -2 * np.exp(-(k**2) / 20)]
    at = np.arange(100, n - 100, 293) + rng.integers(0, 60, len(np.arange(100, n - 100, 293)))
    unit = rng.integers(0, 2, len(at))
    for a, u in zip(at, unit, strict=True):
        x[a - 10 : a + 21] += shapes[u]
    df = spark.createDataFrame([(1, j + 1, j / fs, float(v)) for j, v in enumerate(x)], "channel long, i long, t double, y double")
    return df, at + 1, unit


@pytest.mark.parametrize("method", ["mad", "standard", "percentile"])
def test_planted_spikes_are_found(spark, method):
    df, at, _ = train(spark)
    k = {"mad": 6.0, "standard": 2.0, "percentile": 0.0}[method]
    got = np.array(sorted(r["i"] for r in spikes.detected(df, method, "negative", k, 20).collect()))
    near = np.abs(got[:, None] - at).min(1)
    assert (near <= 2).all()
    if method == "mad":
        assert len(got) == len(at)


def test_planted_units_are_sorted(spark):
    df, at, unit = train(spark)
    found = spikes.detected(df, "mad", "negative", 6.0, 20).select("channel", "i", "t")
    waves = spikes.aligned(df, found, 15, 8, 15).withColumn("spike", F.row_number().over(W.partitionBy("channel").orderBy("i")))
    sorted_ = clusters.labelled(spikes.standardised(spikes.principal(waves, 3)), "kmeans", 10, ks=range(2, 5)).cache()
    labels = {r["centre"]: r["cluster"] for r in sorted_.collect()}
    truth = [(labels[c], u) for a, u in zip(at, unit, strict=True) for c in labels if abs(c - a) <= 2]
    assert len(truth) > 0.95 * len(at)
    assert set(labels.values()) == {1, 2}
    first = sum(c == 1 + u for c, u in truth)
    assert max(first, len(truth) - first) > 0.9 * len(truth)
    quality = clusters.quality(sorted_, 10_000.0, 0.001).collect()
    assert len(quality) == 2 and not any(r["rejected"] for r in quality)


@pytest.mark.parametrize("seed", range(6))
def test_peak_picking_matches_a_plain_loop(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 8, 120).astype(float)
    df = spark.createDataFrame([(1, k + 1, k / 10, float(v)) for k, v in enumerate(y)], "channel long, i long, t double, y double")
    got = sorted(r["i"] for r in spikes.peaks(df, df.select("channel").distinct().withColumn("threshold", F.lit(2.0)), 4).collect())
    cand, k = [], 1
    while k < len(y) - 1:
        e = k
        while e + 1 < len(y) and y[e + 1] == y[k]:
            e += 1
        if e < len(y) - 1 and y[k] > y[k - 1] and y[k] > y[e + 1] and y[k] > 2:
            cand.append(k + 1)
        k = e + 1
    kept = []
    for i in sorted(cand, key=lambda i: (-y[i - 1], i)):
        if all(abs(i - j) > 4 for j in kept):
            kept.append(i)
    assert got == sorted(kept)


def test_polarity_and_methods_are_checked(spark):
    df, _, _ = train(spark, n=1000)
    with pytest.raises(ValueError):
        spikes.detected(df, "none such")
    with pytest.raises(ValueError):
        spikes.detected(df, "mad", "sideways")
    with pytest.raises(ValueError, match="too few"):
        spikes.require_enough(df.limit(3), 20)
    with pytest.raises(ValueError, match="no spikes"):
        spikes.require_enough(df.limit(0), 20)


@pytest.mark.parametrize("p", [0, 10, 25, 50, 99.9, 100])
def test_percentile_is_hazen(spark, p):
    x = np.random.default_rng(1).integers(0, 20, 37).astype(float)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    assert stats.hazen(df, "v", p).first()["q"] == pytest.approx(np.percentile(x, p, method="hazen"))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
def test_percentile_of_all_is_exact_at_any_size(spark, n):
    x = np.random.default_rng(n).integers(-50, 50, n) / 4
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    for p in (0, 0.3, 37, 99.95, 100):
        got = stats.hazen(df, "v", p).first()["q"]
        assert got is None if n == 0 else got == pytest.approx(np.percentile(x, p, method="hazen"))


def test_kmeans_of_one_large_population(spark):
    x, truth = blobs()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "spike long, features array<double>")
    out, k, score = clusters.kmeans_at_scale(df, 10, range(2, 5))
    labels = {r["spike"]: r["cluster"] for r in out.collect()}
    assert k == 3 and score > 0.8 and len({(labels[j], t) for j, t in enumerate(truth)}) == 3
    with pytest.raises(ValueError):
        clusters.kmeans_at_scale(df, 1000, range(2, 3))


def blobs(k=3, n=40, seed=2):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=(n, 2)) * 0.2 + 5 * np.array([c, c % 2]) for c in range(k)]), np.repeat(np.arange(k), n)


@pytest.mark.parametrize("method", ["kmeans", "gmm", "dbscan"])
def test_blobs_are_recovered(method):
    x, truth = blobs()
    labels, _, k = kernels.selected(x, method, 8, eps=1.0 if method == "dbscan" else None)
    assert k == 3 and len(set(zip(labels, truth, strict=True))) == 3


def test_no_valid_k_is_all_noise():
    labels, score, k = kernels.selected(np.random.default_rng(1).normal(size=(10, 2)), "kmeans", 20)
    assert k == 0 and set(labels) == {0} and np.isnan(score)


def test_silhouette_by_definition():
    x, labels = blobs(2, 6)
    d = kernels.distances(x, x)
    want = []
    for k in range(len(x)):
        a = d[k][(labels == labels[k]) & (np.arange(len(x)) != k)].mean()
        b = min(d[k][labels == c].mean() for c in set(labels) - {labels[k]})
        want.append((b - a) / max(a, b))
    assert kernels.silhouette(x, labels) == pytest.approx(np.mean(want))


def test_merging_keeps_noise_and_chains():
    pairs = [(1, 2, 0.9, 0.1), (2, 3, 0.9, 0.1), (0, 1, 0.99, 0.0), (4, 5, 0.1, 0.1)]
    assert clusters.merge_plan(pairs, [0, 1, 2, 3, 4, 5], 0.85, 0.5, True) == {0: 0, 1: 1, 2: 1, 3: 1, 4: 2, 5: 3}
    assert clusters.merge_plan(pairs[:2], [0, 1, 4], 0.85, 0.5, False, compat=True)[0] == 1


def test_ids_run_through_bins():
    a, b, c = np.array([0, 1, 0, 0.0]), np.array([0, 0, 1, 0.0]), np.array([1, 0, 0, 0.3])
    ids = clusters.matched_bins([(1, 1, a), (1, 2, b), (2, 1, b), (2, 2, c), (3, 1, c), (3, 2, a)], 0.8, 0.5)
    assert ids[(1, 2)] == ids[(2, 1)] and ids[(2, 2)] == ids[(3, 1)] and ids[(3, 2)] not in (ids[(1, 2)], ids[(3, 1)])


def test_single_spike_has_no_violations(spark):
    df = spark.createDataFrame([(1, 0.5, 3)], "spike long, t double, cluster int")
    assert clusters.violations(df, 0.01).first()["violations"] == 0


def test_drift_bins_are_right_closed(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate((0.0, 1.0, 1.0001, 2.0))], "spike long, t double")
    assert [r["bin"] for r in clusters.time_bins(df, 1.0).orderBy("spike").collect()] == [1, 1, 2, 2]


# --- images --------------------------------------------------------------------------------------------------------


def stack(spark, frames):
    rows = [(f + 1, r + 1, c + 1, float(v)) for f, image in enumerate(frames) for (r, c), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "frame long, row long, col long, v double")


def test_moving_ridge_has_its_speed(spark):
    x = np.arange(60)
    frames = [np.tile(np.exp(-((x - 5 - 0.5 * f) ** 2) / 60), (3, 1)) for f in range(40)]
    kymo = imaging.kymograph(stack(spark, frames), (1, 2, 60, 2), 60, 3)
    assert kymo.count() == 40 * 59
    full = kymo.where(F.col("p") < 25)
    assert imaging.propagation(full).first()["slope"] is not None
    rising = [np.tile(2.0 * x - 1.0 * f, (3, 1)) for f in range(40)]
    assert imaging.propagation(imaging.kymograph(stack(spark, rising), (1, 2, 60, 2), 60, 3)).first()["slope"] == pytest.approx(0.5, rel=0.05)


def test_kymograph_interpolates_and_clamps(spark):
    image = np.add.outer(10.0 * np.arange(1, 6), np.arange(1, 8))
    rows = imaging.kymograph(stack(spark, [image]), (1.0, 1.0, 7.0, 4.0), 7, 5).orderBy("p").collect()
    assert [r["v"] for r in rows] == pytest.approx([10 * (1 + 3 * k / (len(rows) - 1)) + 1 + 6 * k / (len(rows) - 1) for k in range(len(rows))])
    assert len(imaging.line_points(3, 3, 3, 3, 7, 5)) == 2
    assert all(1 <= x <= 7 and 1 <= y <= 5 for _, x, y in imaging.line_points(-9, -9, 99, 99, 7, 5))


def test_dark_vessel_width(spark):
    frames = []
    for w in (4, 8):
        line = np.full(40, 10.0)
        line[15 : 15 + w] = 1.0
        frames.append(np.tile(line, (3, 1)))
    frames.append(np.full((3, 40), 5.0))
    kymo = imaging.kymograph(stack(spark, frames), (1, 2, 40, 2), 40, 3)
    got = [r["diameter"] for r in imaging.vessel_diameter(kymo, 39.0).orderBy("frame").collect()]
    assert got[0] == pytest.approx(4, abs=0.6) and got[1] == pytest.approx(8, abs=1.1) and got[2] is None


def test_constant_images(spark):
    flat = stack(spark, [np.full((3, 3), 7.0)] * 2)
    assert {r["v"] for r in imaging.gray256(flat).collect()} == {0}
    assert {r["v"] for r in imaging.normalised(flat, "frame").collect()} == {0.0}
    assert [r["value"] for r in imaging.roi_movement(flat, F.lit(True)).orderBy("frame").collect()] == [None, 0.0]
    zero = spark.createDataFrame([(1, k, 0.0) for k in range(3)], "roi long, frame long, v double")
    assert {r["v"] for r in imaging.relative_change(zero, "mean").collect()} == {0.0}


def test_smoothing_keeps_a_constant_and_medians_remove_a_spot(spark):
    flat = stack(spark, [np.full((6, 6), 7.0)])
    assert all(r["v"] == pytest.approx(7) for r in imaging.gaussian_smooth(flat).collect())
    spot = np.zeros((6, 6))
    spot[3, 3] = 9
    assert {r["v"] for r in imaging.median_smooth(stack(spark, [spot])).collect()} == {0.0}
    assert sum(imaging.gaussian_weights(2.0)) == pytest.approx(1) and len(imaging.gaussian_weights(2.0)) == 9


def test_analyses_ask_for_what_they_need(spark):
    flat = stack(spark, [np.eye(4)] * 3)
    with pytest.raises(ValueError, match="region"):
        imaging.analyse("intensity", flat)
    with pytest.raises(ValueError, match="line"):
        imaging.analyse("kymograph", flat)
    assert imaging.analyse("diameter", flat, line=(1, 1, 4, 4), width=4, height=4).count() == 3
    assert imaging.analyse("dff", flat, F.lit(True), mode="mean").count() == 3


def test_tiff_pages(spark, tmp_path):
    pages = [np.arange(12, dtype=np.uint8).reshape(3, 4) + k for k in range(3)]
    data = tiff(pages)
    assert [p[:, :, 0].tolist() for p in images.pages(data)] == [p.tolist() for p in pages]
    (tmp_path / "a.tif").write_bytes(data)
    got = images.read_tiff(spark, str(tmp_path / "a.tif"))
    assert got.count() == 36 and got.where("frame = 2 and row = 1 and col = 1").first()["v"] == 1
    with pytest.raises(ValueError):
        list(images.pages(b"nothing"))


# --- streams -------------------------------------------------------------------------------------------------------


def replay(spark, rows, schema, build, tmp_path, parts=3):
    """Rows in so many files, one a batch, through a stateful operator; what it gives in all."""
    src = tmp_path / "src"
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = build(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def plain_pass(section, x):
    b0, b1, b2, _, a1, a2 = section
    z1 = z2 = 0.0
    out = []
    for v in x:
        y = b0 * v + z1
        z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 1000])
def test_blocks_of_a_recurrence_are_the_recurrence(n):
    x = np.random.default_rng(n).normal(size=n)
    for s in dsp.design("band", 3, (0.5, 5.0), 1000.0):
        assert np.allclose(dsp.passed(s, x, 0.0, 0.0)[0], plain_pass(s, x), rtol=1e-9, atol=1e-12)


def test_a_filter_carries_its_state_over_batches(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=90)
    sos = dsp.design("low", 3, 100.0, 1000.0)
    schema = "channel long, i long, y double"
    got = replay(spark, [(1, k, float(v)) for k, v in enumerate(x)], schema, lambda s: live.causal_filter(s, sos), tmp_path)
    want = x
    for s in sos:
        want = plain_pass(s, want)
    assert [r["y"] for r in got.orderBy("i").collect()] == pytest.approx(list(want))


def test_onsets_over_batches(spark, tmp_path):
    y = [0, 1, 1, 0, 1, 0, 0, 0, 1, 0, 0, 1] * 5
    got = replay(spark, [(1, k, float(v)) for k, v in enumerate(y)], "channel long, i long, y double", lambda s: live.debounced_onsets(s, 0.5, 6), tmp_path, 4)
    want, last, was = [], -100, 0
    for k, v in enumerate(y):
        if v and not was and k - last >= 6:
            want.append(k)
            last = k
        was = v
    assert sorted(r["i"] for r in got.collect()) == want


def test_haar_levels_are_made_once(spark):
    """As many levels as the waveform has: a level that is made anew for each of its uses takes 64 ** 6 steps."""
    wave = np.random.default_rng(2).normal(size=64)
    low, details = wave, []
    for _ in range(6):
        details.insert(0, (low[::2] - low[1::2]) / np.sqrt(2))
        low = (low[::2] + low[1::2]) / np.sqrt(2)
    df = spark.createDataFrame([(1, wave.tolist())], "spike long, wave array<double>")
    got = spikes.haar(df, 64, levels=6).first()["features"]
    assert np.allclose(got, np.concatenate([low, *details]), atol=1e-12)
