"""Clustering, embedding and drift queries, which SQL can't express, against plain versions over the whole test table."""

from itertools import combinations

import numpy as np
import pytest

from axonframe.functions import cluster as kernels
from axonframe.functions import scan
from axonframe.operators import clusters
from axonframe.plans import catalog
from axonframe.sources import views as V


@pytest.fixture(scope="module")
def spikes(spark, sf):
    return sorted((r.asDict() for r in V.waves(spark, sf).collect()), key=lambda r: r["spike"])


def column(spark, sf, name, *columns):
    return {r["spike"]: tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, sf).collect()}


def matrix(found, spikes):
    return np.array([found[r["spike"]] for r in spikes], float)


def silhouette(x, labels):
    """Squared distances, as the engine's, point by point."""
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    out = []
    for k in range(len(x)):
        own = labels == labels[k]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[k][own].sum() / (own.sum() - 1)
        b = min(d[k][labels == c].mean() for c in set(labels.tolist()) - {labels[k]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_principal_components(spark, sf, spikes):
    x = np.array([r["wave"] for r in spikes])
    values, vectors = np.linalg.eigh(np.cov(x.T))
    got = matrix(column(spark, sf, "G14_principal", "f1", "f2", "f3"), spikes)
    for k in range(3):
        v = vectors[:, -1 - k] * np.sign(vectors[np.abs(vectors[:, -1 - k]).argmax(), -1 - k])
        assert values[-1 - k] > values[-2 - k] and np.allclose(got[:, k], x @ v, atol=2e-6)


def test_independent_components_are_a_fixed_point(spark, sf, spikes):
    """Unit, uncorrelated projections whose next step of the iteration gives the same directions."""
    s = matrix(column(spark, sf, "G15_independent", "f1", "f2", "f3"), spikes)
    assert np.allclose(s.T @ s / len(s), np.eye(3), atol=1e-4)
    g = np.tanh(s)
    step = g.T @ s / len(s) - np.diag((1 - g**2).mean(0))
    a, _, b = np.linalg.svd(step)
    assert np.allclose(np.abs(np.diag(a @ b)), 1, atol=1e-3)


def test_embedding_keeps_neighbours(spark, sf, spikes):
    """Of each spike's ten nearest waveforms far more are near in the plane than chance would put there."""
    x = np.array([r["wave"] for r in spikes])
    y = matrix(column(spark, sf, "G18_embedded", "f1", "f2"), spikes)
    near = [{*np.argsort(((z - z[k]) ** 2).sum(1))[1:11].tolist()} for z in (x, y) for k in range(len(x))]
    shared = np.mean([len(a & b) for a, b in zip(near[: len(x)], near[len(x) :], strict=True)]) / 10
    assert shared > 3 * 10 / len(x)


def features(spikes):
    return np.array([r["wave"][:3] for r in spikes])


@pytest.mark.parametrize("method", ["kmeans", "gmm"])
def test_the_best_number_of_clusters_is_chosen(spark, sf, spikes, method):
    x = features(spikes)
    got = matrix(column(spark, sf, {"kmeans": "G20_kmeans", "gmm": "G21_gmm"}[method], "cluster"), spikes)[:, 0].astype(int)
    best = (-2.0, None)
    for k in range(2, 11):
        labels = kernels.kmeans(x, k) if method == "kmeans" else kernels.mixture(x, k)
        if labels is not None and min(np.bincount(labels, minlength=k + 1)[1:]) >= 5:
            score = silhouette(x, labels)
            best = max(best, (score, k), key=lambda b: b[0]) if best[1] else (score, k)
    assert len(set(got.tolist())) == best[1] and silhouette(x, got) == pytest.approx(best[0], abs=1e-9)
    if method == "kmeans":  # a local optimum: every spike is nearest to the mean of its own cluster
        means = np.array([x[got == c].mean(0) for c in range(1, best[1] + 1)])
        assert (((x[:, None] - means) ** 2).sum(-1).argmin(1) + 1 == got).all()


def plain_dbscan(x, least, eps):
    near = [[j for j in range(len(x)) if np.linalg.norm(x[k] - x[j]) <= eps] for k in range(len(x))]
    core = {k for k in range(len(x)) if len(near[k]) >= least}
    parent = {k: k for k in core}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k in core:
        for j in near[k]:
            if j in core:
                a, b = sorted((top(k), top(j)))
                parent[b] = a
    number = {r: n + 1 for n, r in enumerate(sorted({top(k) for k in core}))}
    return core, {k: number[top(k)] for k in core}, near


def test_density_clusters(spark, sf, spikes):
    x = features(spikes)
    far = [sorted(np.linalg.norm(x - p, axis=1))[10] for p in x]
    core, label, near = plain_dbscan(x, 10, np.percentile(far, 95, method="hazen"))
    got = [int(c) for (c,) in (column(spark, sf, "G22_dbscan", "cluster")[r["spike"]] for r in spikes)]
    for k, c in enumerate(got):
        if k in core:
            assert c == label[k]
        else:
            assert c in {label[j] for j in near[k] if j in core} or (c == 0 and not any(j in core for j in near[k]))


def test_drift_bins_are_clustered_one_by_one(spark, sf, spikes):
    x, t = features(spikes), np.array([r["t"] for r in spikes])
    bins = np.maximum(np.ceil((t - t.min()) / 4.0), 1).astype(int)
    least = max(2, -(-10 // len(set(bins.tolist()))))
    want = {}
    for b in sorted(set(bins.tolist())):
        at = np.flatnonzero(bins == b)
        if len(at) >= least:
            labels = kernels.selected(x[at], "kmeans", least)[0]
            want |= {(spikes[k]["spike"], b): c for k, c in zip(at, labels.tolist(), strict=True) if c}
    got = {(r["spike"], r["bin"]): r["cluster"] for r in catalog.QUERIES["G23_drift_binned"](spark, sf).collect()}
    assert got.keys() == want.keys()
    for b in {b for _, b in want}:  # the same parts, whatever their numbers: rows may come in another order
        pairs = {(want[k], got[k]) for k in want if k[1] == b}
        assert len(pairs) == len({a for a, _ in pairs})


def mean_waves(spikes, labels):
    return {c: np.mean([r["wave"] for r, k in zip(spikes, labels, strict=True) if k == c], axis=0) for c in sorted(set(labels))}


def alike(a, b):
    return float(np.corrcoef(a, b)[0, 1]), float(np.linalg.norm(a - b))


def test_time_is_a_feature_of_dynamic_drift(spark, sf, spikes):
    t = np.array([r["t"] for r in spikes])
    x = np.column_stack((features(spikes), (t - t.min()) / (t.max() - t.min())))
    first = {r["spike"]: r["cluster"] for r in clusters.labelled(clusters.with_time_feature(catalog_features(spark, sf)), "kmeans", 5).collect()}
    labels = np.array([first[r["spike"]] for r in spikes])
    scores = {k: silhouette(x, kernels.kmeans(x, k)) for k in range(2, 11) if min(np.bincount(kernels.kmeans(x, k), minlength=k + 1)[1:]) >= 5}
    assert silhouette(x, labels) == pytest.approx(max(scores.values()), abs=1e-9)
    now = labels.tolist()
    waves = mean_waves(spikes, now)
    for a, b in combinations(waves, 2):
        r, d = alike(waves[a], waves[b])
        if r > 0.8 and d < 0.5:
            to, gone = a, b
            now = [to if c == gone else c for c in now]
    numbers = {c: k + 1 for k, c in enumerate(sorted(set(now)))}
    got = column(spark, sf, "G24_drift_dynamic", "cluster")
    assert [got[r["spike"]][0] for r in spikes] == [numbers[c] for c in now]


def catalog_features(spark, sf):
    from axonframe.operators import spikes as G

    return G.first_samples(V.waves(spark, sf), 3)


def through_bins(spikes, bins, r_least, d_most):
    """Ids that run from bin to bin, cluster by cluster."""
    ids, before, last = {}, [], 0
    for b in sorted(set(bins)):
        own = [r for r, x in zip(spikes, bins, strict=True) if x == b]
        now = []
        for c, wave in mean_waves(own, [r["cluster"] for r in own]).items():
            best = None
            for gid, u in before:
                r, d = alike(u, wave)
                if r >= r_least and d <= d_most and (best is None or r - 0.01 * d > best[0]):
                    best = (r - 0.01 * d, gid)
            if best is None:
                last += 1
                best = (0.0, last)
            ids[b, c] = best[1]
            now.append((best[1], wave))
        before = now
    return [ids[b, r["cluster"]] for b, r in zip(bins, spikes, strict=True)]


def test_merge_search_is_the_best_of_the_grid(spark, sf, spikes):
    t = np.array([r["t"] for r in spikes])
    bins = np.maximum(np.ceil((t - t.min()) / 4.0), 1).astype(int).tolist()
    base = through_bins(spikes, bins, clusters.MERGE_R, clusters.MERGE_D)
    waves, x = mean_waves(spikes, base), np.array([r["wave"] for r in spikes])
    pairs = {(a, b): alike(waves[a], waves[b]) for a, b in combinations(waves, 2)}
    best = None
    for r_least in (0.80, 0.85, 0.90, 0.95):
        for d_most in (0.40, 0.45, 0.50, 0.55, 0.60):
            to = {c: c for c in waves}
            for (a, b), (r, d) in pairs.items():
                if r > r_least and d < d_most:
                    to[b] = to[a]
            numbers = {c: k + 1 for k, c in enumerate(sorted(set(to.values())))}
            labels = [numbers[to[c]] for c in base]
            if len(numbers) >= 2:
                score = silhouette(x, np.array(labels))
                if best is None or score > best[0] + 1e-12:
                    best = (score, labels)
    got = column(spark, sf, "G29_merge_search", "cluster")
    assert best and [got[r["spike"]][0] for r in spikes] == best[1]


# --- rules in one pass ---------------------------------------------------------------------------------------------


def plain_spaced(at, moved, gap):
    kept, last = [], None
    for k, i in enumerate(at):
        if last is None or i - last >= gap:
            kept.append(k)
            last = moved[k]
    return kept


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_passes_do_not_depend_on_batches(spark, batch):
    rng = np.random.default_rng(3)
    rows = [(c, int(i), float(rng.integers(0, 4)), None) for c in (None, 1, 2, 3) for i in np.flatnonzero(rng.random(300) < (0.02, 0.1, 0.5, 0.9)[c or 0])]
    df = spark.createDataFrame(rows, "channel long, i long, y double, t double").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        from axonframe.operators import spikes as G
        from axonframe.operators import trials as D

        gaps = sorted((r["channel"] or 0, r["i"]) for r in D.greedy_gap(df, 7).collect())
        tall = sorted((r["channel"] or 0, r["i"], r["y"]) for r in G.suppressed(df, 4).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want_gaps, want_tall = [], []
    for c in (None, 1, 2, 3):
        own = [(i, y) for k, i, y, _ in rows if k == c]
        want_gaps += [(c or 0, own[k][0]) for k in plain_spaced([i for i, _ in own], [i for i, _ in own], 7)]
        kept = []
        for i, y in sorted(own, key=lambda p: (-p[1], p[0])):
            if all(abs(i - j) > 4 for j, _ in kept):
                kept.append((i, y))
        want_tall += [(c or 0, i, y) for i, y in kept]
    assert gaps == sorted(want_gaps) and tall == sorted(want_tall)


def test_moved_samples_keep_the_gap():
    rng = np.random.default_rng(6)
    for _ in range(50):
        at = np.flatnonzero(rng.random(60) < 0.4)
        moved = at + rng.integers(-3, 4, len(at))
        kept, last = scan.spaced(at, moved, 5, None)
        assert kept.tolist() == plain_spaced(at.tolist(), moved.tolist(), 5)
        assert last == (int(moved[kept[-1]]) if len(kept) else None)


# --- the work of a large population -------------------------------------------------------------------------------


@pytest.mark.parametrize("method", ["kmeans", "gmm"])
def test_no_pairs_of_points_are_made(monkeypatch, method):
    """What is compared are points with centres: distances of a block to all points would be the square of the points."""
    x = np.random.default_rng(4).normal(size=(3000, 3)) + np.repeat([[0, 0, 0], [6, 0, 0], [0, 6, 0]], 1000, axis=0)
    made = []
    monkeypatch.setattr(kernels, "distances", lambda a, b, f=kernels.distances: made.append(len(a) * len(b)) or f(a, b))
    labels, score, k = kernels.selected(x, method, 20, range(2, 5))
    assert k == 3 and max(made, default=0) <= 10 * len(x)
    assert score == pytest.approx(silhouette(x, labels), abs=1e-9)


@pytest.mark.parametrize("method", ["kmeans", "gmm"])
def test_a_population_is_fitted_once(spark, sf, method):
    """Rows are labelled where they are by what was fitted; reading the labels twice fits nothing again."""
    found = clusters.labelled(catalog_features(spark, sf), method, 5, ks=range(2, 4))
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    want = kernels.selected(features(sorted((r.asDict() for r in found.collect()), key=lambda r: r["spike"])), method, 5, range(2, 4))[2]
    assert found.select("cluster").distinct().count() == want


def test_a_population_too_small_for_clusters_is_noise(spark, sf):
    assert {r["cluster"] for r in clusters.labelled(catalog_features(spark, sf), "kmeans", 400).collect()} == {0}
    assert clusters.labelled(catalog_features(spark, sf).where("spike < 0"), "kmeans", 5).count() == 0


@pytest.mark.parametrize("compat", [False, True])
def test_merge_search_makes_no_table_of_pairs(spark, monkeypatch, compat):
    """Ids that grow with the bins: the search by blocks and sums equals that by all pairs and whole silhouettes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(clusters, "pair_measures", None)
    rng = np.random.default_rng(5)
    shapes = rng.normal(size=(6, 16)) / 4
    rows = []
    for k in range(600):
        b, c = k // 60 + 1, int(rng.integers(0, 4))
        c = 2 if c == 1 and b in (4, 5, 8) else c  # away for a while, then under a new id
        shape = shapes[c] if c else rng.normal(size=16)
        rows.append((k, k / 60, b, c, (shape + rng.normal(size=16) / 40).tolist()))
    df = spark.createDataFrame(rows, "spike long, t double, bin long, cluster int, wave array<double>")
    base = clusters.merged_across_bins(df, compat=compat)
    if compat:
        base = base.withColumn("cluster", F.col("cluster").cast("int"))
    labels = {r["spike"]: r["cluster"] for r in base.collect()}
    x, own = np.array([r[-1] for r in rows]), np.array([labels[r[0]] for r in rows])
    ids = sorted(set(own.tolist()))
    means = {c: x[own == c].mean(0) for c in ids}
    pairs = [(a, b, *alike(means[a], means[b])) for a, b in combinations(ids, 2)]
    best = None
    for r, d in clusters.GRID:
        plan = clusters.merge_plan(pairs, ids, r, d, True, compat)
        got = np.array([plan[c] for c in own.tolist()])
        if len(set(plan.values())) >= 2:
            score = silhouette(x, got)
            if best is None or score > best[0] + 1e-12:
                best = (score, r, d, got)
    found, r, d = clusters.merge_search(df, compat)
    assert len(ids) > len(set(best[3].tolist())) and (r, d) == best[1:3]
    got = {q["spike"]: q["cluster"] for q in found.collect()}
    assert [got[q[0]] for q in rows] == best[3].tolist()


def test_embedding_of_many_spikes_makes_no_square(monkeypatch):
    """Above neighbours.EXACT: forces near those of all pairs, neighbourhoods kept, and no block as large as n x n / 4."""
    from axonframe.functions import neighbours

    rng = np.random.default_rng(7)
    for spread in (1e-4, 1.0, 12.0):
        y = rng.normal(scale=spread, size=(2000, 2))
        (want, total), (got, near) = neighbours.repulsion(y), neighbours.plane_repulsion(y)
        assert near == pytest.approx(total, rel=2e-2) and np.abs(got - want).max() < 0.05 * np.abs(want).max()
    middle = rng.normal(scale=8, size=(8, 10))
    own = rng.integers(0, 8, 2000)
    x = middle[own] + rng.normal(size=(2000, 10))
    monkeypatch.setattr(neighbours, "repulsion", None)
    y = neighbours.embedded(x, 2)
    d = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert np.isfinite(y).all() and (own[d.argmin(1)] == own).mean() > 0.97
