"""Clustering of spikes, drift, merging of clusters, quality and firing rates.

spikes: (spike, t, cluster, wave or features). Cluster 0 is noise and stays noise. Centroids are few (clusters, or bins
by clusters), so folds over them run on the driver; spikes are never gathered there.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cluster as kernels
from ..model import half_away

MERGE_R, MERGE_D = 0.85, 0.5
GRID = [(r / 100, d / 100) for r in range(80, 96, 5) for d in range(40, 61, 5)]
SNR_LEAST, VIOLATIONS_MOST = 2.0, 2.0


def labelled(df: DataFrame, method: str = "kmeans", min_size: int = 20, by: Sequence[str] = (), eps: float | None = None, seed: int = 1, ks: range = range(2, 11), restarts: int | None = None) -> DataFrame:
    """df with cluster, each group (a channel, a bin) by itself in an Arrow kernel; without groups each k is fitted in a
    task of its own, at once, and rows are labelled where they are. `eps` and noise are dbscan's."""
    if method not in ("kmeans", "gmm", "dbscan"):
        raise ValueError(f"unknown clustering {method!r}")
    plain = df.drop("cluster")
    schema = plain.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",cluster:int"
    if not by and method != "dbscan":
        return _population(plain, schema, method, min_size, seed, ks, restarts)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["features"].tolist(), float)
        return pdf.assign(cluster=kernels.selected(x, method, min_size, ks, eps, seed, restarts)[0].astype("int32"))

    return plain.groupBy(*(list(by) or [F.lit("all")])).applyInPandas(run, schema)


def _population(df: DataFrame, schema: str, method: str, min_size: int, seed: int, ks: range, restarts: int | None) -> DataFrame:
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        found = kernels.fitted(np.array(pdf["features"].tolist(), float), method, int(pdf["k"].iloc[0]), min_size, seed, restarts)
        return pd.DataFrame([(pdf["k"].iloc[0], found[1], pickle.dumps(found[0]))] if found else [], columns=["k", "score", "fit"])

    jobs = df.select("features", F.explode(F.array(*(F.lit(k) for k in ks))).alias("k")).repartitionByRange(len(ks), F.desc("k"))
    found = jobs.groupBy("k").applyInPandas(fit, "k int, score double, fit binary").collect()  # a row for each k
    if not found:
        return df.withColumn("cluster", F.lit(0))
    best = pickle.loads(max(sorted(found, key=lambda r: r["k"]), key=lambda r: r["score"])["fit"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                yield pdf.assign(cluster=kernels.assigned(np.array(pdf["features"].tolist(), float), method, best).astype("int32"))

    return df.mapInPandas(run, schema)


def kmeans_at_scale(df: DataFrame, min_size: int = 20, ks: range = range(2, 11), seeds: Sequence[int] = (1,), rounds: int = 500) -> tuple[DataFrame, int, float]:
    """One population too large for a task: distributed k-means for each k, chosen by silhouette."""
    rows, best = df.drop("cluster").withColumn("_v", array_to_vector("features")).cache(), (None, 0, float("nan"))
    for k in ks:
        for seed in seeds:
            model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_v", predictionCol="_c").fit(rows)
            if len(model.summary.clusterSizes) < k or min(model.summary.clusterSizes) < min_size:
                continue
            score = ClusteringEvaluator(featuresCol="_v", predictionCol="_c").evaluate(model.transform(rows))
            if best[0] is None or score > best[2]:
                best = (model, k, score)
    if best[0] is None:
        raise ValueError("no number of clusters keeps every cluster large enough")
    return best[0].transform(rows).withColumn("cluster", F.col("_c") + 1).drop("_v", "_c"), best[1], best[2]


def silhouette(df: DataFrame, features: str = "features") -> float:
    rows = df.withColumn("_v", array_to_vector(features)).withColumn("_c", F.col("cluster").cast("double"))
    return ClusteringEvaluator(featuresCol="_v", predictionCol="_c").evaluate(rows)


def large_enough(df: DataFrame, min_size: int, by: Sequence[str] = ()) -> DataFrame:
    """Clusters below the size become noise. Sizes are aggregated and joined, so a large cluster isn't one task."""
    sizes = df.groupBy(*by, "cluster").agg(F.count("*").alias("_n"))
    return df.join(F.broadcast(sizes), [*by, "cluster"]).withColumn("cluster", F.when(F.col("_n") < min_size, 0).otherwise(F.col("cluster"))).drop("_n")


def time_bins(df: DataFrame, width: float) -> DataFrame:
    """df with bin: right-closed bins of the width from the first time on; the first time is in bin 1."""
    first = df.agg(F.min("t").alias("_t0"))
    return df.crossJoin(F.broadcast(first)).withColumn("bin", F.greatest(F.ceil((F.col("t") - F.col("_t0")) / width), F.lit(1)).cast("long")).drop("_t0")


def bin_minimum(df: DataFrame, min_size: int) -> int:
    bins = df.select("bin").distinct().count()
    return max(2, -(-min_size // max(1, bins)))


def drift_binned(df: DataFrame, width: float, min_size: int = 20, method: str = "kmeans", seed: int = 1, ks: range = range(2, 11), restarts: int | None = None) -> DataFrame:
    """Clusters by time bin; bins that are too small, or without valid clusters, go with their spikes and waveforms."""
    rows = time_bins(df, width)
    least = bin_minimum(rows, min_size)
    sizes = rows.groupBy("bin").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return labelled(rows.join(F.broadcast(sizes), "bin").drop("_n"), method, least, ["bin"], None, seed, ks, restarts).where(F.col("cluster") > 0)


def with_time_feature(df: DataFrame) -> DataFrame:
    """Features with time scaled to 0..1 behind them."""
    ends = df.agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    scaled = F.when(F.col("_b") > F.col("_a"), (F.col("t") - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(0.0)
    return df.crossJoin(F.broadcast(ends)).withColumn("features", F.concat("features", F.array(scaled))).drop("_a", "_b")


def centroids(df: DataFrame, by: Sequence[str] = ("cluster",), value: str = "wave") -> DataFrame:
    """(by, k, v): mean waveforms, sample by sample."""
    rows = df.select(*by, F.posexplode(value).alias("k", "v"))
    return rows.groupBy(*by, (F.col("k") + 1).cast("long").alias("k")).agg(F.avg("v").alias("v"))


def pair_measures(cents: DataFrame) -> DataFrame:
    """(a, b, r, d): Pearson correlation and Euclidean distance of every two centroids, a < b."""
    x, y = cents.select(F.col("cluster").alias("a"), "k", F.col("v").alias("x")), cents.select(F.col("cluster").alias("b"), "k", F.col("v").alias("y"))
    return x.join(y, "k").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.corr("x", "y").alias("r"), F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("d"))


def _relabelled(df: DataFrame, mapping: dict[int, int]) -> DataFrame:
    spark = df.sparkSession
    table = spark.createDataFrame(sorted(mapping.items()), "cluster int, _to int")
    return df.join(F.broadcast(table), "cluster", "left").withColumn("cluster", F.coalesce("_to", F.col("cluster")).cast("int")).drop("_to")


def _sequential(ids: list[int], mapping: dict[int, int], compat: bool) -> dict[int, int]:
    """Final labels 1..K in order; 0 stays 0 (compat: it is numbered like the others)."""
    finals = sorted({mapping.get(i, i) for i in ids})
    number = {c: k + 1 for k, c in enumerate(c for c in finals if c or compat)}
    return {i: number.get(mapping.get(i, i), 0) for i in ids}


def merge_plan(pairs: list[tuple[int, int, float | None, float]], ids: list[int], r: float, d: float, chain: bool, compat: bool = False) -> dict[int, int]:
    """Old to new labels: a pair with correlation above r and distance below d takes the lower label. chain: through
    what the lower one was merged into before; otherwise labels are replaced as they stand."""
    mapping = {i: i for i in ids}
    for a, b, corr, dist in sorted(pairs):
        if corr is None or not (corr > r and dist < d) or (not compat and 0 in (a, b)):
            continue
        if chain:
            mapping[b] = mapping[a]
        else:
            mapping = {i: a if c == b else c for i, c in mapping.items()}
    if chain:
        for i in ids:
            while mapping[mapping[i]] != mapping[i]:
                mapping[i] = mapping[mapping[i]]
    return _sequential(ids, mapping, compat)


def merged(df: DataFrame, r: float = MERGE_R, d: float = MERGE_D, chain: bool = True, compat: bool = False, value: str = "wave") -> DataFrame:
    """Clusters whose centroids are alike become one; labels run from 1."""
    pairs = [(p["a"], p["b"], p["r"], p["d"]) for p in pair_measures(centroids(df, ("cluster",), value)).collect()]  # centroids only
    ids = [x["cluster"] for x in df.select("cluster").distinct().collect()]
    return _relabelled(df, merge_plan(pairs, ids, r, d, chain, compat))


def matched_bins(cents: list[tuple[int, int, np.ndarray]], r: float = MERGE_R, d: float = MERGE_D, compat: bool = False) -> dict[tuple[int, int], int]:
    """(bin, cluster) to a global id: each bin's centroids take the id of the best like centroid of the bin before, by
    r - 0.01 d, or a new one. compat: the match's place in the bin before instead of its id."""
    out: dict[tuple[int, int], int] = {}
    before: list[tuple[int, np.ndarray]] = []
    last = 0
    for b, own in groupby(sorted(cents, key=lambda c: c[:2]), key=lambda c: c[0]):
        now = []
        for _, cluster, v in own:
            best = (-np.inf, None)
            for place, (gid, u) in enumerate(before, 1):
                flat = v.std() == 0 or u.std() == 0
                corr, dist = (0.0 if flat else float(np.corrcoef(u, v)[0, 1])), float(np.linalg.norm(u - v))
                if corr >= r and dist <= d and corr - 0.01 * dist > best[0]:
                    best = (corr - 0.01 * dist, place if compat else gid)
            if best[1] is None:
                last += 1
                best = (0.0, last)
            out[(b, cluster)] = best[1]
            now.append((best[1], v))
        before = now
    return out


def merged_across_bins(df: DataFrame, r: float = MERGE_R, d: float = MERGE_D, compat: bool = False, value: str = "wave") -> DataFrame:
    """df (bin, cluster, wave) with clusters that keep their id from bin to bin."""
    return _across_bins(df, matched_bins([(x["bin"], x["cluster"], x["c"]) for x in _bin_centroids(df, value)], r, d, compat))


def _bin_centroids(df: DataFrame, value: str = "wave") -> list[dict]:
    rows = centroids(df, ("bin", "cluster"), value).groupBy("bin", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("c"))
    return [x.asDict() | {"c": np.array(x["c"], float)} for x in rows.collect()]  # bins x clusters


def _across_bins(df: DataFrame, ids: dict[tuple[int, int], int]) -> DataFrame:
    table = df.sparkSession.createDataFrame([(b, c, g) for (b, c), g in ids.items()], "bin long, cluster int, _to int")
    return df.join(F.broadcast(table), ["bin", "cluster"]).withColumn("cluster", F.col("_to")).drop("_to")


def highest_alike(cents: np.ndarray, ids: Sequence[int], grid: Sequence[tuple[float, float]], compat: bool = False, block: int = 512) -> list[dict[int, tuple[int, float, float]]]:
    """For each (r, d) of the grid: cluster to (a, correlation, distance) with a the highest cluster below it that is
    alike, which is all that chained merging goes by. cents are the centroids of ids, ascending; pairs are made block by
    block and not kept."""
    off = cents - cents.mean(1, keepdims=True)
    flat = cents.max(1) == cents.min(1)
    unit = off / np.where(flat, 1.0, np.sqrt((off**2).sum(1)))[:, None]
    moved = cents - cents.mean(0)
    size, out = (moved**2).sum(1), [{} for _ in grid]
    for at in range(0, len(ids), block):
        upto = min(at + block, len(ids))
        corr = unit[at:upto] @ unit[:upto].T
        dist = np.sqrt(np.maximum(0, size[at:upto, None] + size[:upto] - 2 * moved[at:upto] @ moved[:upto].T))
        usable = np.tri(upto - at, upto, at - 1, dtype=bool) & ~flat[at:upto, None] & ~flat[:upto]
        if not compat:
            zero = np.array(ids[:upto]) == 0
            usable &= ~zero[at:upto, None] & ~zero
        for found, (r, d) in zip(out, grid, strict=True):
            like = usable & (corr > r) & (dist < d)
            for row in np.flatnonzero(like.any(1)).tolist():
                a = int(np.flatnonzero(like[row])[-1])
                found[ids[at + row]] = ids[a], float(corr[row, a]), float(dist[row, a])
    return out


def plan_silhouettes(df: DataFrame, keys: Sequence[tuple[int, int]], n: np.ndarray, mean: np.ndarray, squares: np.ndarray, plans: Sequence[np.ndarray], value: str = "wave", block: int = 1024) -> list[float]:
    """The mean silhouette by squared Euclidean distance of each plan, in one pass over df (bin, cluster, value). A plan
    has a label for each of keys (bin, cluster), whose count, mean and sum of squares are given; a label's points enter by
    their sums, so no pairs are made."""
    middle = (n @ mean) / n.sum()
    place, facts = {key: k for k, key in enumerate(keys)}, []
    for plan in plans:
        _, own = np.unique(plan, return_inverse=True)
        size = np.bincount(own, n)
        sums = np.zeros((len(size), mean.shape[1]))
        np.add.at(sums, own, n[:, None] * (mean - middle))
        about = squares - 2 * n * (mean @ middle) + n * (middle @ middle)
        facts.append((own, size, sums / size[:, None], np.bincount(own, about) / size))
    shared = df.sparkSession.sparkContext.broadcast((place, middle, facts))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (place, middle, facts), total = shared.value, np.zeros(len(plans))
        for pdf in parts:
            x = np.array(pdf[value].tolist(), float).reshape(len(pdf), len(middle)) - middle
            at = np.array([place[key] for key in zip(pdf["bin"].tolist(), pdf["cluster"].tolist(), strict=True)], int)
            for a in range(0, len(x), block):
                part, mine_at = x[a : a + block], at[a : a + block]
                rows = np.arange(len(part))
                for k, (own, size, centre, spread) in enumerate(facts):
                    means = part @ (-2 * centre.T)
                    means += spread
                    means += (part**2).sum(1)[:, None]
                    mine = own[mine_at]
                    inner = np.maximum(0, means[rows, mine]) * size[mine] / np.maximum(size[mine] - 1, 1)
                    means[rows, mine] = np.inf
                    outer = np.maximum(0, means.min(1))
                    s = (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300)
                    total[k] += np.where(size[mine] > 1, s, 0.0).sum()
        yield pd.DataFrame({"plan": range(len(plans)), "total": total})

    found = df.select("bin", "cluster", value).mapInPandas(run, "plan int, total double").groupBy("plan").agg(F.sum("total").alias("total")).collect()
    totals = {r["plan"]: r["total"] for r in found}
    shared.unpersist()
    return [totals[k] / n.sum() for k in range(len(plans))]


def merge_search(df: DataFrame, compat: bool = False) -> tuple[DataFrame, float | None, float | None]:
    """Bins matched, then the grid's merge of best silhouette on waveforms; all noise where none leaves two clusters.

    Ids grow with the bins, so pairs of centroids never become a table: the driver holds a mean for each bin and cluster,
    compares ids in blocks, and all merges are scored in one pass over the spikes.
    """
    sizes = df.groupBy("bin", "cluster").agg(F.count("*").alias("n"), F.sum(F.aggregate("wave", F.lit(0.0), lambda a, v: a + v * v)).alias("q")).collect()  # bins x clusters
    facts = {(x["bin"], x["cluster"]): (x["n"], x["q"]) for x in sizes}
    cents = {(x["bin"], x["cluster"]): x["c"] for x in _bin_centroids(df)}
    keys = sorted(cents)
    found = matched_bins([(*key, cents[key]) for key in keys], compat=compat)
    n, squares = (np.array([facts[key][k] for key in keys], float) for k in (0, 1))
    ids, own = np.unique(np.array([found[key] for key in keys], int), return_inverse=True)
    best, plans, order = (None, None, None, None), {}, []
    if len(keys):
        mean = np.stack([cents[key] for key in keys])
        sums = np.zeros((len(ids), mean.shape[1]))
        np.add.at(sums, own, n[:, None] * mean)
        names = ids.tolist()
        for (r, d), alike in zip(GRID, highest_alike(sums / np.bincount(own, n)[:, None], names, GRID, compat), strict=True):
            plan = merge_plan([(a, b, corr, dist) for b, (a, corr, dist) in alike.items()], names, r, d, True, compat)
            if len({c for c in plan.values() if c}) >= 2:
                order.append((r, d, plan, tuple(plan[c] for c in names)))
                plans.setdefault(order[-1][-1], len(plans))
    if order:
        scores = plan_silhouettes(df, keys, n, mean, squares, [np.array(p)[own] for p in plans])
        for r, d, plan, key in order:
            if best[0] is None or scores[plans[key]] > best[0]:
                best = (scores[plans[key]], plan, r, d)
    if best[1] is None:
        return _across_bins(df, found).withColumn("cluster", F.lit(0)), None, None
    return _across_bins(df, {key: best[1][c] for key, c in found.items()}), best[2], best[3]


def signal_to_noise(df: DataFrame, fs: float, quiet_ms: float = 0.5) -> DataFrame:
    """(cluster, snr): peak-to-peak of the mean waveform by twice the deviation of all spikes' first samples."""
    n = half_away(quiet_ms / 1000 * fs)
    rows = df.select("cluster", F.posexplode("wave").alias("k", "v"))
    noise = rows.where(F.col("k") < n).groupBy("cluster").agg(F.stddev_samp("v").alias("noise"))
    mean = rows.groupBy("cluster", "k").agg(F.avg("v").alias("v")).groupBy("cluster").agg((F.max("v") - F.min("v")).alias("span"))
    return mean.join(noise, "cluster").select("cluster", F.when(F.col("noise") > 0, F.col("span") / (2 * F.col("noise"))).alias("snr"))


def violations(df: DataFrame, refractory_s: float) -> DataFrame:
    """(cluster, n, violations): percent of intervals below the refractory time; 0 for a single spike."""
    gap = F.col("t") - F.lag("t").over(W.partitionBy("cluster").orderBy("t"))
    rows = df.withColumn("_g", gap)
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), (F.lit(100.0) * F.sum(F.when(F.col("_g") < refractory_s, 1).otherwise(0)) / F.greatest(F.lit(1), F.count("_g"))).alias("violations"))


def quality(df: DataFrame, fs: float, refractory_s: float, snr_least: float = SNR_LEAST, violations_most: float = VIOLATIONS_MOST) -> DataFrame:
    """(cluster, n, snr, violations, rejected, reason). Noise is never rejected."""
    rows = violations(df, refractory_s).join(signal_to_noise(df, fs), "cluster")
    low, fast = F.when(F.col("snr") < snr_least, "low SNR"), F.when(F.col("violations") > violations_most, "ISI violations")
    reason = F.when(F.col("cluster") != 0, F.concat_ws(", ", low, fast)).otherwise("")
    return rows.withColumn("reason", reason).withColumn("rejected", F.col("reason") != "")


def firing_rate(df: DataFrame, width: float, as_share: bool = False, by: Sequence[str] = ("cluster",)) -> DataFrame:
    """(by, bin, centre, rate): counts in bins from the first spike on, per second or as a share of all counted.
    Empty bins have 0; a partial last bin goes; its opening edge belongs to the bin before."""
    by = list(by)
    ends = df.groupBy(*by).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    ends = ends.withColumn("bins", F.floor((F.col("t1") - F.col("t0")) / width + 1e-9).cast("long")).where(F.col("bins") > 0)
    edges = ends.select(*by, "t0", "bins", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    place = F.floor((F.col("t") - F.col("t0")) / width + 1e-9).cast("long")
    at_end = (place == F.col("bins")) & (F.abs(F.col("t") - F.col("t0") - F.col("bins") * width) < 1e-9)
    counts = df.join(ends, by).withColumn("bin", F.when(at_end, F.col("bins") - 1).otherwise(place)).where(F.col("bin") < F.col("bins")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    rows = edges.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rate = F.col("n") / F.sum("n").over(W.partitionBy(*by)) if as_share else F.col("n") / F.lit(float(width))
    return rows.select(*by, "bin", (F.col("t0") + (F.col("bin") + 0.5) * width).alias("centre"), rate.alias("rate"))


def chosen(df: DataFrame, clusters: Sequence[int] | None = None) -> DataFrame:
    """Some clusters; None is all but noise."""
    return df.where(F.col("cluster") > 0) if clusters is None else df.where(F.col("cluster").isin(list(clusters)))


def with_amplitude(df: DataFrame) -> DataFrame:
    return df.withColumn("amplitude", F.array_max("wave"))


def clean_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Labels that aren't finite become 0, others are rounded."""
    x = F.col(label).cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.withColumn("cluster", F.when(ok, F.round(x)).otherwise(0).cast("int"))


def sample_index(df: DataFrame, t1: float, fs: float) -> DataFrame:
    return df.withColumn("i", (F.round((F.col("t") - t1) * fs) + 1).cast("long"))


def require_same_count(features: DataFrame, spikes: DataFrame) -> None:
    if features.count() != spikes.count():
        raise ValueError("features and spikes differ in number")
