"""Queries of spike detection, alignment, clustering, quality and rates (G)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters as K
from ..operators import spikes as G
from ..sources import views as V
from . import signals
from .signals import FS, onsets, query

MADS = """md AS (SELECT channel, median(y) AS med FROM {0} GROUP BY 1), mm AS (SELECT channel, any_value(med) AS med, 1.4826::DOUBLE * median(abs(y - med)) AS mad FROM {0} JOIN md USING (channel) GROUP BY 1)"""
NEO = "neo AS (SELECT channel, i, t, y * y - coalesce(lag(y) OVER w, 0) * coalesce(lead(y) OVER w, 0) AS y FROM sig WINDOW w AS (PARTITION BY channel ORDER BY i))"
UNIT = "uni AS (SELECT channel, i, t, CASE WHEN max(y) OVER w > min(y) OVER w THEN (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) ELSE 0 END AS y FROM sig WINDOW w AS (PARTITION BY channel))"
HAZEN = """SELECT {keys}, max(v) FILTER (k = floor(p)) + (max(v) FILTER (k = ceil(p)) - max(v) FILTER (k = floor(p))) * (max(p) - floor(max(p))) AS {out} FROM
  (SELECT *, least(greatest(n * ({q}::DOUBLE / 100) + 0.5, 1), n) AS p FROM (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS k, count(*) OVER (PARTITION BY {keys}) AS n FROM {src})) GROUP BY {keys}"""


@query("G01_threshold_standard", "channel", "threshold", "SELECT channel, avg(y) + 2 * stddev_samp(y) AS threshold FROM sig GROUP BY 1")
def _(spark, d):
    return G.thresholds(V.signal(spark, d), "standard", 2.0)


@query("G02_threshold_mad", "channel", "threshold", "SELECT channel, med + 2 * mad AS threshold FROM mm", MADS.format("sig"))
def _(spark, d):
    return G.thresholds(V.signal(spark, d), "mad", 2.0)


@query("G03_threshold_neo", "channel", "threshold", "SELECT channel, med + 2 * mad AS threshold FROM mm", NEO + ", " + MADS.format("neo"))
def _(spark, d):
    return G.thresholds(G.prepared(V.signal(spark, d), "neo"), "neo", 2.0)


@query("G03_threshold_neo_compat", "channel", "threshold", "SELECT channel, med + 2 * mad AS threshold FROM mm", UNIT + ", " + MADS.format("uni"))
def _(spark, d):
    return G.thresholds(G.prepared(V.signal(spark, d), "neo", compat=True), "neo", 2.0)


ROLL = """rl AS (SELECT channel, i, list(y) OVER w AS ys, median(y) OVER w AS m FROM sig WINDOW w AS (PARTITION BY channel ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))"""


@query("G04_threshold_rolling", "channel, i", "threshold", "SELECT channel, i, m + 2 * 1.4826::DOUBLE * list_aggregate(list_transform(ys, lambda x: abs(x - m)), 'median') AS threshold FROM rl", ROLL)
def _(spark, d):
    return G.rolling_thresholds(V.signal(spark, d), 5, 2.0)


@query("G05_threshold_percentile", "channel", "threshold", HAZEN.format(keys="channel", value="abs(y)", q=99.9, src="sig", out="threshold"))
def _(spark, d):
    return G.thresholds(V.signal(spark, d), "percentile")


CAND = """rn AS (SELECT channel, i, t, y, sum(CASE WHEN p IS NULL OR y <> p THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY i) AS r FROM (SELECT channel, i, t, {0} AS y, lag({0}) OVER (PARTITION BY channel ORDER BY i) AS p FROM sig)),
rs AS (SELECT channel, r, min(i) AS i, min(t) AS t, any_value(y) AS y FROM rn GROUP BY 1, 2),
cd AS (SELECT channel, i, t, y FROM (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM rs WINDOW w AS (PARTITION BY channel ORDER BY r)) WHERE y > a AND y > b)"""
#: Peaks apart by more than 3: a taller (or as tall, earlier) kept neighbour removes; rounds settle who is kept.
KEPT = """pk AS (WITH RECURSIVE s(channel, k, i, kept) AS (
  SELECT channel, 0, NULL::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT channel FROM od) UNION ALL
  SELECT s.channel, s.k + 1, o.i, CASE WHEN len(list_filter(s.kept, lambda x: abs(x - o.i) <= 3)) = 0 THEN list_append(s.kept, o.i) ELSE s.kept END FROM s JOIN od o ON o.channel = s.channel AND o.k = s.k + 1),
  l AS (SELECT channel, unnest(arg_max(kept, k)) AS i FROM s GROUP BY channel) SELECT * FROM l)"""
OVER = "od AS (SELECT channel, i, t, y, row_number() OVER (PARTITION BY channel ORDER BY y DESC, i) AS k FROM cd JOIN th USING (channel) WHERE y > threshold)"


def _detected(sign: str) -> str:
    return f"th AS (SELECT channel, avg({sign}y) + 0.8::DOUBLE * stddev_samp(y) AS threshold FROM sig GROUP BY 1), {CAND.format(sign + 'y')}, {OVER}, {KEPT}"


@query("G06_detected_negative", "channel, i, sign", "t, y", "SELECT channel, i, -1 AS sign, t, -y AS y FROM pk JOIN od USING (channel, i)", _detected("-"))
def _(spark, d):
    return G.detected(V.signal(spark, d), "standard", "negative", 0.8, 3)


def _renamed(sql: str, by: str) -> str:
    for name in ("th", "rn", "rs", "cd", "od", "pk"):
        sql = re.sub(rf"\b{name}\b", f"{name}{by}", sql)
    return sql


def _side(sign: str, level: str, by: str) -> str:
    return _renamed(f"th AS (SELECT channel, {level} AS threshold FROM mm), {CAND.format(sign + 'y')}, {OVER}, {KEPT}", by)


@query("G06_detected_both", "channel, i, sign", "t, y", "SELECT channel, i, 1 AS sign, t, y FROM pku JOIN odu USING (channel, i) UNION ALL SELECT channel, i, -1, t, -y FROM pkd JOIN odd USING (channel, i)",
  MADS.format("sig") + ", " + _side("", "med + 0.8::DOUBLE * mad", "u") + ", " + _side("-", "-(med - 0.8::DOUBLE * mad)", "d"))
def _(spark, d):
    return G.detected(V.signal(spark, d), "mad", "both", 0.8, 3)


@query("G07_both_thresholds", "method, channel", "high, low", "SELECT 'mad' AS method, channel, med + 2 * mad AS high, med - 2 * mad AS low FROM mm UNION ALL SELECT 'standard', channel, avg(y) + 2 * stddev_samp(y), -(avg(y) + 2 * stddev_samp(y)) FROM sig GROUP BY channel", MADS.format("sig"))
def _(spark, d):
    sig = V.signal(spark, d)
    return G.both_thresholds(sig, "mad", 2.0).withColumn("method", F.lit("mad")).unionByName(G.both_thresholds(sig, "standard", 2.0).withColumn("method", F.lit("standard")))


@query("G08_peaks", "channel, i", "t, y", "SELECT channel, i, t, y FROM pk JOIN od USING (channel, i)", _detected(""))
def _(spark, d):
    sig = V.signal(spark, d)
    return G.peaks(sig, G.thresholds(sig, "standard", 0.8), 3)


CROSS = """ab AS (SELECT channel, i, arg_min(j, (-yj, j)) AS j FROM (SELECT s.channel, s.i, s.y, p.i AS j, p.y AS yj FROM sig s JOIN sig p ON p.channel = s.channel AND p.i BETWEEN s.i - 2 AND s.i + 2 WHERE s.y > 80) GROUP BY 1, 2),
cr AS (WITH RECURSIVE k(channel, j) AS (SELECT channel, arg_min(j, i) FROM ab GROUP BY channel UNION ALL
  SELECT k.channel, (SELECT arg_min(a.j, a.i) FROM ab a WHERE a.channel = k.channel AND a.i > k.j + 4) FROM k WHERE EXISTS (SELECT 1 FROM ab a WHERE a.channel = k.channel AND a.i > k.j + 4)) SELECT channel, j AS i FROM k)"""


@query("G09_crossings", "channel, i", "", "SELECT channel, i FROM cr", CROSS)
def _(spark, d):
    sig = V.signal(spark, d)
    return G.crossings(sig, sig.select("channel").distinct().withColumn("threshold", F.lit(80.0)), 4, 2)


@query("G10_refractory", "fs, samples", "", "SELECT * FROM (VALUES (1000, 1), (24414, 24), (2500, 3)) v(fs, samples)")
def _(spark, d):
    return spark.createDataFrame([(fs, G.refractory_samples(1.0, fs)) for fs in (1000, 24414, 2500)], "fs int, samples int")


@query("G11_enough_spikes", "n, refused", "", "SELECT * FROM (VALUES (20, false), (100000, true)) v(n, refused)")
def _(spark, d):
    return spark.createDataFrame([(n, signals._refused(lambda n=n: G.require_enough(V.waves(spark, d), n))) for n in (20, 100000)], "n int, refused boolean")


ALIGN = """nr AS (SELECT o.channel, o.i AS o, o.t, arg_min(s.i, (s.y, s.i)) AS c, count(*) AS n FROM ons o JOIN sig s ON s.channel = o.channel AND s.i BETWEEN o.i - 2 AND o.i + 3 GROUP BY 1, 2, 3),
wv AS (SELECT n.channel, n.o AS i, any_value(n.t) AS t, any_value(n.c) AS centre, list(s.y ORDER BY s.i) AS w FROM nr n JOIN sig s ON s.channel = n.channel AND s.i BETWEEN n.c - 3 AND n.c + 3 WHERE n.n = 6 GROUP BY 1, 2 HAVING count(*) = 7)"""


@query("G12_aligned", "channel, i, centre", "t, first, mid, last", "SELECT channel, i, centre, t, w[1] AS first, w[4] AS mid, w[7] AS last FROM wv", ALIGN)
def _(spark, d):
    out = G.aligned(V.signal(spark, d), onsets(spark, d), 3, 2, 3)
    return out.select("*", F.element_at("wave", 1).alias("first"), F.element_at("wave", 4).alias("mid"), F.element_at("wave", 7).alias("last"))


@query("G13_snippets", "channel, i, n", "total", "SELECT o.channel, o.i, CASE WHEN count(*) = 7 THEN 7 ELSE -1 END AS n, CASE WHEN count(*) = 7 THEN sum(s.y) END AS total FROM ons o JOIN sig s ON s.channel = o.channel AND s.i BETWEEN o.i - 3 AND o.i + 3 GROUP BY 1, 2")
def _(spark, d):
    out = G.snippets(V.signal(spark, d), onsets(spark, d).select("channel", "i"), 3, 3, whole_only=False)
    return out.select("channel", "i", F.coalesce(F.size("wave"), F.lit(-1)).alias("n"), F.aggregate("wave", F.lit(0.0), lambda a, x: a + x).alias("total"))


def _wide(df: DataFrame, k: int) -> DataFrame:
    return df.select("*", *(F.element_at("features", n + 1).alias(f"f{n + 1}") for n in range(k)))


@query("G14_principal", "spike", "f1, f2, f3")
def _(spark, d):
    return _wide(G.principal(V.waves(spark, d), 3), 3)


@query("G15_independent", "spike", "f1, f2, f3")
def _(spark, d):
    return _wide(G.independent(V.waves(spark, d), 3), 3)


@query("G16_first_samples", "spike", "f1, f2, f3", "SELECT spike, wave[1] AS f1, wave[2] AS f2, wave[3] AS f3 FROM wav")
def _(spark, d):
    return _wide(G.first_samples(V.waves(spark, d), 3), 3)


@query("G17_haar", "spike", "f1, f2, f3, f9", """SELECT spike, list_sum(wave[1:8]) / sqrt(2)::DOUBLE / 2 AS f1, list_sum(wave[9:16]) / sqrt(2)::DOUBLE / 2 AS f2, list_sum(wave[17:24]) / sqrt(2)::DOUBLE / 2 AS f3,
  (list_sum(wave[1:4]) - list_sum(wave[5:8])) / sqrt(2)::DOUBLE / 2 AS f9 FROM wav""")
def _(spark, d):
    return G.haar(V.waves(spark, d), 16).select("spike", *(F.element_at("features", k).alias(f"f{k}") for k in (1, 2, 3, 9)))


@query("G18_embedded", "spike", "f1, f2")
def _(spark, d):
    return _wide(G.embedded(V.waves(spark, d), 2), 2)


@query("G19_standardised", "spike", "f1, f2", "SELECT spike, (wave[1] - avg(wave[1]) OVER ()) / stddev_samp(wave[1]) OVER () AS f1, (wave[2] - avg(wave[2]) OVER ()) / stddev_samp(wave[2]) OVER () AS f2 FROM wav")
def _(spark, d):
    return _wide(G.standardised(G.first_samples(V.waves(spark, d), 2)), 2)


def _features(spark, d) -> DataFrame:
    return G.first_samples(V.waves(spark, d), 3)


@query("G20_kmeans", "spike, cluster", "")
def _(spark, d):
    return K.labelled(_features(spark, d), "kmeans", 5)


@query("G21_gmm", "spike, cluster", "")
def _(spark, d):
    return K.labelled(_features(spark, d), "gmm", 5)


@query("G22_dbscan", "spike, cluster", "")
def _(spark, d):
    return K.labelled(_features(spark, d), "dbscan", 10)


@query("G23_drift_bins", "spike, bin", "", "SELECT spike, greatest(ceil((t - min(t) OVER ()) / 2.0::DOUBLE), 1)::BIGINT AS bin FROM wav")
def _(spark, d):
    return K.time_bins(V.waves(spark, d), 2.0)


@query("G23_drift_binned", "spike, bin, cluster", "")
def _(spark, d):
    return K.drift_binned(_features(spark, d), 4.0, 10)


@query("G24_drift_dynamic", "spike, cluster", "")
def _(spark, d):
    return K.merged(K.labelled(K.with_time_feature(_features(spark, d)), "kmeans", 5), 0.8, 0.5, chain=False)


@query("G25_large_enough", "spike, cluster", "", "SELECT spike, CASE WHEN count(*) OVER (PARTITION BY cluster) < 50 THEN 0 ELSE cluster END AS cluster FROM wav")
def _(spark, d):
    return K.large_enough(V.waves(spark, d), 50)


def _binned(spark, d) -> DataFrame:
    return K.time_bins(V.waves(spark, d), 4.0)


#: Centroids by bin; each takes the best like one of the bin before; ids are numbered by their first (bin, cluster).
MATCHED = """wvb AS (SELECT *, greatest(ceil((t - min(t) OVER ()) / 4.0::DOUBLE), 1)::BIGINT AS bin FROM wav),
cb AS (SELECT bin, cluster, k, avg(wave[k]) AS v, dense_rank() OVER (ORDER BY bin) AS n FROM wvb, (SELECT unnest(range(1, 65)) AS k) GROUP BY bin, cluster, k),
mt AS (SELECT x.n, x.cluster, y.cluster AS before, coalesce(corr(x.v, y.v), 0) AS r, sqrt(sum((x.v - y.v) * (x.v - y.v))) AS d FROM cb x JOIN cb y ON y.n = x.n - 1 AND y.k = x.k GROUP BY 1, 2, 3),
lk AS (SELECT n, cluster, arg_min(before, (-(r - 0.01::DOUBLE * d), before)) AS before FROM mt WHERE r >= 0.5 AND d <= 5.0 GROUP BY 1, 2),
nd AS (SELECT DISTINCT bin, cb.n, cluster, before FROM cb LEFT JOIN lk USING (n, cluster)),
gi AS (WITH RECURSIVE g(n, cluster, id) AS (SELECT n, cluster, row_number() OVER (ORDER BY n, cluster) FROM nd WHERE before IS NULL
  UNION ALL SELECT nd.n, nd.cluster, g.id FROM nd JOIN g ON nd.n = g.n + 1 AND nd.before = g.cluster) SELECT bin, g.cluster, id FROM g JOIN nd USING (n, cluster))"""


@query("G26_merge_bins", "spike, bin, cluster", "", "SELECT spike, bin, id::INTEGER AS cluster FROM wvb JOIN gi USING (bin, cluster)", MATCHED)
def _(spark, d):
    return K.merged_across_bins(_binned(spark, d), 0.5, 5.0)


PAIR_CTES = """ct AS (SELECT cluster, k, avg(v) AS v FROM smp GROUP BY 1, 2),
pr AS (SELECT x.cluster AS a, y.cluster AS b, corr(x.v, y.v) AS r, sqrt(sum((x.v - y.v) * (x.v - y.v))) AS d FROM ct x JOIN ct y ON x.k = y.k AND x.cluster < y.cluster GROUP BY 1, 2)"""


#: A cluster goes to another below it if their centroids are alike: the lowest such, or through the highest such on.
ALIKE = PAIR_CTES + ", lk AS (SELECT b, {0}(a) AS a FROM pr WHERE a > 0 AND r > 0.2 AND d < 1.0 GROUP BY b)"
ROOTS = "rt AS (WITH RECURSIVE w(c, x) AS (SELECT DISTINCT cluster, cluster FROM wav UNION ALL SELECT w.c, lk.a FROM w JOIN lk ON lk.b = w.x) SELECT c, min(x) AS x FROM w GROUP BY c)"
NUMBERED = "SELECT spike, (CASE WHEN x = 0 THEN 0 ELSE dense_rank() OVER (ORDER BY x) - max(CASE WHEN x = 0 THEN 1 ELSE 0 END) OVER () END)::INTEGER AS cluster FROM (SELECT spike, x FROM wav JOIN rt ON c = cluster)"


@query("G27_merge_within", "spike, cluster", "", NUMBERED, ALIKE.format("min") + ", rt AS (SELECT DISTINCT cluster AS c, coalesce(a, cluster) AS x FROM wav LEFT JOIN lk ON b = cluster)")
def _(spark, d):
    return K.merged(V.waves(spark, d), 0.2, 1.0, chain=False)


@query("G28_merge_similar", "spike, cluster", "", NUMBERED, ALIKE.format("max") + ", " + ROOTS)
def _(spark, d):
    return K.merged(V.waves(spark, d), 0.2, 1.0)


@query("G29_merge_search", "spike, cluster", "")
def _(spark, d):
    return K.merge_search(_binned(spark, d))[0]


@query("G30_centroids", "cluster, k", "v", "SELECT cluster, k, avg(v) AS v FROM smp GROUP BY 1, 2")
def _(spark, d):
    return K.centroids(V.waves(spark, d))


SNR = """SELECT a.cluster, span / (2 * noise) AS snr FROM (SELECT cluster, max(v) - min(v) AS span FROM (SELECT cluster, k, avg(v) AS v FROM smp GROUP BY 1, 2) GROUP BY 1) a
  JOIN (SELECT cluster, stddev_samp(v) AS noise FROM smp WHERE k <= 5 GROUP BY 1) USING (cluster)"""
ISI = "SELECT cluster, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (g < 0.05) / greatest(1, count(g)) AS violations FROM (SELECT cluster, t - lag(t) OVER (PARTITION BY cluster ORDER BY t) AS g FROM wav) GROUP BY 1"


@query("G31_snr", "cluster", "snr", SNR)
def _(spark, d):
    return K.signal_to_noise(V.waves(spark, d), 10_000.0)


@query("G32_violations", "cluster, n", "violations", ISI)
def _(spark, d):
    return K.violations(V.waves(spark, d), 0.05)


@query("G33_quality", "cluster, n, rejected, reason", "snr, violations", f"""SELECT *, reason <> '' AS rejected FROM (SELECT i.cluster, n, snr, violations,
  CASE WHEN i.cluster = 0 THEN '' ELSE concat_ws(', ', CASE WHEN snr < 0.5 THEN 'low SNR' END, CASE WHEN violations > 2 THEN 'ISI violations' END) END AS reason FROM ({ISI}) i JOIN ({SNR}) s USING (cluster))""")
def _(spark, d):
    return K.quality(V.waves(spark, d), 10_000.0, 0.05, 0.5)


RATE = """ed AS (SELECT cluster, min(t) AS t0, floor((max(t) - min(t)) / 0.5 + 1e-9::DOUBLE)::BIGINT AS bins FROM wav GROUP BY 1),
cn AS (SELECT w.cluster, CASE WHEN b = bins AND abs(t - t0 - bins * 0.5::DOUBLE) < 1e-9::DOUBLE THEN bins - 1 ELSE b END AS bin, bins FROM (SELECT w.*, ed.t0, ed.bins, floor((t - t0) / 0.5 + 1e-9::DOUBLE)::BIGINT AS b FROM wav w JOIN ed USING (cluster)) w),
gr AS (SELECT cluster, t0, unnest(range(0, bins)) AS bin FROM ed),
ft AS (SELECT gr.cluster, gr.bin, t0 + (gr.bin + 0.5::DOUBLE) * 0.5::DOUBLE AS centre, coalesce(n, 0) AS n FROM gr LEFT JOIN (SELECT cluster, bin, count(*) AS n FROM cn WHERE bin < bins GROUP BY 1, 2) c ON c.cluster = gr.cluster AND c.bin = gr.bin)"""


@query("G34_firing_rate", "cluster, bin", "centre, rate", "SELECT cluster, bin, centre, n / 0.5::DOUBLE AS rate FROM ft", RATE)
def _(spark, d):
    return K.firing_rate(V.waves(spark, d), 0.5)


@query("G34_firing_share", "cluster, bin", "centre, rate", "SELECT cluster, bin, centre, n / (sum(n) OVER (PARTITION BY cluster))::DOUBLE AS rate FROM ft", RATE)
def _(spark, d):
    return K.firing_rate(V.waves(spark, d), 0.5, as_share=True)


@query("G35_chosen", "spike, cluster", "", "SELECT spike, cluster FROM wav WHERE cluster > 0")
def _(spark, d):
    return K.chosen(V.waves(spark, d))


@query("G36_alignment_check", "k", "before, after", "SELECT k, avg(wave[k]) AS before, avg(wave[65 - k]) AS after FROM (SELECT wave FROM wav ORDER BY spike LIMIT 50), (SELECT unnest(range(1, 65)) AS k) GROUP BY k")
def _(spark, d):
    return G.alignment_check(V.waves(spark, d).withColumn("raw", F.col("wave")).withColumn("wave", F.reverse("wave")))


@query("G37_amplitude", "spike", "amplitude", "SELECT spike, list_max(wave) AS amplitude FROM wav")
def _(spark, d):
    return K.with_amplitude(V.waves(spark, d))


@query("G38_clean_labels", "spike, cluster", "", "SELECT spike, CASE WHEN spike % 7 = 0 THEN 0 WHEN spike % 11 = 0 THEN 0 ELSE round(cluster + 0.4)::INTEGER END AS cluster FROM wav")
def _(spark, d):
    label = F.when(F.col("spike") % 7 == 0, F.lit(float("nan"))).when(F.col("spike") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("cluster") + 0.4)
    return K.clean_labels(V.waves(spark, d).withColumn("label", label))


@query("G39_sample_index", "spike, i", "", "SELECT spike, round((t - 0.5) * 50)::BIGINT + 1 AS i FROM wav")
def _(spark, d):
    return K.sample_index(V.waves(spark, d), 0.5, 50.0)


@query("G40_same_count", "refused", "", "SELECT true AS refused")
def _(spark, d):
    waves = V.waves(spark, d)
    return spark.createDataFrame([(signals._refused(lambda: K.require_same_count(waves.where(F.col("spike") > 3), waves)),)], "refused boolean")


SIL = """SELECT avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS score FROM (
  SELECT spike, min(m) FILTER (c <> own) AS b, max(s) FILTER (c = own) / greatest(max(n) FILTER (c = own) - 1, 1) AS a, max(n) FILTER (c = own) AS n FROM
    (SELECT x.spike, x.cluster AS own, y.cluster AS c, avg(power(list_distance(x.wave, y.wave), 2)) AS m, sum(power(list_distance(x.wave, y.wave), 2)) AS s, count(*) AS n FROM wav x, wav y GROUP BY 1, 2, 3) GROUP BY spike)"""


@query("G41_silhouette", "", "score", SIL)
def _(spark, d):
    return spark.createDataFrame([(float(K.silhouette(V.waves(spark, d), "wave")),)], "score double")


@query("G42_pair_measures", "a, b", "r, d", "SELECT a, b, r, d FROM pr", PAIR_CTES)
def _(spark, d):
    return K.pair_measures(K.centroids(V.waves(spark, d)))


