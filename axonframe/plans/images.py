"""Queries of image stacks (H) and of streaming extensions (J)."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from ..model import scratch_path, write_bytes
from ..operators import imaging as H
from ..sources import images as I
from ..sources import mat as M
from ..sources import readers as R
from ..sources import views as V
from ..streaming import live as J
from .oracle import pass_sql
from .signals import query
from .spiking import HAZEN

ROI = "row BETWEEN 2 AND 6 AND col BETWEEN 3 AND 7"
LINE = (1.5, 2.25, 7.0, 6.0)


def region():
    return F.expr(ROI)


def trace(spark, d) -> DataFrame:
    """The rows' mean intensity as 8 traces over frames."""
    return V.pixels(spark, d).groupBy(F.col("row").alias("roi"), "frame").agg((F.avg("v") + 2).alias("v"))


TR = "tr AS (SELECT row AS roi, frame, avg(v) + 2 AS v FROM pix GROUP BY 1, 2)"
DIFF = f"SELECT frame, avg(dv) AS value FROM (SELECT frame, abs(v - lag(v) OVER (PARTITION BY row, col ORDER BY frame)) AS dv FROM pix WHERE {ROI}) GROUP BY 1"


STACK = "SELECT f AS frame, 1::BIGINT AS c, r AS row, c AS col, {t} ((f * 31 + r * 7 + c * 3) % 251)::DOUBLE AS v FROM (SELECT unnest(range(1, 6)) AS f), (SELECT unnest(range(1, 9)) AS r), (SELECT unnest(range(1, 11)) AS c)"


def _images() -> np.ndarray:
    """(row, column, frame)"""
    r, c, f = np.meshgrid(np.arange(1, 9), np.arange(1, 11), np.arange(1, 6), indexing="ij")
    return (f * 31 + r * 7 + c * 3) % 251


@query("A11_read_tiff", "frame, c, row, col", "v", STACK.format(t=""))
def _(spark, d):
    path = scratch_path(spark, "stack.tif")
    write_bytes(spark, path, tiff([_images()[:, :, k].astype(np.uint8) for k in range(5)]))
    return I.read_tiff(spark, path)


@query("A11_read_mat", "frame, c, row, col, inside", "t, v", f"SELECT *, row <= 4 AND col BETWEEN 2 AND 5 AS inside FROM ({STACK.format(t='f / 20.0::DOUBLE AS t,')})")
def _(spark, d):
    path, mask = scratch_path(spark, "stack.mat"), np.zeros((8, 10), bool)
    mask[:4, 1:5] = True
    write_bytes(spark, path, M.write_mat({"note": "a stack", "frames": _images(), "timeVec": np.arange(1, 6) / 20, "roiMask": mask}))
    inside = M.read_mask(spark, path).withColumn("inside", F.lit(True))
    return M.read_stack(spark, path).join(inside, ["stack", "row", "col"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def tiff(pages: list[np.ndarray]) -> bytes:
    """A plain multi-page file of 8-bit images."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    for k, page in enumerate(pages):
        tags = [(256, page.shape[1]), (257, page.shape[0]), (258, 8), (259, 1), (262, 1), (273, len(out) + 2 + 12 * 9 + 4), (277, 1), (278, page.shape[0]), (279, page.size)]
        body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags)
        after = len(out) + len(body) + 4 + page.size
        out += body + struct.pack("<I", after if k + 1 < len(pages) else 0) + page.tobytes()
    return bytes(out)


@query("H01_roi_intensity", "frame", "value", f"SELECT frame, avg(v) AS value FROM pix WHERE {ROI} GROUP BY 1")
def _(spark, d):
    return H.roi_intensity(V.pixels(spark, d), V.pixels(spark, d).where(region()).select("row", "col").distinct())


@query("H02_roi_movement", "frame", "value", DIFF)
def _(spark, d):
    return H.roi_movement(V.pixels(spark, d), region())


@query("H03_roi_variance", "frame", "value", f"SELECT frame, var_samp(v) AS value FROM pix WHERE {ROI} GROUP BY 1")
def _(spark, d):
    return H.roi_movement(V.pixels(spark, d), region(), "variance")


@query("H04_flow_speed", "frame", "value", DIFF)
def _(spark, d):
    return H.roi_frame_difference(V.pixels(spark, d), region())


EPS = "2.220446049250313e-16::DOUBLE"
CHANGE = f"SELECT roi, frame, (v - f) / (f + {EPS}) AS v FROM "


@query("H05_dff_first", "roi, frame", "v", CHANGE + "(SELECT *, avg(v) FILTER (k <= 10) OVER (PARTITION BY roi) AS f FROM (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY frame) AS k FROM tr))", TR)
def _(spark, d):
    return H.relative_change(trace(spark, d), "first", 10)


@query("H06_dff_percentile", "roi, frame", "v", CHANGE + f"(SELECT tr.*, f FROM tr JOIN ({HAZEN.format(keys='roi', value='v', q=10, src='tr', out='f')}) USING (roi))", TR)
def _(spark, d):
    return H.relative_change(trace(spark, d), "percentile", percentile=10.0)


@query("H07_dff_mean", "roi, frame", "v", CHANGE + "(SELECT *, avg(v) OVER (PARTITION BY roi) AS f FROM tr)", TR)
def _(spark, d):
    return H.relative_change(trace(spark, d), "mean")


@query("H08_dff_rolling", "roi, frame", "v", CHANGE + "(SELECT *, median(v) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS f FROM tr)", TR)
def _(spark, d):
    return H.relative_change(trace(spark, d), "rolling", window=8.0)


@query("H09_dff_unknown", "roi, frame", "v", CHANGE + "(SELECT *, avg(v) FILTER (k <= 30) OVER (PARTITION BY roi) AS f FROM (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY frame) AS k FROM tr))", TR)
def _(spark, d):
    return H.relative_change(trace(spark, d), "other", 5)


def kymo(spark, d) -> DataFrame:
    return H.kymograph(V.pixels(spark, d), LINE, 8, 8)


KYMO = """pt AS (SELECT p, 1.5 + 5.5 * (p - 1) / 6.0::DOUBLE AS x, 2.25 + 3.75 * (p - 1) / 6.0::DOUBLE AS y FROM (SELECT unnest(range(1, 8)) AS p)),
nb AS (SELECT p, least(floor(y), 7)::BIGINT + dy AS row, least(floor(x), 7)::BIGINT + dx AS col,
  (CASE WHEN dx = 1 THEN x - least(floor(x), 7) ELSE 1 - (x - least(floor(x), 7)) END) * (CASE WHEN dy = 1 THEN y - least(floor(y), 7) ELSE 1 - (y - least(floor(y), 7)) END) AS w FROM pt, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy)),
ky AS (SELECT frame, p, sum(v * w) AS v FROM pix JOIN nb USING (row, col) GROUP BY 1, 2)"""


@query("H10_kymograph", "frame, p, pos_px", "pos_frac, v", "SELECT frame, p, p - 1 AS pos_px, (p - 1) / 6.0::DOUBLE AS pos_frac, v FROM ky", KYMO)
def _(spark, d):
    return kymo(spark, d)


GRAD = """gd AS (SELECT CASE WHEN lag(v) OVER a IS NULL THEN lead(v) OVER a - v WHEN lead(v) OVER a IS NULL THEN v - lag(v) OVER a ELSE (lead(v) OVER a - lag(v) OVER a) / 2 END AS gt,
  CASE WHEN lag(v) OVER b IS NULL THEN lead(v) OVER b - v WHEN lead(v) OVER b IS NULL THEN v - lag(v) OVER b ELSE (lead(v) OVER b - lag(v) OVER b) / 2 END AS gs FROM ky WINDOW a AS (PARTITION BY p ORDER BY frame), b AS (PARTITION BY frame ORDER BY p)),
gm AS (SELECT avg(gt) AS gt, avg(gs) AS gs FROM gd)"""


@query("H11_propagation", "", "slope, angle", "SELECT -gt / gs AS slope, atan(-gt / gs) AS angle FROM gm", KYMO + ", " + GRAD)
def _(spark, d):
    return H.propagation(kymo(spark, d))


@query("H11_propagation_compat", "", "angle", "SELECT atan(-gs / gt) AS angle FROM gm", KYMO + ", " + GRAD)
def _(spark, d):
    return H.propagation(kymo(spark, d), compat=True)


@query("H12_propagation_correlation", "", "slope, score", """SELECT ((f - f0)::DOUBLE / nt * 7) AS slope, r AS score FROM (SELECT frame AS f, corr(v, m) AS r FROM ky JOIN (SELECT p, avg(v) AS m FROM ky GROUP BY 1) USING (p) GROUP BY 1
  ORDER BY round(corr(v, m), 12) DESC, frame LIMIT 1), (SELECT min(frame) AS f0, count(DISTINCT frame) AS nt FROM ky)""", KYMO)
def _(spark, d):
    return H.propagation(kymo(spark, d), "correlation")


@query("H13_propagation_diagonal", "", "slope, score", """SELECT dg::DOUBLE / nt AS slope, s AS score FROM (SELECT frame - f0 + 1 - p AS dg, var_samp(v) AS s, any_value(nt) AS nt FROM ky, (SELECT min(frame) AS f0, count(DISTINCT frame) AS nt FROM ky)
  GROUP BY 1 HAVING count(*) >= 5 ORDER BY round(var_samp(v), 12) DESC, dg LIMIT 1)""", KYMO)
def _(spark, d):
    return H.propagation(kymo(spark, d), "diagonal", least=5)


@query("H14_propagation_guard", "", "slope, angle", "SELECT NULL AS slope, NULL AS angle")
def _(spark, d):
    return H.propagation(kymo(spark, d).where(F.col("frame") == 3))


@query("H15_vessel_diameter", "frame", "diameter", """SELECT frame, CASE WHEN count(p) FILTER (z >= 0.5) >= 2 THEN (max(p) FILTER (z >= 0.5) - min(p) FILTER (z >= 0.5) + 1) * 7.0::DOUBLE / 7 END AS diameter FROM
  (SELECT frame, p, 1 - (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS z FROM ky WINDOW w AS (PARTITION BY frame)) GROUP BY 1""", KYMO)
def _(spark, d):
    return H.vessel_diameter(kymo(spark, d), 7.0)


@query("H16_gray256", "frame, row, col, v", "", "SELECT frame, row, col, round((v - min(v) OVER ()) * 255 / (max(v) OVER () - min(v) OVER ()))::SMALLINT AS v FROM pix")
def _(spark, d):
    return H.gray256(V.pixels(spark, d))


GW = "gw AS (SELECT k, exp(-(k * k) / 8.0::DOUBLE) / sum(exp(-(k * k) / 8.0::DOUBLE)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS k))"
GAUSS = """SELECT frame, row, r.col, sum(q.v * w) AS v FROM (SELECT frame, a.row, col, sum(p.v * w) AS v FROM (SELECT unnest(range(1, 9)) AS row) a CROSS JOIN gw JOIN {0} p ON p.row = greatest(1, least(8, a.row + gw.k)) GROUP BY 1, 2, 3) q
  JOIN (SELECT b.col, gw.w, greatest(1, least(8, b.col + gw.k)) AS src FROM (SELECT unnest(range(1, 9)) AS col) b CROSS JOIN gw) r ON q.col = r.src GROUP BY 1, 2, 3"""


@query("H17_gaussian", "frame, row, col", "v", GAUSS.format("pix"), GW)
def _(spark, d):
    return H.gaussian_smooth(V.pixels(spark, d), 2.0)


@query("H18_median", "frame, row, col", "v", """SELECT frame, row, col, median(coalesce(v, 0)) AS v FROM (SELECT f.frame, a.row, b.col, pix.v FROM (SELECT DISTINCT frame FROM pix) f, (SELECT unnest(range(1, 9)) AS row) a, (SELECT unnest(range(1, 9)) AS col) b,
  (VALUES (-1), (0), (1)) x(dr), (VALUES (-1), (0), (1)) y(dc) LEFT JOIN pix ON pix.frame = f.frame AND pix.row = a.row + dr AND pix.col = b.col + dc) GROUP BY 1, 2, 3""")
def _(spark, d):
    return H.median_smooth(V.pixels(spark, d))


@query("H19_minmax", "frame, row, col", "v", f"SELECT frame, row, col, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER () + {EPS}) AS v FROM pix")
def _(spark, d):
    return H.normalised(V.pixels(spark, d), "minmax")


#: Both bounds in one pass over counted values: the ranks of a value are (k - c, k].
BOUNDS = """cnt AS MATERIALIZED (SELECT v, count(*) AS c FROM pix GROUP BY v), run AS MATERIALIZED (SELECT v, c, (sum(c) OVER (ORDER BY v))::BIGINT AS k, (sum(c) OVER ())::BIGINT AS n FROM cnt),
rnk AS (SELECT *, least(greatest(n * 0.01::DOUBLE + 0.5, 1), n) AS p, least(greatest(n * 0.99::DOUBLE + 0.5, 1), n) AS q FROM run),
bnd AS MATERIALIZED (SELECT min(v) FILTER (k >= floor(p)) + (min(v) FILTER (k >= ceil(p)) - min(v) FILTER (k >= floor(p))) * (max(p) - floor(max(p))) AS a,
  min(v) FILTER (k >= floor(q)) + (min(v) FILTER (k >= ceil(q)) - min(v) FILTER (k >= floor(q))) * (max(q) - floor(max(q))) AS b FROM rnk)"""


@query("H20_percentile", "frame, row, col", "v", f"SELECT frame, row, col, least(greatest((v - a) / (b - a + {EPS}), 0), 1) AS v FROM pix CROSS JOIN bnd", BOUNDS)
def _(spark, d):
    return H.normalised(V.pixels(spark, d), "percentile")


@query("H21_frame_range", "frame, row, col", "v", "SELECT frame, row, col, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS v FROM pix WINDOW w AS (PARTITION BY frame)")
def _(spark, d):
    return H.normalised(V.pixels(spark, d), "frame")


@query("H22_prepared", "frame, row, col", "v", f"SELECT frame, row, col, CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0 END AS v FROM ({GAUSS.format('gry')}) WINDOW w AS (PARTITION BY frame)",
  GW + ", gry AS (SELECT frame, row, col, round((v - min(v) OVER ()) * 255 / (max(v) OVER () - min(v) OVER ()))::DOUBLE AS v FROM pix)")
def _(spark, d):
    return H.prepared(V.pixels(spark, d))


@query("H23_dispatch", "name, frame", "value", f"SELECT 'intensity' AS name, frame, avg(v) AS value FROM pix WHERE {ROI} GROUP BY 2 UNION ALL SELECT 'variance', frame, var_samp(v) FROM pix WHERE {ROI} GROUP BY 2")
def _(spark, d):
    run = lambda n: H.analyse(n, V.pixels(spark, d), region()).withColumn("name", F.lit(n))
    return run("intensity").unionByName(run("variance"))


@query("H24_time_or_frame", "kind, frame", "t", "SELECT 'match' AS kind, frame, frame / 10.0::DOUBLE AS t FROM (SELECT DISTINCT frame FROM pix) UNION ALL SELECT 'short', frame, frame::DOUBLE FROM (SELECT DISTINCT frame FROM pix)")
def _(spark, d):
    frames = V.pixels(spark, d).select("frame").distinct()
    times = frames.select("frame", (F.col("frame") / 10.0).alias("t"))
    return R.time_or_frame(frames, times).withColumn("kind", F.lit("match")).unionByName(R.time_or_frame(frames, times.where(F.col("frame") > 5)).withColumn("kind", F.lit("short")))


# --- J: streaming extensions, replayed over the stored events ------------------------------------------------------


def _stream(spark, d) -> DataFrame:
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").select(F.col("user_id").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("i"), F.col("value").cast("double").alias("y"))


def _replayed(df: DataFrame, mode: str) -> DataFrame:
    spark, root = df.sparkSession, scratch_path(df.sparkSession, "stream")
    out = f"{root}/out"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).outputMode("append").start()
    else:
        q = df.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).outputMode(mode).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("J01_windowed_rate", "channel, start, n", "", "SELECT user_id AS channel, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    spikes = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("channel"), "ts")
    return J.windowed_rate(spikes, "1 hour").withColumn("start", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', start)"))


@query("J01_windowed_rate_stream", "channel, start, n", "", "SELECT user_id AS channel, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    """The stream's times are instants of the session's time zone; as those of the table they have none."""
    rates = _replayed(J.windowed_rate(_stream(spark, d), "1 hour"), "complete")
    return rates.withColumn("start", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(start AS TIMESTAMP_NTZ))"))


@query("J02_debounced_onsets", "channel, i", "", """WITH RECURSIVE e AS (SELECT user_id AS channel, event_id AS i FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE value > 60 AND (p IS NULL OR p <= 60)),
  k(channel, i) AS (SELECT channel, min(i) FROM e GROUP BY channel UNION ALL SELECT k.channel, (SELECT min(e.i) FROM e WHERE e.channel = k.channel AND e.i >= k.i + 500) FROM k WHERE EXISTS (SELECT 1 FROM e WHERE e.channel = k.channel AND e.i >= k.i + 500)) SELECT * FROM k""")
def _(spark, d):
    return _replayed(J.debounced_onsets(_stream(spark, d), 60.0, 500), "append")


SLOW = dsp.design("low", 2, 1.0, 10.0)


@query("J03_causal_filter", "channel, i", "y", "SELECT user_id AS channel, event_id AS i, x AS y FROM evs JOIN cf ON cf.channel = evs.user_id AND cf.k = evs.k",
  "evs AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value::DOUBLE AS v FROM events), evx AS (SELECT user_id AS channel, k, v AS x FROM evs), " + pass_sql("cf", "evx", SLOW, False))
def _(spark, d):
    return _replayed(J.causal_filter(_stream(spark, d), SLOW), "append")


@query("J04_sql_views", "channel, n", "top", "SELECT channel, count(*) AS n, max(y) AS top FROM sig GROUP BY 1")
def _(spark, d):
    J.register_views(axon_signal=V.signal(spark, d))
    return spark.sql("SELECT channel, count(*) AS n, max(y) AS top FROM axon_signal GROUP BY channel")


@query("J05_bursts", "channel, n, seconds", "", """SELECT channel, count(*) AS n, (epoch(max(ts)) * 1000000 - epoch(min(ts)) * 1000000)::BIGINT // 1000000 AS seconds FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY ts) AS b FROM
  (SELECT user_id AS channel, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY channel, b""")
def _(spark, d):
    spikes = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("channel"), F.col("ts").cast("timestamp").alias("ts"))
    return J.bursts(spikes, "2 hours").withColumn("seconds", F.expr("timestampdiff(SECOND, start, end) - 7200"))


