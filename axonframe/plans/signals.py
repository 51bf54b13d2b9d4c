"""Queries of sources, ranges, conditioning, trials and features (A to F)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from ..model import scratch_path
from ..operators import conditioning as C
from ..operators import features as X
from ..operators import ranges as B
from ..operators import trials as D
from ..sources import folders as P
from ..sources import mat as M
from ..sources import readers as R
from ..sources import sinks as S
from ..sources import views as V
from .oracle import oracle, rounded, zero_phase_sql

QUERIES, ORACLES = {}, {}
FS = V.FS


def query(name: str, keys: str, values: str, sql: str | None = None, extra: str = ""):
    """Registers a function of (spark, sf_dir); its result has the keys and the values, rounded."""
    def add(f):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d), keys, values)
        if sql is not None:
            ORACLES[name] = oracle(keys, values, sql, extra)
        return f

    return add


# --- shared shapes -------------------------------------------------------------------------------------------------


def onsets(spark, d) -> DataFrame:
    return D.successive_gap(D.rising_edges(V.stimulus(spark, d), 0.5), 0.3)


def trials(spark, d) -> DataFrame:
    return D.windows_at(V.signal(spark, d), onsets(spark, d), 2, 4, FS)


def numbered(spark, d) -> DataFrame:
    """Trials under one number each, with the file they are said to come from; file 2 has another time axis."""
    rows = trials(spark, d).withColumn("trial", F.col("channel") * 100000 + F.col("onset")).withColumn("file", F.col("channel") % 3)
    return rows.withColumn("t_rel", F.when(F.col("file") == 2, F.col("t_rel") + 1.0).otherwise(F.col("t_rel")))


# --- flagship ------------------------------------------------------------------------------------------------------

AVERAGE = "SELECT i, t_rel, avg(y) AS mean, CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(y) END AS sd, count(*) AS n FROM ({}) GROUP BY i, t_rel"
BASED = "SELECT *, y - avg(CASE WHEN t_rel < 0 THEN y END) OVER (PARTITION BY channel, onset) AS yb FROM trl"


@query("flagship", "i, n", "t_rel, mean, sd", AVERAGE.format(f"SELECT i, t_rel, yb AS y FROM ({BASED})"))
def flagship(spark, d):
    return D.mean_and_sd(D.baseline_corrected(trials(spark, d), ("channel", "onset")))


# --- A: sources and sinks ------------------------------------------------------------------------------------------


def _pair_sql(stim: int, flow: int) -> str:
    return f"""SELECT a.i, ((a.i - 1) / coalesce(f.fs, 1000.0::DOUBLE))::DOUBLE AS t, a.y AS stim, b.y AS flow FROM
      (SELECT i, max(y) FILTER (no = {stim}) AS y FROM sig JOIN idx USING (channel) WHERE no IN ({stim}, {flow}) GROUP BY i) a
      JOIN (SELECT i, max(y) FILTER (no = {flow}) AS y FROM sig JOIN idx USING (channel) WHERE no IN ({stim}, {flow}) GROUP BY i) b USING (i)
      CROSS JOIN (SELECT max(fs) FILTER (no = {flow}) AS fs FROM idx) f"""


@query("A01_load_export", "i", "t, stim, flow", _pair_sql(6, 8))
def _(spark, d):
    return R.load_export(*V.export_block(spark, d))


@query("A02_validate_export", "name, ok", "", "SELECT * FROM (VALUES ('export', true), ('no index', false), ('no end', false), ('text samples', false)) v(name, ok)")
def _(spark, d):
    block, index = V.export_block(spark, d)
    cases = [("export", R.validate_export(block, index)), ("no index", R.validate_export(block, None)), ("no end", R.validate_export(block, index.drop("end"))), ("text samples", R.validate_export(block.withColumn("v", F.col("v").cast("string")), index))]
    return spark.createDataFrame(cases, "name string, ok boolean")


@query("A03_channel_slice", "channel, i", "y", "SELECT no AS channel, i, y FROM sig JOIN idx USING (channel)")
def _(spark, d):
    return R.channel_slice(*V.export_block(spark, d))


RATE = "SELECT '{0}' AS pair, coalesce(max(fs) FILTER (no = {1}), 1000) AS stim_fs, coalesce(max(fs) FILTER (no = {2}), 1000) AS flow_fs, coalesce(max(fs) FILTER (no = {2}), 1000) AS fs, coalesce(max(fs) FILTER (no = {1}), 1000) <> coalesce(max(fs) FILTER (no = {2}), 1000) AS differ FROM idx"
PAIRS = ((6, 8), (1, 2), (2, 3), (4, 900))


@query("A04_sampling_rate", "pair, differ", "stim_fs, flow_fs, fs", " UNION ALL ".join(RATE.format(f"{a}-{b}", a, b) for a, b in PAIRS))
def _(spark, d):
    _, index = V.export_block(spark, d)
    out = [R.sampling_rate(index, a, b).withColumn("pair", F.lit(f"{a}-{b}")) for a, b in PAIRS]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("A05_metadata", "channel, title", "", "SELECT no AS channel, title FROM idx")
def _(spark, d):
    return R.metadata(V.export_block(spark, d)[1])


def _cropped(spark, d) -> DataFrame:
    sig = V.signal(spark, d).where(F.col("channel") == 7)
    return B.crop_pair(sig.select("channel", "i", "t", F.col("s").alias("y")), sig, 5, 30, FS)


CROPPED = "SELECT i - 4 AS i, ((i - 5) / 10.0::DOUBLE)::DOUBLE AS t, s AS stim, y AS flow FROM sig WHERE channel = 7 AND i BETWEEN 5 AND 30"


@query("A06_cropped_reader", "i", "t, stim, flow", CROPPED)
def _(spark, d):
    path = scratch_path(spark, "cropped")
    S.write_cropped(_cropped(spark, d), path)
    return spark.read.parquet(path)


UNION = """SELECT n.unit AS trial, x.i, x.t_rel, x.y FROM (SELECT *, channel * 100000 + onset AS trial, channel % 3 AS file FROM trl) x
  JOIN (SELECT trial, row_number() OVER (ORDER BY file, trial) AS unit FROM (SELECT DISTINCT channel * 100000 + onset AS trial, channel % 3 AS file FROM trl WHERE channel % 3 <> 2)) n USING (trial)"""


@query("A07_union_trials", "trial, i", "t_rel, y", UNION)
def _(spark, d):
    return R.union_trials(numbered(spark, d))


def _stored(spark, d, stim: bool) -> str:
    """Every channel of the table as a stored recording."""
    path, signal = scratch_path(spark, "recording"), V.signal(spark, d)
    S.write_recording(signal.drop("s"), V.stimulus(spark, d) if stim else None, path, None)
    return path


@query("A09_lfp_reader", "source, channel, i", "t, y", """SELECT 'data' AS source, channel, i, t, y FROM sig WHERE channel IN (SELECT DISTINCT channel FROM sig ORDER BY 1 LIMIT 4)
  UNION ALL SELECT 'stim', channel, i, t, s FROM sig""")
def _(spark, d):
    data, stim = R.read_recording(spark, _stored(spark, d, True), 4)
    return data.withColumn("source", F.lit("data")).unionByName(stim.withColumn("source", F.lit("stim")))


@query("A10_mua_reader", "source, channel, i", "t, y", "SELECT 'data' AS source, channel, i, t, y FROM sig")
def _(spark, d):
    data, stim = R.read_recording(spark, _stored(spark, d, False))
    return data.withColumn("source", F.lit("data")).unionByName(stim.withColumn("source", F.lit("stim")))


@query("A12_inferred_rate", "channel", "fs", "SELECT channel, CASE WHEN b > a THEN 1 / (b - a) ELSE 1000 END AS fs FROM (SELECT channel, max(t) FILTER (i = 1) AS a, max(t) FILTER (i = 2) AS b FROM irr GROUP BY 1)")
def _(spark, d):
    return R.inferred_rate(V.irregular(spark, d))


@query("A13_typed_view", "kind, unit, i", "t, y", "SELECT 'mean' AS kind, 1::BIGINT AS unit, i, any_value(t) AS t, avg(y) AS y FROM sig GROUP BY i UNION ALL SELECT 'trials', channel * 100000 + onset, i, t_rel, y FROM trl")
def _(spark, d):
    mean = R.typed_view(V.signal(spark, d), "mean").withColumn("kind", F.lit("mean"))
    each = R.typed_view(trials(spark, d).withColumn("trial", F.col("channel") * 100000 + F.col("onset")), "trials").withColumn("kind", F.lit("trials"))
    return mean.unionByName(each)


@query("A14_write_cropped", "rows", "total", f"SELECT count(*) AS rows, sum(flow) AS total FROM ({CROPPED})")
def _(spark, d):
    path = scratch_path(spark, "cropped")
    S.write_cropped(_cropped(spark, d), path)
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), F.sum("flow").alias("total"))


@query("A15_append_trials", "rows, trials", "total", "SELECT 2 * count(*) AS rows, 2 * count(DISTINCT (channel, onset)) AS trials, 2 * sum(y) AS total FROM trl")
def _(spark, d):
    path = scratch_path(spark, "trials")
    rows = trials(spark, d).withColumn("trial", F.col("channel") * 100000 + F.col("onset"))
    S.append_trials(rows, path)
    S.append_trials(rows, path)
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), F.countDistinct("trial").alias("trials"), F.sum("y").alias("total"))


@query("A16_write_lfp", "channel, i", "t, y", "SELECT channel, i, t, y FROM sig WHERE channel IN (3, 5, 9)")
def _(spark, d):
    path = scratch_path(spark, "lfp")
    S.write_recording(V.signal(spark, d).drop("s"), V.stimulus(spark, d), path, [3, 5, 9])
    return R.read_recording(spark, path)[0]


@query("A17_write_mua", "name, value, channel, n", "total", """SELECT name, value, NULL::BIGINT AS channel, NULL::BIGINT AS n, NULL AS total FROM (VALUES ('high', '3000'), ('low', '300'), ('order', '4')) v(name, value)
  UNION ALL SELECT NULL, NULL, channel, count(*), sum(y) FROM sig GROUP BY channel""")
def _(spark, d):
    path = scratch_path(spark, "mua")
    S.write_recording(V.signal(spark, d).drop("s"), None, path, None, {"low": "300", "high": "3000", "order": "4"})
    sums = R.read_recording(spark, path)[0].groupBy("channel").agg(F.count("*").alias("n"), F.sum("y").alias("total"))
    return spark.read.parquet(f"{path}/parameters").unionByName(sums, allowMissingColumns=True)


@query("A18_write_features", "channel", "latency", "SELECT channel, arg_min(t, (-y, t)) - 1 AS latency FROM sig WHERE t >= 1 GROUP BY channel")
def _(spark, d):
    path = scratch_path(spark, "features.csv")
    S.write_features(X.peak_latency(V.signal(spark, d), 1.0).select("channel", "latency"), path)
    return spark.read.option("header", True).schema("channel long, latency double").csv(path)


@query("A18_write_features_mat", "channel", "latency", "SELECT channel, arg_min(t, (-y, t)) - 1 AS latency FROM sig WHERE t >= 1 GROUP BY channel")
def _(spark, d):
    path = scratch_path(spark, "features.mat")
    S.write_features(X.peak_latency(V.signal(spark, d), 1.0).select("channel", "latency"), path)
    cells = M.read_variables(spark, path).where(F.col("variable").startswith("data.")).withColumn("at", F.split("variable", r"\."))
    rows = cells.groupBy(F.col("at")[1].alias("k")).agg(F.max(F.when(F.col("at")[2] == "1", F.col("v"))).cast("long").alias("channel"), F.max(F.when(F.col("at")[2] == "2", F.col("v"))).alias("latency"))
    return rows.drop("k")


@query("A19_folders", "step, kept, source, target", "", "SELECT * FROM (VALUES (1, false, false, false), (2, false, false, false), (3, true, true, false), (4, true, true, true)) v(step, kept, source, target)")
def _(spark, d):
    session = spark.newSession()  # settings of its own
    steps = [("", ("import",)), (f"{d}/nothing", ("import", "export")), (d, ("import",)), (d, ("import", "export"))]
    rows = [(k, P.set_folder(session, path, *kinds), P.folder(session, "import") == d, P.folder(session, "export") == d) for k, (path, kinds) in enumerate(steps, 1)]
    return spark.createDataFrame(rows, "step int, kept boolean, source boolean, target boolean")


# --- B: ranges -----------------------------------------------------------------------------------------------------


@query("B01_crop", "channel, i", "t, y", "SELECT channel, i - 9 AS i, ((i - 10) / 10.0::DOUBLE)::DOUBLE AS t, y FROM sig WHERE i BETWEEN 10 AND 40")
def _(spark, d):
    return B.crop(V.signal(spark, d), 10, 40, FS)


@query("B01_crop_reversed", "channel, i", "t, y", "SELECT channel, i, t, y FROM sig")
def _(spark, d):
    return B.crop(V.signal(spark, d), 40, 10, FS)


MISMATCH = """SELECT s.channel, s.i - lo + 1 AS i, ((s.i - lo) / 10.0::DOUBLE)::DOUBLE AS t, s.s AS stim, s.y AS flow FROM sig s JOIN
  (SELECT channel, least(10, least(n, 60)) AS lo, least(least(n, 60), greatest(70, least(10, least(n, 60)))) AS hi FROM idx) USING (channel) WHERE s.i BETWEEN lo AND hi"""


@query("B02_crop_mismatch", "channel, i", "t, stim, flow", MISMATCH)
def _(spark, d):
    sig = V.signal(spark, d)
    return B.crop_pair(V.stimulus(spark, d), sig.where(F.col("i") <= 60), 10, 70, FS)


@query("B03_check_range", "a, b, ok", "", "SELECT * FROM (VALUES (1.0::DOUBLE, 5.0::DOUBLE, true), (5.0, 2.0, false), (-1.0, 5.0, false), (1.0, 15.0, false), (0.0, 10.0, true)) v(a, b, ok)")
def _(spark, d):
    return spark.createDataFrame([(a, b, B.check_range(a, b, 10.0)[0]) for a, b in ((1.0, 5.0), (5.0, 2.0), (-1.0, 5.0), (1.0, 15.0), (0.0, 10.0))], "a double, b double, ok boolean")


@query("B04_seconds_to_samples", "low, high", "", "SELECT round(0.05 * 10)::BIGINT AS low, round(4.25 * 10)::BIGINT AS high")
def _(spark, d):
    return spark.createDataFrame([B.seconds_to_samples(0.05, 4.25, FS)], "low long, high long")


@query("B05_sorted_pair", "", "low, high", "SELECT 1.5 AS low, 3.25 AS high")
def _(spark, d):
    return spark.createDataFrame([B.sorted_pair(3.25, 1.5)], "low double, high double")


@query("B06_channel_selection", "channel, i", "y", "SELECT channel, i, y FROM sig WHERE channel IN (2, 3, 5, 7)")
def _(spark, d):
    return B.channels(V.signal(spark, d), (2, 3, 5, 7))


@query("B07_time_slice", "channel, i", "t, y", "SELECT channel, i, t, y FROM sig WHERE t BETWEEN 1.0 AND 2.5")
def _(spark, d):
    return B.time_slice(V.signal(spark, d), 1.0, 2.5)


@query("B08_rebased", "channel, i", "t", "SELECT channel, i, t - min(t) OVER (PARTITION BY channel) AS t FROM sig WHERE t BETWEEN 1.0 AND 2.5")
def _(spark, d):
    return B.rebased(B.time_slice(V.signal(spark, d), 1.0, 2.5))


@query("B09_after", "channel, i", "t, y", "SELECT channel, i, t, y FROM sig WHERE t >= 3")
def _(spark, d):
    return B.after(V.signal(spark, d), 3.0)


@query("B10_rectangle", "frame, row, col", "v", "SELECT frame, row, col, v FROM pix WHERE col BETWEEN 3 AND 6 AND row BETWEEN 1 AND 8")
def _(spark, d):
    return V.pixels(spark, d).where(B.rectangle(2.5, -3.0, 3.4, 40.0, 8, 8))


@query("B11_gray", "frame, row, col", "v", "SELECT frame, row, col, v * 2 AS v FROM pix")
def _(spark, d):
    pix = V.pixels(spark, d)
    return B.gray(pix.withColumn("c", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("v", F.col("v") * F.col("c")))


@query("B12_above", "channel, i, above", "", "SELECT channel, i, y > 50 AS above FROM sig")
def _(spark, d):
    return B.above(V.signal(spark, d), 50.0)


@query("B13_axes", "kind, i", "t", """SELECT 'sample' AS kind, i, (i - 1) / 10.0::DOUBLE AS t FROM (SELECT unnest(range(1, 51)) AS i) UNION ALL
  SELECT 'trial', i, (i - 1 - 20) / 10.0::DOUBLE FROM (SELECT unnest(range(1, 62)) AS i) UNION ALL SELECT 'linear', i, -2 + (i - 1) * (6.0::DOUBLE / 30) FROM (SELECT unnest(range(1, 32)) AS i)""")
def _(spark, d):
    a, b, c = B.sample_axis(spark, 50, FS), B.trial_axis(spark, 20, 40, FS), B.linear_axis(spark, -2.0, 4.0, 31)
    return a.withColumn("kind", F.lit("sample")).unionByName(b.withColumn("kind", F.lit("trial"))).unionByName(c.withColumn("kind", F.lit("linear")))


# --- C: conditioning -----------------------------------------------------------------------------------------------


@query("C01_decimate", "channel, i", "t, y", "SELECT channel, (i - 1) // 5 + 1 AS i, t, y FROM sig WHERE (i - 1) % 5 = 0")
def _(spark, d):
    return C.decimated(V.signal(spark, d), 5)


def _zero_phase_sql(name: str, source: str, sos) -> str:
    return zero_phase_sql(name, source, sos, dsp.reflection(sos))


#: Designs of the queries below, at the test signals' rate.
SMOOTH, LOW, LINE, BAND = dsp.design("low", 4, 0.8 * 4.0 / 2, FS), dsp.design("low", 4, 1.0, FS), dsp.notch(2.0, FS), dsp.design("band", 2, (0.5, 3.0), FS, dsp.RIPPLE)
LFP = dsp.design("low", 4, 2.0, FS)


@query("C02_decimate_smoothly", "channel, i", "t, y", f"SELECT channel, (i - 1) // 3 + 1 AS i, ((i - 1) // 3 / ({FS}::DOUBLE / 3))::DOUBLE AS t, y FROM zp WHERE (i - 1) % 3 = 0", _zero_phase_sql("zp", "sig", SMOOTH))
def _(spark, d):
    return C.decimated_smoothly(V.signal(spark, d), FS, 4.0)[0]


#: Squared gains from the definitions, with f the frequency in Hz: 1 / (1 + x^2n), or with a Chebyshev polynomial.
WARP = "tan(pi() * {0} / 10.0::DOUBLE)"
SHAPES = {
    "low": "{w} / {a}",
    "high": "{a} / {w}",
    "band": "({w} * {w} - {a} * {b}) / ({w} * ({b} - {a}))",
    "stop": "({w} * ({b} - {a})) / ({w} * {w} - {a} * {b})",
}
SPECS = (("low", (1.0,)), ("high", (1.0,)), ("band", (0.5, 2.0)), ("stop", (0.5, 2.0)))


def _gain_sql(form: str) -> str:
    def one(kind: str, edges: tuple) -> str:
        x = SHAPES[kind].format(w=WARP.format("hz"), a=WARP.format(f"{edges[0]}::DOUBLE"), b=WARP.format(f"{edges[-1]}::DOUBLE"))
        return f"SELECT '{kind}' AS kind, hz, {form.format(x=f'abs({x})')} AS gain FROM (SELECT k * 0.07::DOUBLE + 0.013::DOUBLE AS hz FROM (SELECT unnest(range(1, 70)) AS k))"

    return " UNION ALL ".join(one(k, e) for k, e in SPECS)


def _gains(spark, ripple: float | None) -> DataFrame:
    hz = [k * 0.07 + 0.013 for k in range(1, 70)]
    rows = []
    for kind, edges in SPECS:
        sos = dsp.design(kind, 4, edges if len(edges) > 1 else edges[0], FS, ripple)
        rows += [(kind, h, float(g)) for h, g in zip(hz, np.abs(dsp.response(sos, 2 * np.pi * np.array(hz) / FS)), strict=True)]
    return spark.createDataFrame(rows, "kind string, hz double, gain double")


@query("C03_butterworth", "kind", "hz, gain", _gain_sql("1 / sqrt(1 + power({x}, 8))"))
def _(spark, d):
    return _gains(spark, None)


@query("C04_chebyshev", "kind", "hz, gain", _gain_sql("1 / sqrt(1 + (power(10::DOUBLE, 0.05::DOUBLE) - 1) * power(8 * power({x}, 4) - 8 * power({x}, 2) + 1, 2))"))
def _(spark, d):
    return _gains(spark, dsp.RIPPLE)


_TAPS = "taps AS (SELECT k, h / sum(h) OVER () AS h FROM (SELECT k, (CASE WHEN k = 5 THEN 0.4 ELSE sin(pi() * 0.4 * (k - 5)) / (pi() * (k - 5)) END) * (0.54 - 0.46 * cos(2 * pi() * k / 10)) AS h FROM (SELECT unnest(range(0, 11)) AS k)))"


@query("C05_fir", "channel, i", "y", "SELECT s.channel, s.i, sum(h * p.y) AS y FROM sig s CROSS JOIN taps JOIN sig p ON p.channel = s.channel AND p.i = s.i - k GROUP BY 1, 2", _TAPS)
def _(spark, d):
    return C.convolved(V.signal(spark, d), dsp.fir("low", 10, 2.0, FS))


@query("C06_zero_phase", "channel, i", "t, y", "SELECT channel, i, ((i - 1) / 10.0::DOUBLE)::DOUBLE AS t, y FROM zp", _zero_phase_sql("zp", "sig", LOW))
def _(spark, d):
    return C.filtered(V.signal(spark, d), LOW)


def _response_sql(sos: np.ndarray) -> str:
    gain = " * ".join(f"sqrt(power({float(s[0])!r} + {float(s[1])!r} * cos(w) + {float(s[2])!r} * cos(2 * w), 2) + power({float(s[1])!r} * sin(w) + {float(s[2])!r} * sin(2 * w), 2)) / sqrt(power(1 + {float(s[4])!r} * cos(w) + {float(s[5])!r} * cos(2 * w), 2) + power({float(s[4])!r} * sin(w) + {float(s[5])!r} * sin(2 * w), 2))" for s in sos)
    return f"SELECT k, k * (5.0::DOUBLE / 1024) AS hz, {gain} AS gain FROM (SELECT k, k * (pi() / 1024) AS w FROM (SELECT unnest(range(0, 1024)) AS k))"


@query("C07_response", "k", "hz, gain", _response_sql(LINE))
def _(spark, d):
    return C.frequency_response(spark, LINE, FS)


@query("C08_lfp_low_pass", "channel, i", "t, y", "SELECT channel, i, ((i - 1) / 10.0::DOUBLE)::DOUBLE AS t, y FROM zp", _zero_phase_sql("zp", "sig", LFP))
def _(spark, d):
    return C.lfp(V.signal(spark, d), FS, FS, 2.0, None)[0]


@query("C09_notch", "channel, i", "t, y", "SELECT channel, i, ((i - 1) / 10.0::DOUBLE)::DOUBLE AS t, y FROM zp", _zero_phase_sql("zp", "sig", LINE))
def _(spark, d):
    return C.filtered(V.signal(spark, d), LINE)


@query("C10_multi_unit", "channel, i", "t, y", "SELECT channel, i, ((i - 1) / 10.0::DOUBLE)::DOUBLE AS t, sum(y) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS y FROM zp", _zero_phase_sql("zp", "sig", BAND))
def _(spark, d):
    return C.multi_unit(V.signal(spark, d), FS, C.Filter("band", "chebyshev", 2, (0.5, 3.0)), 300.0)


@query("C11_boxcar", "channel, i", "y", "SELECT channel, i, sum(y) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) / 4 AS y FROM sig")
def _(spark, d):
    return C.boxcar(V.signal(spark, d), 4)


def _refused(f) -> bool:
    try:
        f()
    except ValueError:
        return True
    return False


@query("C12_filter_check", "name, refused", "", "SELECT * FROM (VALUES ('above nyquist', true), ('reversed band', true), ('no order', true), ('negative', true), ('good', false)) v(name, refused)")
def _(spark, d):
    cases = [("above nyquist", "low", 4, 6.0), ("reversed band", "band", 4, (2.0, 1.0)), ("no order", "low", 0, 1.0), ("negative", "high", 4, -1.0), ("good", "band", 4, (1.0, 2.0))]
    return spark.createDataFrame([(n, _refused(lambda k=k, o=o, c=c: dsp.check(k, o, c, FS))) for n, k, o, c in cases], "name string, refused boolean")


@query("C13_default_cutoff", "kind", "low, high", "SELECT * FROM (VALUES ('low', 2.5, NULL), ('high', 0.05, NULL), ('band', 0.05, 2.5), ('stop', 0.05, 2.5)) v(kind, low, high)")
def _(spark, d):
    rows = [(k, *(c if isinstance(c, tuple) else (c, None))) for k in ("low", "high", "band", "stop") for c in [dsp.default_cutoff(k, FS)]]
    return spark.createDataFrame(rows, "kind string, low double, high double")


@query("C14_presets", "name, filter_order", "low, high", "SELECT * FROM (VALUES ('standard', 4, 300, 3000), ('broadband', 4, 500, 5000)) v(name, filter_order, low, high)")
def _(spark, d):
    return spark.createDataFrame([(n, p.order, *p.cutoff) for n, p in C.PRESETS.items()], "name string, filter_order int, low double, high double")


@query("C15_filter_none", "channel, i", "t, y", "SELECT channel, (i - 1) // 2 + 1 AS i, t, y FROM sig WHERE (i - 1) % 2 = 0")
def _(spark, d):
    return C.flow(V.signal(spark, d), FS, 2, C.Filter("none"))


# --- D, E: events, trials, averages --------------------------------------------------------------------------------


@query("D01_rising_edges", "channel, i", "t", "SELECT channel, i, t FROM edge")
def _(spark, d):
    return D.rising_edges(V.stimulus(spark, d), 0.5)


GREEDY = """g AS (WITH RECURSIVE k(channel, i) AS (SELECT channel, min(i) FROM edge GROUP BY channel UNION ALL
  SELECT k.channel, (SELECT min(e.i) FROM edge e WHERE e.channel = k.channel AND e.i >= k.i + 5) FROM k
  WHERE EXISTS (SELECT 1 FROM edge e WHERE e.channel = k.channel AND e.i >= k.i + 5)) SELECT * FROM k)"""


@query("D02_greedy_gap", "channel, i", "", "SELECT channel, i FROM g", GREEDY)
def _(spark, d):
    return D.greedy_gap(D.rising_edges(V.stimulus(spark, d), 0.5), 5)


@query("D03_successive_gap", "channel, i", "t", "SELECT channel, i, t FROM ons")
def _(spark, d):
    return onsets(spark, d)


CENTRED = """c AS (SELECT channel, i, s - avg(s) OVER (PARTITION BY channel) AS z FROM sig),
e2 AS (SELECT channel, i, ((i - {0}) / 10.0::DOUBLE)::DOUBLE AS t FROM (SELECT *, lag(z) OVER (PARTITION BY channel ORDER BY i) AS p FROM c) WHERE z > 0.4 AND (p IS NULL OR p <= 0.4))"""
SPACED = "SELECT channel, i, t FROM (SELECT *, t - lag(t) OVER (PARTITION BY channel ORDER BY i) AS g FROM e2) WHERE g IS NULL OR g > 0.45"


@query("D04_centred_onsets", "channel, i", "t", SPACED, CENTRED.format(1))
def _(spark, d):
    return D.centred_onsets(V.stimulus(spark, d), 0.4, 0.45, FS)


@query("D04_centred_onsets_compat", "channel, i", "t", SPACED, CENTRED.format(0))
def _(spark, d):
    return D.centred_onsets(V.stimulus(spark, d), 0.4, 0.45, FS, compat=True)


@query("D05_trials", "channel, onset, i", "t_rel, y", "SELECT * FROM trl")
def _(spark, d):
    return trials(spark, d)


@query("D06_segments", "channel, i", "t_start, t_end", "SELECT channel, i, t - 0.5 AS t_start, t + 1.25 AS t_end FROM ons")
def _(spark, d):
    return D.segment_bounds(onsets(spark, d), 0.5, 1.25)


EPOCHS = """ep AS (SELECT channel, o AS onset, i, t_rel, y FROM (SELECT s.channel, o.i AS o, s.i - o.i + 4 AS i, ((s.i - o.i) / 10.0::DOUBLE)::DOUBLE AS t_rel, s.y,
  count(*) OVER (PARTITION BY o.channel, o.i) AS n FROM sig s JOIN (SELECT channel, round(t * 10.0)::BIGINT + 1 AS i FROM ons) o ON s.channel = o.channel AND s.i BETWEEN o.i - 3 AND o.i + 5) WHERE n = 9)"""


@query("D07_epochs", "channel, onset, i", "t_rel, y", "SELECT * FROM ep", EPOCHS)
def _(spark, d):
    return D.epochs(V.signal(spark, d), onsets(spark, d), FS, 0.3, 0.5)


@query("E01_mean_and_sd", "i, n", "t_rel, mean, sd", AVERAGE.format("SELECT i, t_rel, y FROM trl"))
def _(spark, d):
    return D.mean_and_sd(trials(spark, d))


@query("E02_grand_average", "i, n", "t_rel, mean, sd", AVERAGE.format("SELECT i, t_rel, y FROM trl WHERE channel % 3 <> 2"))
def _(spark, d):
    return D.mean_and_sd(R.union_trials(numbered(spark, d)))


@query("E03_baseline", "channel, onset, i", "t_rel, y", f"SELECT channel, onset, i, t_rel, yb AS y FROM ({BASED})")
def _(spark, d):
    return D.baseline_corrected(D.require_prestimulus(trials(spark, d)), ("channel", "onset"))


@query("E04_erp", "channel, i, n", "t_rel, mean, sd", "SELECT channel, i, t_rel, avg(y) AS mean, CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(y) END AS sd, count(*) AS n FROM ep GROUP BY 1, 2, 3", EPOCHS)
def _(spark, d):
    return D.mean_and_sd(D.epochs(V.signal(spark, d), onsets(spark, d), FS, 0.3, 0.5), ("channel",))


@query("E05_channel_mean", "i", "t, y", "SELECT i, any_value(t) AS t, avg(y) AS y FROM sig GROUP BY i")
def _(spark, d):
    return D.channel_mean(V.signal(spark, d))


DEPTHS = "dep AS (SELECT d.depth, s.channel, s.i, s.y FROM sig s JOIN (VALUES (5::BIGINT, 1::BIGINT), (3, 2), (9, 3), (2, 4), (7, 5)) d(channel, depth) USING (channel))"


@query("E06_csd", "depth, i", "y", """SELECT depth, i, CASE WHEN depth = 1 AND up THEN lead(c) OVER w WHEN depth = 5 AND down THEN lag(c) OVER w ELSE c END AS y FROM
  (SELECT depth, i, up, down, CASE WHEN up AND down THEN -(above - 2 * y + below) / (0.5::DOUBLE * 0.5::DOUBLE) END AS c FROM
    (SELECT depth, i, y, lag(y) OVER w AS below, lead(y) OVER w AS above, coalesce(lag(depth) OVER w = depth - 1, false) AS down, coalesce(lead(depth) OVER w = depth + 1, false) AS up FROM dep WINDOW w AS (PARTITION BY i ORDER BY depth)))
  WINDOW w AS (PARTITION BY i ORDER BY depth)""", DEPTHS)
def _(spark, d):
    rows = D.ordered_channels(V.signal(spark, d), (5, 3, 9, 2, 7))
    return D.current_source_density(rows, 500_000.0, 5)


@query("E07_channel_order", "depth, channel, i", "y", "SELECT depth, channel, i, y FROM dep", DEPTHS)
def _(spark, d):
    return D.ordered_channels(V.signal(spark, d), (5, 3, 9, 2, 7))


@query("E08_interval_histogram", "cluster, bin, n", "", "SELECT cluster, floor(g / 0.1)::BIGINT AS bin, count(*) AS n FROM (SELECT cluster, t - lag(t) OVER (PARTITION BY cluster ORDER BY t) AS g FROM wav) WHERE g IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return D.interval_histogram(V.waves(spark, d), 0.1)


# --- F: features ---------------------------------------------------------------------------------------------------

T0 = 1.0


def _facts(sign: str, source: str = "sig", t0: float = T0) -> str:
    order = "y DESC, t" if sign == "max" else "y, t"
    return f"""lt AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY t) AS k FROM {source} WHERE t >= {t0}),
fc AS (SELECT channel, {sign}(y) AS peak, min(t) FILTER (y = m) AS t_peak, max(t) FILTER (y = m) AS t_last, avg(y) FILTER (k <= 3) AS base3, avg(y) FILTER (k <= 5) AS base5
  FROM (SELECT *, {sign}(y) OVER (PARTITION BY channel) AS m FROM lt) GROUP BY channel),
al AS (SELECT DISTINCT channel FROM {source}), fx AS (SELECT lt.*, peak, t_peak, t_last, base3, base5 FROM lt JOIN fc USING (channel))"""


for _sign, _op in (("max", ">="), ("min", "<=")):
    _tail = "" if _sign == "max" else "_min"

    @query(f"F01_peak_latency{_tail}", "channel", "latency, peak", f"SELECT al.channel, t_peak - {T0} AS latency, peak FROM al LEFT JOIN fc USING (channel)", _facts(_sign))
    def _(spark, d, sign=_sign):
        return X.peak_latency(V.signal(spark, d), T0, sign)

    for _compat, _frac, _top in ((False, 0.3, "peak"), (True, 0.7, f"(t_peak - {T0})")):
        _end = _tail + ("_compat" if _compat else "")

        @query(f"F02_onset_delay{_end}", "channel", "delay", f"SELECT al.channel, v AS delay FROM al LEFT JOIN (SELECT channel, min(t) FILTER (y {_op} base3 + {_frac}::DOUBLE * (peak - base3)) - {T0} AS v FROM fx GROUP BY 1) USING (channel)", _facts(_sign))
        def _(spark, d, sign=_sign, compat=_compat):
            return X.onset_delay(V.signal(spark, d), T0, 0.3, sign, compat=compat)

        @query(f"F03_half_width{_end}", "channel", "width", f"SELECT al.channel, v AS width FROM al LEFT JOIN (SELECT channel, max(t) FILTER (y {_op} ({_top} + base5) / 2) - min(t) FILTER (y {_op} ({_top} + base5) / 2) AS v FROM fx GROUP BY 1) USING (channel)", _facts(_sign))
        def _(spark, d, sign=_sign, compat=_compat):
            return X.half_width(V.signal(spark, d), T0, sign, compat=compat)

        _back = "<=" if _sign == "max" else ">="
        _start = "t_last" if _compat and _sign == "max" else "t_peak"
        _later = ">" if _compat and _sign == "min" else ">="

        @query(f"F07_decay_time{_end}", "channel", "decay", f"SELECT al.channel, v AS decay FROM al LEFT JOIN (SELECT channel, min(t) FILTER (t {_later} {_start} AND y {_back} ({_top} + base5) / 2) - max({_start}) AS v FROM fx GROUP BY 1) USING (channel)", _facts(_sign))
        def _(spark, d, sign=_sign, compat=_compat):
            return X.decay_time(V.signal(spark, d), T0, sign, compat=compat)

        if not _compat:
            _lv = lambda q: f"base5 + {q}::DOUBLE * (peak - base5)"
            _cond = " AND t <= t_peak"
        else:
            _lv = lambda q, s=_sign: f"(t_peak - {T0}) - {q}::DOUBLE * ((t_peak - {T0}) - peak)"
            _cond = ""

        @query(f"F06_rise_time{_end}", "channel", "rise", f"SELECT al.channel, v AS rise FROM al LEFT JOIN (SELECT channel, min(t) FILTER (y {_op} {_lv(0.9)}{_cond}) - min(t) FILTER (y {_op} {_lv(0.1)}{_cond}) AS v FROM fx GROUP BY 1) USING (channel)", _facts(_sign))
        def _(spark, d, sign=_sign, compat=_compat):
            return X.rise_time(V.signal(spark, d), T0, sign, compat=compat)


AREA = """ba AS (SELECT *, avg(y) FILTER (k <= round(n / 10.0::DOUBLE)) OVER (PARTITION BY channel) AS b FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY t) AS k, count(*) OVER (PARTITION BY channel) AS n FROM irr)),
zs AS (SELECT channel, t, b, greatest({0}, 0) AS z FROM ba)"""
AREA_SQL = "SELECT channel, CASE WHEN max(b) IS NOT NULL THEN coalesce(sum(a), 0) END AS area FROM (SELECT channel, b, (z + lag(z) OVER w) / 2 * (t - lag(t) OVER w) AS a FROM zs WINDOW w AS (PARTITION BY channel ORDER BY t)) GROUP BY channel"


@query("F04_area_above", "channel", "area", AREA_SQL, AREA.format("y - b"))
def _(spark, d):
    return X.area(V.irregular(spark, d))


@query("F05_area_below", "channel", "area", AREA_SQL, AREA.format("b - y"))
def _(spark, d):
    return X.area(V.irregular(spark, d), positive=False)


@query("F08_amplitude", "channel", "amplitude, t_peak", "SELECT al.channel, peak - base5 AS amplitude, t_peak FROM al LEFT JOIN fc USING (channel)", _facts("max"))
def _(spark, d):
    return X.peak_amplitude(V.signal(spark, d), T0)


@query("F09_integral", "channel", "integral", "SELECT channel, coalesce(sum(a), 0) AS integral FROM (SELECT channel, (y + lag(y) OVER w) / 2 * (t - lag(t) OVER w) AS a FROM irr WINDOW w AS (PARTITION BY channel ORDER BY t)) GROUP BY channel")
def _(spark, d):
    return X.response_integral(V.irregular(spark, d), 0.0)


TABLE = _facts("max") + """, bl AS (SELECT channel, avg(y) FILTER (t BETWEEN 0.0 AND 0.5) AS b FROM sig GROUP BY 1),
st AS (SELECT s.channel, s.t, s.y, b, greatest(s.y - b, 0) AS u, greatest(b - s.y, 0) AS v FROM sig s JOIN bl USING (channel)),
ar AS (SELECT channel, sum((u + pu) / 2 * (t - pt)) AS area_above, sum((v + pv) / 2 * (t - pt)) AS area_below, sum((y + py) / 2 * (t - pt)) FILTER (pt >= 1.0) AS integral FROM
  (SELECT *, lag(u) OVER w AS pu, lag(v) OVER w AS pv, lag(y) OVER w AS py, lag(t) OVER w AS pt FROM st WINDOW w AS (PARTITION BY channel ORDER BY t)) GROUP BY 1)"""
TABLE_SQL = """SELECT channel, max(t_peak) - 1.0 AS latency, min(t) FILTER (y >= base3 + 0.5::DOUBLE * (peak - base3)) - 1.0 AS delay,
  max(t) FILTER (y >= (peak + base5) / 2) - min(t) FILTER (y >= (peak + base5) / 2) AS width, max(area_above) AS area_above, max(area_below) AS area_below,
  min(t) FILTER (y >= base5 + 0.9::DOUBLE * (peak - base5) AND t <= t_peak) - min(t) FILTER (y >= base5 + 0.1::DOUBLE * (peak - base5) AND t <= t_peak) AS rise,
  min(t) FILTER (y <= (peak + base5) / 2 AND t >= t_peak) - max(t_peak) AS decay, max(peak) - max(bl.b) AS amplitude, max(integral) AS integral
  FROM fx JOIN bl USING (channel) JOIN ar USING (channel) GROUP BY channel"""


@query("F10_feature_table", "channel", ", ".join(X.FEATURES), TABLE_SQL, TABLE)
def _(spark, d):
    return X.feature_table(V.signal(spark, d), X.FEATURES, T0, (0.0, 0.5))


@query("F11_baseline", "channel", "baseline", "SELECT channel, avg(y) FILTER (t BETWEEN 0.2 AND 0.8) AS baseline FROM sig GROUP BY 1")
def _(spark, d):
    return X.baseline_value(V.signal(spark, d), (0.2, 0.8))


@query("F11_baseline_default", "channel", "baseline", "SELECT channel, avg(y) FILTER (t < 0.05) AS baseline FROM sig GROUP BY 1")
def _(spark, d):
    return X.baseline_value(V.signal(spark, d), None)
