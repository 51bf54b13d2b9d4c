"""Ranges, loading, conditioning, trials and features on small hand-made signals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.functions import dsp
from axonframe.operators import conditioning, features, ranges, trials
from axonframe.sources import readers, sinks


def signal(spark, values, fs=1000.0, channel=1):
    return spark.createDataFrame([(channel, k + 1, k / fs, None if v is None else float(v)) for k, v in enumerate(values)], "channel long, i long, t double, y double")


def ys(df, order="i"):
    return [r["y"] for r in df.orderBy(order).collect()]


# --- loading -------------------------------------------------------------------------------------------------------


def export(spark, data, starts, ends, fs):
    block = spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(data)], "pos long, v double")
    index = spark.createDataFrame([(k + 1, s, e, f) for k, (s, e, f) in enumerate(zip(starts, ends, fs, strict=True))], "channel long, start long, end long, fs double")
    return block, index


def test_loads_two_of_three_channels(spark):
    block, index = export(spark, range(3000), (1, 501, 1001), (500, 1000, 1500), (1000.0,) * 3)
    rows = readers.load_export(block, index, 1, 2).orderBy("i").collect()
    assert len(rows) == 500 and rows[0]["stim"] == 0 and rows[0]["flow"] == 500 and rows[-1]["t"] == pytest.approx(0.499)


def test_loads_channels_6_and_8_unless_told(spark):
    block, index = export(spark, range(1600), range(1, 1600, 200), range(200, 1601, 200), (1000.0,) * 8)
    rows = readers.load_export(block, index).collect()
    assert len(rows) == 200 and min(r["stim"] for r in rows) == 1000 and min(r["flow"] for r in rows) == 1400


def test_refuses_what_is_no_export(spark):
    block, index = export(spark, range(10), (1,), (10,), (1000.0,))
    assert readers.validate_export(block, index) and not readers.validate_export(block, None)
    with pytest.raises(ValueError):
        readers.load_export(block, index.drop("start"), 1, 1)
    with pytest.raises(ValueError, match="no such channel"):
        readers.load_export(block, index, 1, 2)


# --- ranges --------------------------------------------------------------------------------------------------------


def test_crop(spark):
    rows = ranges.crop(signal(spark, range(1, 1001)), 100, 500, 1000.0).orderBy("i").collect()
    assert len(rows) == 401 and rows[0]["t"] == 0 and rows[-1]["t"] == pytest.approx(0.4)
    assert ranges.crop(signal(spark, range(100), 100.0), 1, 1000, 100.0).count() == 100
    assert ranges.crop(signal(spark, range(100), 100.0), 50, 20, 100.0).count() == 100
    assert ranges.crop(signal(spark, range(100), 100.0), 0, 9, 100.0).count() == 9


def test_crop_of_unequal_lengths(spark):
    pair = ranges.crop_pair(signal(spark, range(100), 100.0), signal(spark, range(80), 100.0), 10, 50, 100.0)
    assert pair.count() == 41
    late = ranges.crop_pair(signal(spark, range(100)), signal(spark, range(80)), 90, 95, 100.0).collect()
    assert [r["stim"] for r in late] == [79.0]


@pytest.mark.parametrize(("a", "b", "ok"), [(1, 5, True), (5, 2, False), (math.nan, 5, False), (-1, 5, False), (1, 15, False), (0, 10, True), ("1", 5, False)])
def test_range_check(a, b, ok):
    assert ranges.check_range(a, b, 10)[0] is ok


def test_rounding_goes_away_from_zero():
    assert ranges.seconds_to_samples(0.5, 2.5, 1.0) == (1, 3)


# --- filters -------------------------------------------------------------------------------------------------------


def gain(sos, hz, fs):
    return abs(dsp.response(sos, np.array([2 * np.pi * hz / fs])))[0]


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5, 8])
@pytest.mark.parametrize(("kind", "cutoff"), [("low", 100.0), ("high", 100.0), ("band", (50.0, 200.0)), ("stop", (50.0, 200.0)), ("band", (0.5, 5.0))])
def test_butterworth_is_half_power_at_its_cutoffs(kind, cutoff, order):
    sos = dsp.design(kind, order, cutoff, 1000.0)
    for c in np.atleast_1d(cutoff):
        assert gain(sos, c, 1000.0) == pytest.approx(0.5**0.5, rel=1e-6)
    inside = {"low": 0.0, "high": 500.0, "band": 1000 / np.pi * np.arctan(np.sqrt(np.prod(np.tan(np.pi * np.atleast_1d(cutoff) / 1000)))), "stop": 0.0}[kind]
    assert gain(sos, inside, 1000.0) == pytest.approx(1.0, rel=1e-6)
    assert np.abs(np.concatenate([np.roots(s[3:]) for s in sos])).max() < 1


@pytest.mark.parametrize("order", [2, 3, 4, 5])
def test_chebyshev_ripples_by_half_a_decibel(order):
    sos = dsp.design("low", order, 100.0, 1000.0, 0.5)
    db = 20 * np.log10([gain(sos, f, 1000.0) for f in np.linspace(0, 100, 400)])
    assert db.max() == pytest.approx(0, abs=1e-6) and db.min() == pytest.approx(-0.5, abs=1e-3)


def test_notch_takes_the_line_alone():
    sos = dsp.notch(60.0, 1000.0)
    assert gain(sos, 60.0, 1000.0) < 1e-9 and gain(sos, 0.0, 1000.0) == pytest.approx(1) and gain(sos, 50.0, 1000.0) > 0.97


@pytest.mark.parametrize(("kind", "cutoff", "at"), [("low", 100.0, 0.0), ("high", 100.0, 500.0), ("band", (100.0, 200.0), 150.0), ("stop", (100.0, 200.0), 0.0)])
def test_fir_has_unit_gain_in_its_band(kind, cutoff, at):
    taps = dsp.fir(kind, 51, cutoff, 1000.0)
    assert len(taps) == (53 if kind in ("high", "stop") else 52)
    assert abs(np.sum(taps * np.exp(-2j * np.pi * at / 1000 * np.arange(len(taps))))) == pytest.approx(1, abs=1e-9)


def test_zero_phase_keeps_the_phase_and_squares_the_gain(spark):
    t = np.arange(4000) / 1000
    x = np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 200 * t)
    y = dsp.zero_phase(dsp.design("low", 4, 50.0, 1000.0), x)
    assert np.abs(y - np.sin(2 * np.pi * 5 * t))[100:-100].max() < 2e-3
    assert np.allclose(dsp.zero_phase(dsp.design("low", 4, 50.0, 1000.0), np.full(500, 3.0)), 3.0)
    short = np.arange(5.0)
    assert np.array_equal(dsp.zero_phase(dsp.design("low", 4, 50.0, 1000.0), short), short)
    got = ys(conditioning.filtered(signal(spark, x), dsp.design("low", 4, 50.0, 1000.0)))
    assert np.allclose(got, y)


def test_chunks_agree_with_the_whole(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=6000).cumsum()
    sos = dsp.design("band", 2, (20.0, 200.0), 1000.0)
    df = signal(spark, x)
    whole, cut = ys(conditioning.filtered(df, sos)), ys(conditioning.filtered(df, sos, chunk=1500))
    assert len(cut) == 6000 and np.abs(np.array(whole) - cut).max() < 1e-5 * np.abs(x).max()


def test_missing_samples_are_held(spark):
    sos = dsp.design("low", 2, 100.0, 1000.0)
    gaps, full = [None, None, 1, None, 5] + [2.0] * 60, [1, 1, 1, 1, 5] + [2.0] * 60
    assert ys(conditioning.filtered(signal(spark, gaps), sos)) == pytest.approx(ys(conditioning.filtered(signal(spark, full), sos)))
    assert ys(conditioning.filtered(signal(spark, [None] * 40), sos)) == [None] * 40
    assert conditioning.filtered(signal(spark, [1.0]).limit(0), sos).count() == 0


def test_decimation(spark):
    df = signal(spark, range(20), 10.0)
    assert ys(conditioning.decimated(df, 5)) == [0, 5, 10, 15]
    _, rate = conditioning.decimated_smoothly(signal(spark, range(200), 10.0), 10.0, 4.0)
    assert rate == pytest.approx(10 / 3)
    assert conditioning.decimated_smoothly(signal(spark, range(200), 10.0), 10.0, 4.0, compat=True)[1] == 4.0


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7])
def test_boxcar_is_the_middle_of_the_full_sum(spark, width):
    x = np.random.default_rng(width).normal(size=20)
    full = np.convolve(x, np.ones(width) / width)
    start = math.ceil((width + 1) / 2) - 1
    assert np.allclose(ys(conditioning.boxcar(signal(spark, x), width)), full[start : start + 20])


@pytest.mark.parametrize(("kind", "cutoff", "order"), [("low", 600.0, 4), ("band", (200.0, 100.0), 4), ("low", 10.0, 0), ("low", -1.0, 2), ("none such", 10.0, 2)])
def test_bad_filters_are_refused(kind, cutoff, order):
    with pytest.raises(ValueError):
        dsp.design(kind, order, cutoff, 1000.0)


# --- onsets and trials ---------------------------------------------------------------------------------------------


def pulses(spark, at, n=40):
    return signal(spark, [1.0 if k in at else 0.0 for k in range(1, n + 1)], 1.0)


def test_a_series_that_starts_high_has_an_onset(spark):
    assert [r["i"] for r in trials.rising_edges(pulses(spark, {1, 2, 9}), 0.5).orderBy("i").collect()] == [1, 9]


def test_greedy_and_successive_rules_differ(spark):
    edges = trials.rising_edges(pulses(spark, {1, 4, 7}), 0.5)
    assert [r["i"] for r in trials.greedy_gap(edges, 5).orderBy("i").collect()] == [1, 7]
    assert [r["i"] for r in trials.successive_gap(edges, 5.0).collect()] == [1]
    exact = trials.rising_edges(pulses(spark, {1, 6}), 0.5)
    assert trials.greedy_gap(exact, 5).count() == 2 and trials.successive_gap(exact, 5.0).count() == 1


def test_incomplete_trials_go(spark):
    onsets = trials.rising_edges(pulses(spark, {2, 20, 39}), 0.5)
    got = trials.windows_at(pulses(spark, {2, 20, 39}), onsets, 3, 4, 1.0)
    assert {r["onset"] for r in got.collect()} == {20} and got.count() == 8
    assert sorted(r["t_rel"] for r in got.collect()) == list(range(-3, 5))


def test_one_trial_has_no_deviation(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 5.0)], "trial long, i long, t_rel double, y double")
    assert trials.mean_and_sd(df).first()["sd"] == 0


def test_baseline_needs_prestimulus_samples(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 5.0)], "trial long, i long, t_rel double, y double")
    with pytest.raises(ValueError):
        trials.require_prestimulus(df)


def test_quadratic_depth_profile_has_constant_csd(spark):
    rows = [(k, k, 1, float(3 * k * k)) for k in range(1, 7)]
    df = spark.createDataFrame(rows, "channel long, depth long, i long, y double")
    assert {round(r["y"], 6) for r in trials.current_source_density(df, 1e6, 6).collect()} == {-6.0}
    with pytest.raises(ValueError):
        trials.current_source_density(df, 100.0, 2)
    with pytest.raises(ValueError, match="unknown channels"):
        trials.ordered_channels(df, [1, 99])


def test_other_time_axes_are_left_out(spark):
    rows = [(f, 1, i, i / 10 + (0.5 if f == "b" else 0), 1.0) for f in "abc" for i in range(3)]
    got = readers.union_trials(spark.createDataFrame(rows, "file string, trial long, i long, t_rel double, y double"))
    assert got.count() == 6 and {r["trial"] for r in got.collect()} == {1, 2}


# --- features ------------------------------------------------------------------------------------------------------


def bump(spark, sign=1):
    t = np.arange(0, 2, 0.001)
    y = sign * 4 * np.exp(-((t - 1) ** 2) / (2 * 0.1**2))
    return spark.createDataFrame([(1, k + 1, float(a), float(b)) for k, (a, b) in enumerate(zip(t, y, strict=True))], "channel long, i long, t double, y double")


@pytest.mark.parametrize(("sign", "direction"), [(1, "max"), (-1, "min")])
def test_features_of_a_bump(spark, sign, direction):
    df = bump(spark, sign)
    lat = features.peak_latency(df, 0.0, direction).first()
    assert lat["latency"] == pytest.approx(1.0) and lat["peak"] == pytest.approx(4 * sign)
    assert features.half_width(df, 0.0, direction).first()["width"] == pytest.approx(2 * 0.1 * math.sqrt(2 * math.log(2)), abs=0.003)
    assert features.onset_delay(df, 0.0, 0.5, direction).first()["delay"] == pytest.approx(1 - 0.1 * math.sqrt(2 * math.log(2)), abs=0.002)
    rise = 0.1 * (math.sqrt(2 * math.log(10)) - math.sqrt(2 * math.log(1 / 0.9)))
    assert features.rise_time(df, 0.0, direction).first()["rise"] == pytest.approx(rise, abs=0.003)
    assert features.decay_time(df, 0.0, direction).first()["decay"] == pytest.approx(0.1 * math.sqrt(2 * math.log(2)), abs=0.002)
    area = features.area(df, positive=sign > 0).first()["area"]
    assert area == pytest.approx(4 * 0.1 * math.sqrt(2 * math.pi), rel=1e-3)


def test_nothing_after_the_stimulus_is_null(spark):
    df = signal(spark, [1, 2, 3])
    assert features.peak_latency(df, 10.0).first()["latency"] is None
    assert features.half_width(df, 10.0).first()["width"] is None
    assert features.response_integral(df, 10.0).first()["integral"] is None
    assert features.area(df).first()["area"] is None


def test_of_equal_extrema_the_first_counts(spark):
    assert features.peak_latency(signal(spark, [0, 5, 5, 1], 1.0)).first()["latency"] == 1
    assert features.peak_latency(signal(spark, [0, -5, -5, 1], 1.0), 0.0, "min").first()["latency"] == 1


def test_established_quirks(spark):
    """Levels that take the latency for the peak, and a fraction that counts down."""
    df = signal(spark, [0, 0, 0, 0, 0, 10, 8, 6, 4, 2, 1, 0], 1.0)
    assert features.onset_delay(df, 0.0, 0.1).first()["delay"] == 5 and features.onset_delay(df, 0.0, 0.9, compat=True).first()["delay"] == 5
    assert features.half_width(df).first()["width"] == 2  # at or above 5
    assert features.half_width(df, compat=True).first()["width"] == 3  # at or above (5 + 0) / 2
    assert features.decay_time(df).first()["decay"] == 3 and features.decay_time(df, compat=True).first()["decay"] == 4


def test_unselected_features_are_null(spark):
    row = features.feature_table(bump(spark), ("latency",)).first()
    assert row["latency"] == pytest.approx(1) and all(row[f] is None for f in features.FEATURES if f != "latency")
    with pytest.raises(ValueError):
        features.feature_table(bump(spark), ("none such",))


# --- sinks ---------------------------------------------------------------------------------------------------------


def test_sinks(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        sinks.write_cropped(spark.createDataFrame([], "i long, t double, stim double, flow double"), str(tmp_path / "a"))
    rows = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 0.1, 2.0)], "trial long, i long, t_rel double, y double")
    path = str(tmp_path / "trials")
    sinks.append_trials(rows, path)
    sinks.append_trials(rows, path)
    assert {r["trial"] for r in spark.read.parquet(path).collect()} == {1, 2}
    with pytest.raises(ValueError, match="time axis"):
        sinks.append_trials(rows.withColumn("t_rel", F.col("t_rel") + 1), path)
    sinks.write_features(rows, str(tmp_path / "f.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f.csv")).columns == rows.columns
