"""Known small cases of the operators."""

import math
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import T0
from wattframe import Series
from wattframe.operators import counters, events, features, grid, matrix, ml, risk, score, stats

S = Series(("server",), "ts", (), 3600.0)
TR = Series(("k",), "time_s", (), 1000.0)


def secs(rows, col="ts"):
    return sorted((r[col] - T0).total_seconds() for r in rows)


def times(spark, at):
    return spark.createDataFrame([("a", T0 + timedelta(seconds=s)) for s in at], "server STRING, ts TIMESTAMP")


def test_step_gives_one_rise_and_label_before_it(series_of):
    df = series_of(power_watts=[100] * 40 + [220] * 40)
    assert secs(events.true_transitions(df, S, "power_watts").collect()) == [40.0]
    assert events.true_transitions(df, S, "power_watts", "drop").count() == 0
    lab = features.with_label(df, S, direction="rise", k=1e9).filter("label = 1")
    assert secs(lab.collect()) == [35.0, 36.0, 37.0, 38.0, 39.0]


def test_event_score_case(spark):
    out = score.event_score(times(spark, (10, 30, 50)), times(spark, (8, 31, 80)), S).first()
    assert out["event_recall"] == pytest.approx(2 / 3)
    assert out["event_latency_median_s"] == pytest.approx(-0.5)
    assert (out["n_alert_episodes"], out["n_false_alert_episodes"]) == (3, 1)


def test_perfect_ranking_has_full_precision(spark):
    rows = [(1.0, 1)] * 10 + [(-1.0, 0)] * 90
    df = spark.createDataFrame(rows, "score DOUBLE, label INT")
    assert score.pr_auc(df, [], "label", "score").first()["pr_auc"] == pytest.approx(1.0)
    r = score.flag_score(df, [], "label", "score").first()
    assert (r["precision"], r["recall"]) == (1.0, 1.0)


def test_plateau_keeps_dip(spark):
    up = np.linspace(200, 400, 800)
    flat = np.full(1000, 400.0)
    flat[400:420] = 210.0
    down = np.linspace(400, 200, 600)
    p = np.concatenate([up, flat, down])
    df = spark.createDataFrame([("x", 0.1 * i, float(v)) for i, v in enumerate(p)], "k STRING, time_s DOUBLE, power_W DOUBLE")
    w = events.plateau_window(df, TR, "power_W")
    r = w.first()
    assert 77 <= r["t_start"] <= 80.5 and 180 <= r["t_end"] <= 183
    kept = events.trim_to_window(df, w, TR)
    assert kept.filter("power_W = 210").count() == 20
    assert kept.agg(F.min("time_s")).first()[0] == 0.0


def test_trim_ends(spark):
    df = spark.createDataFrame([("x", float(i), 100.0 + i) for i in range(11)], "k STRING, time_s DOUBLE, power_W DOUBLE")
    kept, _ = events.trim_ends(df, TR, 2, 3)
    rows = sorted((r["time_s"], r["power_W"]) for r in kept.collect())
    assert rows == [(float(i), 102.0 + i) for i in range(6)]
    assert events.trim_ends(df, TR, 6, 6)[1].count() == 1


def test_repeated_time_is_dropped(spark):
    df = spark.createDataFrame([("x", i, t) for i, t in enumerate((0.0, 0.1, 0.1, 0.2, 0.3))], "k STRING, seq INT, time_s DOUBLE")
    out = grid.drop_nonincreasing(df, Series(("k",), "seq", (), 100), "time_s")
    assert sorted(r["seq"] for r in out.collect()) == [0, 1, 3, 4]


def test_frequency_and_voltage(spark):
    f = spark.createDataFrame([("x", 0.0, 0.0), ("x", 1.0, -0.05), ("x", 2.0, -0.02)], "k STRING, time_s DOUBLE, delta_f_hz DOUBLE")
    r = risk.frequency_metrics(f, TR).first()
    assert (r["freq_nadir_hz"], r["rocof_max_hz_per_s"]) == (59.95, 0.05)
    v = spark.createDataFrame([("x", float(i), p) for i, p in enumerate((1.0, 0.97, 0.99))], "k STRING, time_s DOUBLE, v_pu DOUBLE")
    r = risk.voltage_metrics(v, TR).first()
    assert (r["min_voltage_pu"], r["voltage_sag_depth_pu"], r["voltage_sag_events_per_yr"]) == (0.97, 0.03, 0.0)


def test_resampling_hides_solver_steps(spark):
    rows = [("x", 0, 0.0, 0.0), ("x", 1, 1.0, 0.0), ("x", 2, 1.00001, 16_000.0), ("x", 3, 2.0, 16_000.0)]
    df = spark.createDataFrame(rows, "k STRING, seq INT, time_s DOUBLE, P_W DOUBLE")
    out = risk.risk_metrics(risk.sanitize(df, TR, "seq", "P_W"), TR).first()
    assert out["n_exceedances_in_trace"] == 0


def test_energy_ratio(spark):
    df = spark.createDataFrame([(k, float(i), p) for k, p in (("a", 100.0), ("b", 200.0)) for i in range(3)], "k STRING, time_s DOUBLE, power_W DOUBLE")
    e = {r["k"]: r["energy_j"] for r in risk.energy(df, TR).collect()}
    assert e == {"a": 200.0, "b": 400.0}


def test_counter_wrap_and_stall(spark):
    def polls(values, rng=None):
        return spark.createDataFrame([("a", 0.1 * i, v) for i, v in enumerate(values)], "k STRING, time_s DOUBLE, e LONG").withColumn(
            "max_range", F.lit(rng).cast("long")
        )

    d = counters.energy_deltas(polls([10**9 - 100, 400], 10**9), TR, "e", "max_range")
    assert [r["delta"] for r in d.collect() if r["delta"] is not None] == [500]
    out = counters.stall_safe_power(polls([0, 0, 0, 300_000]), TR, "e", "max_range").filter("watts IS NOT NULL").collect()
    assert len(out) == 1 and out[0]["watts"] == pytest.approx(1.0)


def test_rate_reset_is_dropped(spark):
    df = spark.createDataFrame([("a", 0.0, 100), ("a", 2.0, 200), ("a", 4.0, 5)], "k STRING, time_s DOUBLE, c LONG")
    assert [r["c_per_s"] for r in counters.rates(df, TR, ["c"]).collect()] == [50.0]


def test_hawkes_decay(series_of):
    df = series_of(nr=[0, 0, 3, 3, 3])
    out = features.with_hawkes(df, S, "nr", "h", tau_s=1.0).orderBy("ts").collect()
    assert [r["h"] for r in out][2:] == pytest.approx([3, 3 * math.exp(-1), 3 * math.exp(-2)])


def test_flag_episode_starts(spark):
    rn = [*range(10, 15), *range(20, 25), *range(200, 205)]
    df = spark.createDataFrame([("a", r) for r in rn], "server STRING, rn LONG")
    out = events.flag_episodes(df, S, 50)
    assert sorted(r["rn"] for r in out.collect()) == [10, 200]


def test_segments_split_at_gap(spark):
    df = times(spark, [*range(50), *range(100, 150)])
    seg = events.with_segments(df, S, 2.0).groupBy("segment").count().collect()
    assert sorted((r["segment"], r["count"]) for r in seg) == [(0, 50), (1, 50)]


def test_signed_edges(series_of):
    for pair, exp in (((2, 22), 1), ((30, 40), 1), ((30, 31), 0), ((22, 2), -1), ((4, 2), 0)):
        out = events.usage_edges(series_of(0.1, usage_percent=pair), S).orderBy("ts").collect()
        assert out[1]["edge"] == exp


def test_burst_period(spark):
    period = events.cycle_seconds(F.lit(18.0), F.lit(3.0), F.lit(0.003), F.lit(128))
    run = spark.createDataFrame([("a", T0, T0 + timedelta(seconds=3 * 21.768 + 1), 18.0, 3.0, 0.003, 128)],
        "server STRING, start_ts TIMESTAMP, end_ts TIMESTAMP, busy_s DOUBLE, dip_s DOUBLE, stagger_s DOUBLE, ranks INT")
    assert run.select(period.alias("p")).first()["p"] == pytest.approx(21.768)
    assert events.burst_schedule(run, S).count() == 4


def test_onset_on_short_capture_and_overshoot(spark, series_of):
    z = [120.0] * 20 + [217.0] * 15 + [204.0] * 40
    df = grid.number_rows(series_of(0.1, z=z), S, "rn")
    on = events.find_onsets(series_of(0.1, z=z), S, "z")
    assert [r["rn"] for r in on.collect()] == [20]
    r = events.overshoot(on, df, S, "z").first()
    assert abs(r["pl1"] - 204) <= 2 and abs(r["pl2"] - 217) <= 2 and 1.3 <= r["window_s"] <= 1.7


def test_step_lag_signs(series_of):
    base = [0.0] * 120
    early, same = list(base), list(base)
    for i in range(78, 120):
        early[i] = 50.0
    for i in range(81, 120):
        same[i] = 50.0
    df = series_of(power=[100.0] * 81 + [200.0] * 39, early=early, same=same, flat=base)
    on = events.hf_onsets(df, S, "power")
    num = grid.number_rows(df, S, "rn")
    lags = {c: events.step_lag(on, num, S, c).first()["lag"] for c in ("early", "same", "flat")}
    assert lags == {"early": -3, "same": 0, "flat": None}


def test_wall_clock_anchor(spark):
    df = spark.createDataFrame([(T0 + timedelta(hours=12, minutes=8, seconds=14),)], "ev TIMESTAMP")
    hms = [F.lit(8), F.lit(8), F.lit(14)]
    df = df.withColumn("off", grid.utc_offset_hours(F.col("ev"), hms))
    r = df.select("off", grid.anchor_utc(F.col("ev"), hms, F.col("off"), F.lit(0.0)).alias("a"), "ev").first()
    assert r["off"] == 4 and r["a"] == r["ev"]


def test_two_level_board_and_rank(spark):
    rows = [(r, w, arm, "cv_pct", v + r) for r in (1, 2) for w in ("x", "y") for arm, v in (("p", -50.0), ("q", 10.0))]
    long = spark.createDataFrame(rows, "run INT, workload STRING, arm STRING, metric STRING, pct DOUBLE")
    board = matrix.ranked(matrix.spread_metrics(matrix.two_level(long, ["arm", "metric"], "pct"), ["arm"], ["cv_pct"]))
    out = {r["arm"]: r for r in board.collect()}
    assert out["p"]["rank"] == 1 and out["p"]["cv_pct"] == -48.5 and out["p"]["cv_pct_sd"] == 0.7
    assert out["p"]["verdict"].startswith("strong smoothing: 48%")
    assert out["q"]["verdict"].startswith("WORSENS")


def test_student_t_tail():
    assert stats.t_two_sided(2.0, 10.0) == pytest.approx(0.0733880, abs=1e-6)
    assert stats.t_two_sided(0.0, 5.0) == pytest.approx(1.0)


def test_spectrum_matches_numpy(series_of):
    x = np.sin(2 * np.pi * np.arange(60) / 12) + np.cos(np.arange(60))
    got = stats.spectrum(series_of(v=x), S, "v").orderBy("k").toPandas()
    exp = np.abs(np.fft.rfft(x - x.mean())) ** 2
    assert np.allclose(got.power, exp[1:])


def test_features_do_not_see_the_future(series_of):
    rng = np.random.default_rng(1)
    n = 120
    cols = dict(power_watts=rng.normal(200, 60, n), usage_percent=rng.uniform(0, 100, n), nr_running=rng.integers(0, 20, n), freq_mhz=rng.uniform(1000, 3000, n))
    whole, names = features.feature_frame(series_of(**cols), S, upstream=True)
    cut, _ = features.feature_frame(series_of(**{k: v[:90] for k, v in cols.items()}), S, upstream=True)
    a = whole.orderBy("ts").limit(90).toPandas()[names]
    b = cut.orderBy("ts").toPandas()[names]
    assert np.allclose(a.astype(float), b.astype(float), equal_nan=True, rtol=1e-9)


def test_promotion_rule():
    m = lambda **k: {"n_events": 5, "event_recall": 0.5, "alert_duty": 0.1, "event_latency_median_s": 1.0, "pr_auc": 0.5, "lead_time_median_s": 1.0, **k}
    assert not ml.beats(None, m()) and ml.beats(m(), None)
    assert ml.beats(m(event_recall=0.6, alert_duty=0.115), m())
    assert not ml.beats(m(event_recall=0.6, alert_duty=0.2), m())
    assert not ml.beats(m(event_recall=0.4, alert_duty=0.0), m())
    assert ml.beats(m(alert_duty=0.05), m()) and not ml.beats(m(), m())
    assert not ml.beats(m(alert_duty=0.05, event_latency_median_s=3.0), m())
    assert ml.beats(m(alert_duty=0.05, event_latency_median_s=3.0), m(), gate="duty_normalised")
    assert ml.beats(m(n_events=0, pr_auc=0.6), m(n_events=0))
    assert not ml.beats(m(n_events=0, pr_auc=0.6, lead_time_median_s=0.5), m(n_events=0))


def test_idle_rows_raise_the_threshold(spark):
    rows = [(0.30, 1.0, 100.0)] * 1000 + [(0.34, 1.0, 100.0)] * 5
    df = spark.createDataFrame(rows, "score DOUBLE, usage_lag0 DOUBLE, p DOUBLE")
    df = df.withColumns({f"power_lag{k}": F.col("p") for k in range(4)})
    thr = ml.calibrate_threshold(df)
    assert df.filter(F.col("score") > thr).count() == 0
