"""Scans with one read, rank indexes and relayed recursions against plain loops."""

import random
from datetime import timedelta

import numpy as np
import pytest
from conftest import T0
from pyspark.sql import functions as F

from wattframe import catalog
from wattframe.operators import counters, events, features, ml, stats
from wattframe.plans.blocks import Ranks
from wattframe.plans.quantiles import descending_rank
from wattframe.plans.timeline import (
    Timeline,
    first_seen,
    following,
    last_before,
    last_seen,
    previous,
    running_count,
    running_max,
    running_min,
    running_sum,
    series_max,
    series_min,
)
from wattframe.series import Series

TABLES = {"c1_wrapped_delta": 1, "c3_stall_safe_power": 1, "c4_windowed_power": 1, "c5_combined_sockets": 1, "e2_true_transitions": 1,
          "e17_pulse_cooldown": 1, "g1_trace_energy": 1, "g2_ramp_risk": 1, "g31_event_score": 1, "g42_power_cdf": 1}


@pytest.mark.parametrize("name", TABLES)
def test_sources_are_planned_once(spark, name):
    catalog.load()
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= TABLES[name]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def series_rows(seed, n, hot=0.7):
    """Rows of three servers, one with most of them; times may tie, values may be null."""
    r, rows, at = random.Random(seed), [], {"a": 0, "b": 0, "c": 0}
    for i in range(n):
        s = "a" if r.random() < hot else r.choice("bc")
        at[s] += r.choice([0, 1, 1, 2, 30])
        rows.append((s, T0 + timedelta(seconds=at[s]), i, r.choice([None, float(r.randrange(50))])))
    r.shuffle(rows)
    return rows


def by_server(rows):
    out = {}
    for row in sorted(rows, key=lambda x: (x[1], x[2])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("width", [3.0, 40.0, 1e6])
@pytest.mark.parametrize("reverse", [False, True])
def test_two_scans_in_one_pass(spark, width, reverse):
    rows = series_rows(1, 300)
    df = spark.createDataFrame(rows, "server STRING, ts TIMESTAMP, seq LONG, v DOUBLE")
    rise = F.col("v") > F.col("p")
    mark = F.when(rise, F.col("seq"))
    tl = Timeline(df, Series(("server",), "ts", ("seq",), width)).scan(p=previous(F.col("v")))
    got = tl.with_columns({"rise": rise}).scan(
        reverse=reverse, n=running_sum(F.when(F.col("rise"), 1).otherwise(0)), last=last_seen(mark), before=last_before(mark),
        first=first_seen(mark), top=running_max(mark), low=running_min(mark), lag=previous(mark), lead=following(mark), k=running_count(),
    ).done()
    got = {r.seq: r for r in got.collect()}
    assert len(got) == len(rows)
    for own in by_server(rows).values():
        p = [None, *[x[3] for x in own[:-1]]]
        m = [x[2] if x[3] is not None and q is not None and x[3] > q else None for x, q in zip(own, p, strict=True)]
        order = range(len(own) - 1, -1, -1) if reverse else range(len(own))
        seen, n = [], 0
        for k, i in enumerate(order):
            x, r = own[i], got[own[i][2]]
            past = [y for y in seen if y is not None]
            assert r.before == (past[-1] if past else None)
            assert r.lag == (seen[-1] if seen else None)
            seen.append(m[i])
            past = [y for y in seen if y is not None]
            n += m[i] is not None
            step = -1 if reverse else 1
            ahead = m[i + step] if 0 <= i + step < len(own) else None
            assert (r.p, r.n, r.k, r.lead) == (p[i], n, k + 1, ahead)
            assert (r.last, r.first) == ((past[-1], past[0]) if past else (None, None))
            assert (r.top, r.low) == ((max(past), min(past)) if past else (None, None))


def test_whole_series_values(spark):
    rows = series_rows(2, 200)
    df = spark.createDataFrame(rows, "server STRING, ts TIMESTAMP, seq LONG, v DOUBLE")
    got = Timeline(df, Series(("server",), "ts", ("seq",), 20.0)).scan(hi=series_max(F.col("v")), lo=series_min(F.col("v"))).done().collect()
    for s, own in by_server(rows).items():
        known = [x[3] for x in own if x[3] is not None]
        assert {(r.hi, r.lo) for r in got if r.server == s} == {(max(known), min(known))}


def test_timeline_of_no_rows(spark):
    df = spark.createDataFrame([], "server STRING, ts TIMESTAMP, v DOUBLE")
    tl = Timeline(df, Series(("server",), "ts", ())).scan(p=previous(F.col("v"))).scan(n=running_count())
    assert tl.done().count() == 0


def test_rank_index_like_sorting():
    r = np.random.default_rng(3)
    for n, kinds in ((1, 1), (7, 2), (500, 5), (3000, 3000)):
        v = r.integers(0, kinds, n).astype(float)
        start = r.integers(0, n + 1, 400)
        stop = np.array([r.integers(a, n + 1) for a in start])
        ranks = Ranks(v)
        for q in (0.0, 0.37, 1.0):
            got = ranks.quantile(start, stop, q)
            for a, b, x in zip(start, stop, got, strict=True):
                assert np.isnan(x) if a == b else np.isclose(x, np.quantile(v[a:b], q))
    assert np.isnan(Ranks(np.empty(0)).kth(np.array([0]), np.array([0]), np.array([0]))).all()


@pytest.mark.parametrize("width, every", [(25.0, 1), (25.0, 4), (1e6, 7)])
def test_rank_threshold_like_a_loop(spark, width, every):
    rows = series_rows(4, 400)
    df = spark.createDataFrame(rows, "server STRING, ts TIMESTAMP, seq LONG, v DOUBLE")
    got = features.rank_threshold(df, Series(("server",), "ts", ("seq",), width), "v", 20, 0.8, 3.0, 4, every)
    got = {r.seq: r.threshold for r in got.collect()}
    for own in by_server(rows).values():
        for i, x in enumerate(own):
            at = i - i % every
            past = [y[3] for y in own[max(at - 20, 0) : at] if y[3] is not None]
            assert np.isclose(got[x[2]], max(np.quantile(past, 0.8), 3.0) if len(past) >= 4 else 3.0)


@pytest.mark.parametrize("width", [5.0, 60.0, 1e6])
def test_relayed_filter_and_slew_limit(spark, width):
    r = random.Random(5)
    rows = [(s, t, k, None if v is None else v * r.choice([1.0, 1.0, 50.0])) for s, t, k, v in series_rows(6, 400)]
    df = spark.createDataFrame(rows, "server STRING, ts TIMESTAMP, seq LONG, v DOUBLE")
    series = Series(("server",), "ts", ("seq",), width)
    kf = {x.seq: x for x in features.kalman(df, series, "v").collect()}
    slew = {x.seq: x.limited for x in features.slew_limit(df, series, "v", 4.0, 9.0).collect()}
    for own in by_server(rows).values():
        own = [x for x in own if x[3] is not None]
        z = np.array([x[3] for x in own])
        want, _ = features.kalman_rows(z, None, 0.1, 5.0, 1.0, False)
        y = z[0]
        for x, v, w in zip(own, z, want, strict=True):
            y = min(y + 4.0, v) if v > y else max(y - 9.0, v)
            assert slew[x[2]] == pytest.approx(y, abs=1e-9)
            k = kf[x[2]]
            assert (k.pred_next, k.level, k.slope, k.innov) == pytest.approx(tuple(w), abs=1e-6)
    assert len(kf) == len(slew) == sum(x[3] is not None for x in rows)


def test_slew_map_of_any_start():
    r = random.Random(7)
    for _ in range(60):
        m, z = features.SlewMap(3.0, 5.0), [r.uniform(0, 60) for _ in range(r.randrange(1, 25))]
        for v in z:
            m.add(v)
        for _ in range(20):
            x = r.uniform(-80, 140)
            y = x
            for v in z:
                y = min(y + 3.0, v) if v > y else max(y - 5.0, v)
            assert features.SlewMap.value(np.array(m.xs), np.array(m.ys), x) == pytest.approx(y)


def test_windowed_power_like_a_loop(spark):
    r = random.Random(8)
    rows = []
    for s in "ab":
        t, e = 0.0, 0.0
        for _ in range(300):
            t, e = t + r.choice([0.25, 0.5, 2.0]), e + r.choice([0.0, 0.0, 10.0, 40.0])
            rows.append((s, t, e))
    df = spark.createDataFrame(rows, "socket STRING, t DOUBLE, uj DOUBLE").withColumn("top", F.lit(1e9))
    got = counters.windowed_power(df, Series(("socket",), "t", (), 7.0), "uj", "top", 1.5).collect()
    want = []
    for s in "ab":
        own = [x for x in rows if x[0] == s]
        uj = sec = 0.0
        for (_, t0, e0), (_, t1, e1) in zip(own, own[1:], strict=False):
            uj, sec = uj + e1 - e0, sec + t1 - t0
            if e1 > e0 and sec >= 1.5:
                want.append((s, t1, uj * 1e-6 / sec))
                uj = sec = 0.0
    assert [(x.socket, x.t) for x in sorted(got)] == [x[:2] for x in want]
    assert [x.watts for x in sorted(got)] == pytest.approx([x[2] for x in want])


def test_spectrum_of_any_length(spark):
    r = np.random.default_rng(9)
    sizes = {"prime": 10_007, "twice": 2 * 5_003, "square": 4_096, "short": 7, "one": 1}
    own = {k: r.normal(100, 10, n) + 20 * np.sin(np.arange(n) / 3) for k, n in sizes.items()}
    rows = [(k, float(i), float(x)) for k, v in own.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "server STRING, t DOUBLE, v DOUBLE")
    got = stats.spectrum(df, Series(("server",), "t", (), 1_000.0), "v").toPandas()
    for k, v in own.items():
        mine = got[got.server == k].sort_values("k")
        want = np.abs(np.fft.rfft(v - v.mean())) ** 2
        assert mine.k.tolist() == list(range(1, len(v) // 2 + 1))
        assert np.allclose(mine.power, want[1 : len(v) // 2 + 1], rtol=1e-6, atol=1e-6 * want.max())


@pytest.mark.parametrize("width", [60.0, 1e6])
def test_rolling_forecast_like_least_squares(spark, width):
    r = np.random.default_rng(10)
    n = 160
    p = 200 + np.cumsum(r.normal(0, 5, n))
    u = r.uniform(0, 90, n)
    t = np.cumsum(r.choice([1, 1, 2, 5], n))
    rows = [("a", T0 + timedelta(seconds=int(s)), float(x), float(y)) for s, x, y in zip(t, p, u)]
    df = spark.createDataFrame(rows, "server STRING, ts TIMESTAMP, power_watts DOUBLE, usage_percent DOUBLE")
    got = ml.rolling_forecast(df, Series(("server",), "ts", (), width), 90.0, 2, (0, 1), 10).orderBy("ts").toPandas()
    assert len(got) == n and got.pred.notna().sum() > 100
    for i in range(n):
        design, target = [], []
        for j in range(i + 1):
            if j >= 3 and t[j - 3] > t[i] - 90:
                design.append([1, p[j - 2], u[j - 2], p[j - 3], u[j - 3]])
                target.append(p[j])
        if len(target) < 10 or i < 1:
            assert np.isnan(got.pred[i])
            continue
        coef, *_ = np.linalg.lstsq(np.array(design), np.array(target), rcond=None)
        assert got.pred[i] == pytest.approx(coef @ [1, p[i], u[i], p[i - 1], u[i - 1]], rel=1e-6)
        assert got.rmse[i] == pytest.approx(np.sqrt(np.mean((np.array(target) - np.array(design) @ coef) ** 2)), rel=1e-5, abs=1e-6)
        inside = p[(t > t[i] - 90) & (t <= t[i])]
        assert got.threshold[i] == pytest.approx(inside.mean() + 2.5 * inside.std(ddof=1))


def test_ranks_of_a_hot_key_with_one_score(spark):
    n = 20_000
    df = spark.range(n).selectExpr("CASE WHEN id % 10 < 9 THEN 'a' ELSE 'b' END AS server", "CASE WHEN id % 10 < 9 THEN 1.0D ELSE id % 7 * 1.0D END AS score", "(id * 7919) % 20011 AS tie")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        got = descending_rank(df, ["server"], "score", [F.col("tie").desc()]).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in got.groupBy("part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 0.5 * n and sum(sizes) == n
    pdf = got.toPandas()
    for _, own in pdf.groupby("server"):
        own = own.sort_values(["score", "tie"], ascending=False)
        assert own["rank"].tolist() == list(range(1, len(own) + 1))


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_discords_like_all_pairs(spark, block):
    r = np.random.default_rng(11)
    m, rows = 8, []
    for s, n in (("a", 400), ("b", 60), ("c", 7)):
        y = np.sin(np.arange(n) / 3) * 10 + r.normal(0, 1, n)
        y[n // 2 : n // 2 + 5] += r.normal(0, 20, len(y[n // 2 : n // 2 + 5]))
        rows += [(s, float(i), float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "server STRING, t DOUBLE, v DOUBLE")
    got = events.discords(df, Series(("server",), "t", (), 50.0), "v", m, 3, block).collect()
    for s in "ab":
        y = np.array([x[2] for x in rows if x[0] == s])
        w = np.lib.stride_tricks.sliding_window_view(y, m)
        u = (w - w.mean(1, keepdims=True)) / (w.std(1, keepdims=True) * np.sqrt(m))
        d = np.sqrt(np.maximum(2 * m * (1 - u @ u.T), 0))
        k = np.arange(len(w))
        d[np.abs(k[:, None] - k[None, :]) <= 2] = np.inf
        best = d.min(1)
        want = sorted(range(len(w)), key=lambda i: (-best[i], i))[:3]
        mine = sorted((x for x in got if x.server == s), key=lambda x: x["rank"])
        assert [x.rn - 1 for x in mine] == want
        assert [x.distance for x in mine] == pytest.approx([best[i] for i in want], abs=1e-6)
    assert not [x for x in got if x.server == "c"]


#: Values of which two subsequences are each other's nearest neighbour and tie for a place.
MUTUAL = [
    71.66, 76.24, 65.46, 22.95, 56.89, 3.45, 43.32, 17.08, 76.38, 68.13, 6.87, 65.36, 97.02, 16.51, 20.7,
    60.16, 15.15, 54.49, 21.9, 36.63, 29.79, 42.94, 17.06, 24.41, 62.55, 9.61, 60.21, 23.05, 26.12, 77.48,
    21.39, 1.59, 91.76, 9.94, 0.96, 76.49, 52.46, 18.39, 12.11, 62.93, 88.53, 68.72, 80.44, 108.09, 59.0,
    4.02, 96.26, 31.83, 23.3, 1.08, 27.85, 28.18, 53.63, 71.68, 37.17, 8.0, 51.2, 41.15, 46.05, 8.59, 59.13,
    183.09,
]


def test_mutual_neighbours_tie_by_row(spark):
    df = spark.createDataFrame([("a", float(i), v / 0.997) for i, v in enumerate(MUTUAL)], "server STRING, t DOUBLE, v DOUBLE")
    got = events.discords(df, Series(("server",), "t", (), 50.0), "v", 8, 3, 32).collect()
    third = next(x for x in got if x["rank"] == 3)
    assert third.rn == 5 and round(third.distance, 4) == 2.3886


def test_short_series_are_transformed_whole(spark, monkeypatch):
    from wattframe.operators import stats

    def refuse(*_):
        raise AssertionError("a short series needs no second pass")

    monkeypatch.setattr(stats, "_two_pass", refuse)
    r = np.random.default_rng(5)
    values = {s: r.normal(0, 1, n) for s, n in (("a", 67), ("b", 64), ("c", 67), ("d", 1))}
    rows = [(s, float(i), float(v)) for s, y in values.items() for i, v in enumerate(y)]
    got = stats.spectrum(spark.createDataFrame(rows, "server STRING, t DOUBLE, v DOUBLE"), Series(("server",), "t", (), 10.0), "v").collect()
    for s, y in values.items():
        want = np.abs(np.fft.fft(y - y.mean())) ** 2
        mine = {x.k: x.power for x in got if x.server == s}
        assert sorted(mine) == list(range(1, len(y) // 2 + 1)) and all(p == pytest.approx(want[k]) for k, p in mine.items())


def test_filters_run_in_pieces_and_together(monkeypatch):
    monkeypatch.setattr(features.AffineFilter, "PIECE", 7)
    z = np.random.default_rng(3).normal(50, 9, 80)
    settings, blocks = [(0.1, 5.0), (1.0, 25.0)], np.array([0, 3, 40, 60])
    f = features.AffineFilter(settings, 1.0)
    number = np.arange(80)
    states = f.follow(list(f.publish(z, number, blocks)), np.array([0]))
    out = f.run(states, z, number, blocks)
    for i, (q, r) in enumerate(settings):
        want, _ = features.kalman_rows(z, None, q, r, 1.0, False)
        assert out[:, i] == pytest.approx(want, abs=1e-8)
    assert f.run(states, z, number, blocks, only_next=True)[..., 0] == pytest.approx(out[..., 0])


def test_close_values_far_from_the_centre_keep_their_score(spark):
    rows = [("a", i, 1e6 + v) for i, v in enumerate((0.0, 1e-3))]
    df = spark.createDataFrame(rows, "server STRING, rn LONG, v DOUBLE")
    axis, col, zero = Series(("server",), "rn", (), 100.0), features.F.col("v"), features.F.lit(0.0)
    sums = features.decayed_sums(df, axis, at=features.F.col("rn"), **features.ewma_sums(col, zero, 20, "p"))
    sums = features.decayed_sums(sums, axis, at=features.F.col("rn"), **features.ewma_spread(col, zero, 20, "p"))
    got = features.ewma_columns(sums, "v", zero, "p").filter("rn = 1").first()
    assert got.p_z == pytest.approx(0.67175144, abs=1e-5)


def test_labels_of_several_horizons_in_one_pass(spark, series_of):
    r = np.random.default_rng(2)
    df = series_of(power_watts=(r.random(60) * 300).tolist(), usage_percent=(r.random(60) * 100).tolist())
    axis = Series(("server",), "ts", (), 20.0)
    both, names = features.build_xy(df, axis, horizon=(1, 5), also={"label_rise": ("rise", 60.0, 2.0)})
    got = {x.ts: x for x in both.collect()}
    for column, more in (("label_1", {"horizon": 1}), ("label_5", {}), ("label_rise", {"direction": "rise", "watts": 60.0, "k": 2.0})):
        one, cols = features.build_xy(df, axis, **more)
        assert cols == names and {x.ts: x.label for x in one.collect()} == {t: x[column] for t, x in got.items()}
