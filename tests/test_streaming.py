"""Streaming queries give what the batch operators give."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import T0
from wattframe import Series
from wattframe.operators import counters, events, features
from wattframe.plans.folds import fold
from wattframe.streaming import queries as q
from wattframe.streaming import steps

S = Series(("server",), "ts", (), 3600.0)


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    path = str(tmp_path_factory.mktemp("points"))
    rows = [
        (s, T0 + timedelta(seconds=i), float(rng.normal(200, 40)), float(rng.uniform(0, 60)), float(rng.integers(0, 9)))
        for s in ("a", "b") for i in range(60)
    ]
    df = spark.createDataFrame(rows, "server STRING, ts TIMESTAMP, power DOUBLE, usage DOUBLE, nr DOUBLE")
    # three files in time order become three micro-batches
    for lo in (0, 20, 40):
        cut = [T0 + timedelta(seconds=lo), T0 + timedelta(seconds=lo + 20)]
        df.filter((F.col("ts") >= F.lit(cut[0])) & (F.col("ts") < F.lit(cut[1]))).coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path)


def drain(spark, df, name, tmp_path):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    return spark.table(name).toPandas()


def source(spark, points):
    return spark.readStream.schema(points[1].schema).option("maxFilesPerTrigger", 1).parquet(points[0])


def test_stateful_step_equals_batch(spark, points, tmp_path):
    step = steps.live_features(["server"], "ts", "power", "nr")
    ddl = "server STRING, ts TIMESTAMP, hawkes DOUBLE, ewma_mean DOUBLE, ewma_z DOUBLE, kf_level DOUBLE, kf_slope DOUBLE"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = drain(spark, q.stateful(source(spark, points), ["server"], "ts", step, ddl, "1 minute"), "live", tmp_path)
    got = got.sort_values(["server", "ts"]).reset_index(drop=True)
    df = points[1]
    h = features.with_hawkes(df, S, "nr", "h")
    e = features.with_ewma(h, S, "power").orderBy("server", "ts").toPandas()
    k = features.kalman(df, S, "power", adapt=True).orderBy("server", "ts").toPandas()
    assert len(got) == 120
    assert np.allclose(got.hawkes, e.h) and np.allclose(got.kf_level, k.level)
    assert np.allclose(got.ewma_z.astype(float), e.ewma_z.astype(float), equal_nan=True)


def test_pulse_step_equals_batch(points):
    df = points[1]
    step = steps.edge_pulse(["server"], "ts", "usage", 30.0, 25.0, 2.0, 6.0)
    schema = df.select("server", "ts", F.lit(True).alias("fired"), F.lit(1).alias("risk"), F.lit(1).alias("direction")).schema
    a = fold(df, S, step, schema, slice_width=25.0).orderBy("server", "ts").toPandas()
    edged = events.usage_edges(df, S, "usage", 30.0, 25.0)
    b = events.pulses(edged, S, 2.0, 6.0).orderBy("server", "ts").toPandas()
    for c in ("fired", "risk", "direction"):
        assert a[c].astype(int).tolist() == b[c].astype(int).tolist()


def test_windows_sessions_and_duplicates(spark, points, tmp_path):
    src = source(spark, points)
    means = drain(spark, q.tumbling_mean(src, ["server"], value="power", step="10 seconds", watermark="0 seconds"), "means", tmp_path)
    assert len(means) >= 8
    alerts = source(spark, points).filter("usage > 40")
    eps = drain(spark, q.alert_episodes(alerts, ["server"], gap_s=2.0, watermark="0 seconds"), "eps", tmp_path)
    batch = events.episodes(points[1].filter("usage > 40"), S, 2.0).toPandas()
    closed = batch.merge(eps, on=["server", "start_ts", "end_ts", "n_points"])
    assert len(closed) == len(eps) > 0
    uniq = drain(spark, q.unique_points(source(spark, points).union(source(spark, points)), ["server"]), "uniq", tmp_path)
    assert len(uniq) == 120


def test_latest_risk_and_freshness(spark, points, tmp_path):
    path = str(tmp_path / "latest")
    write = q.publish_latest(path)
    df = points[1].withColumn("risk", (F.col("usage") > 30).cast("int"))
    write(df.filter("second(ts) < 30"), 0)
    write(df.filter("second(ts) >= 30"), 1)
    latest = q.read_latest(spark, path)
    assert latest.filter(F.col("updated_ts") == F.lit(T0 + timedelta(seconds=59))).count() == 2
    old = q.fresh_risk(latest, 5.0, F.lit(T0 + timedelta(seconds=120)))
    assert old.filter("risk <> 0").count() == 0


def batches(spark, tmp_path, name, frames):
    """A streaming source that gives each list of rows as one micro-batch."""
    path = str(tmp_path / name)
    for rows, ddl in frames:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def at(s):
    return T0 + timedelta(seconds=s)


def test_a_pulse_ends_on_a_silent_series(spark, tmp_path):
    ddl = "server STRING, ts TIMESTAMP, usage DOUBLE"
    first = [("b", at(0), 2.0), ("b", at(1), 60.0), ("a", at(0), 5.0), ("a", at(1), 80.0), ("a", at(1.5), 80.0)]
    frames = [(first, ddl)] + [([("a", at(20 * k), 80.0)], ddl) for k in (1, 2, 3)] + [([("b", at(61), 60.0), ("a", at(80), 80.0)], ddl)]
    out = "server STRING, ts TIMESTAMP, fired BOOLEAN, risk INT, direction INT"
    src = batches(spark, tmp_path, "pulses", frames)
    got = drain(spark, q.edge_pulses(src, ["server"], "ts", "usage", out, pulse_s=1.0, cooldown_s=5.0, watermark="2 seconds"), "pulses_out", tmp_path)
    own = {s: [(r.ts.to_pydatetime(), r.fired, r.risk, r.direction) for r in g.sort_values("ts").itertuples()] for s, g in got.groupby("server")}
    assert own["b"] == [(at(0), False, 0, 0), (at(1), True, 1, 1), (at(2), False, 0, 0), (at(61), False, 0, 0)]
    # The row of a at 20 s is there before the watermark passes the pulse's end, and tells the end itself.
    assert own["a"][:3] == [(at(0), False, 0, 0), (at(1), True, 1, 1), (at(1.5), False, 1, 1)]
    assert [(x[0], x[2]) for x in own["a"][3:]] == [(at(20 * k), 0) for k in (1, 2, 3, 4)]


def test_rank_alarms_keep_a_bounded_window(spark, tmp_path):
    rng = np.random.default_rng(1)
    n, ddl = 20_000, "server STRING, ts TIMESTAMP, score DOUBLE"
    y = rng.normal(0, 1, n)
    cuts = [0, 700, 1_500, 9_000, 9_001, 20_000]
    frames = [([("a", at(i * 0.1), float(y[i])) for i in range(a, b)], ddl) for a, b in zip(cuts, cuts[1:])]
    src = batches(spark, tmp_path, "ranks", frames)
    options = dict(q=0.9, floor=0.5, warm=600, refresh_s=1.0, refractory_s=5.0)
    out = "server STRING, ts TIMESTAMP, threshold DOUBLE, flag BOOLEAN"
    got = drain(spark, q.rank_alarms(src, ["server"], "ts", "score", out, 3_000, watermark="1 hour", **options), "ranks_out", tmp_path)
    got = got.sort_values("ts").reset_index(drop=True)
    thr, fresh, last = 0.5, -np.inf, -np.inf
    want, flags = [], []
    for i in range(n):
        t = round(i * 0.1, 6)
        if t - fresh >= 1.0 - 1e-9:
            past = y[max(i - 3_000, 0) : i]
            thr, fresh = (max(0.5, float(np.quantile(past, 0.9))) if len(past) >= 600 else 0.5), t
        hit = y[i] > thr and t - last >= 5.0 - 1e-9
        last = t if hit else last
        want.append(thr)
        flags.append(hit)
    assert len(got) == n
    assert np.mean(np.isclose(got.threshold, want)) > 0.99
    assert abs(int(got.flag.sum()) - sum(flags)) <= 3


def test_counter_lookback_and_threshold_steps_equal_batch(spark, points, tmp_path):
    df = points[1].withColumn("uj", F.floor("power").cast("double")).withColumn("score", F.col("usage") / 100)
    src = source(spark, points).withColumn("uj", F.floor("power").cast("double")).withColumn("score", F.col("usage") / 100)
    # T4: C4 with a wrapping counter
    step = steps.counter_watts(["server"], "ts", "uj", 400.0, 3.0)
    got = drain(spark, q.stateful(src, ["server"], "ts", step, "server STRING, ts TIMESTAMP, watts DOUBLE", "1 minute"), "watts", tmp_path)
    want = counters.windowed_power(df.withColumn("top", F.lit(400.0)), S, "uj", "top", 3.0).toPandas()
    both = got.merge(want, on=["server", "ts"], how="outer")
    assert len(both) == len(want) > 5 and np.allclose(both.watts_x, both.watts_y)
    # The capped threshold
    step = steps.capped_threshold(["server"], "ts", "score", 0.3, window_s=30.0, refresh_s=4.0, min_samples=6)
    got = drain(spark, q.stateful(src, ["server"], "ts", step, "server STRING, ts TIMESTAMP, threshold DOUBLE", "1 minute"), "capped", tmp_path)
    want = features.capped_threshold(df, S, "score", 0.3, 30.0, 4.0, 6, slice_width=25.0).toPandas()
    both = got.merge(want, on=["server", "ts"])
    assert len(both) == 120 and np.allclose(both.threshold_x, both.threshold_y) and both.threshold_x.nunique() > 3
    # lags
    step = steps.lookback_features(["server"], "ts", "power", "usage")
    out = "server STRING, ts TIMESTAMP, " + ", ".join(f"power_lag{k} DOUBLE, usage_lag{k} DOUBLE" for k in range(4))
    got = drain(spark, q.stateful(src, ["server"], "ts", step, out, "1 minute"), "lags", tmp_path).sort_values(["server", "ts"])
    want = df.orderBy("server", "ts").toPandas().groupby("server")
    for k in range(4):
        assert np.allclose(got[f"power_lag{k}"], want.power.shift(k), equal_nan=True)
        assert np.allclose(got[f"usage_lag{k}"], want.usage.shift(k), equal_nan=True)


def test_level_gates_have_two_flags_and_a_slope(spark, tmp_path):
    ddl = "server STRING, ts TIMESTAMP, power DOUBLE, rise DOUBLE, fall DOUBLE"
    flat = [("a", at(i), 50.0, 1.0, 1.0) for i in range(40)]
    ramp = [("a", at(40 + 0.125 * i), 50.0 + 4.0 * i, 1.0, 0.0) for i in range(10)]
    busy = [("a", at(42 + i), 250.0, 1.0, float(i % 2)) for i in range(4)]
    src = batches(spark, tmp_path, "gates", [(flat[:35], ddl), (flat[35:] + ramp[:5], ddl), (ramp[5:] + busy, ddl)])
    step = steps.level_gates(["server"], "ts", "power", "rise", "fall", 300.0)
    out = "server STRING, ts TIMESTAMP, rise_armed BOOLEAN, drop_armed BOOLEAN, preaction BOOLEAN"
    got = drain(spark, q.stateful(src, ["server"], "ts", step, out, "1 minute"), "gates_out", tmp_path).sort_values("ts").reset_index(drop=True)
    assert got.rise_armed.tolist() == [True] * 50 + [False] * 4
    assert got.drop_armed.tolist() == [False] * 50 + [False, True, False, True]
    # Suppressed after 30 s of flat idling; steps of 4 W never count, but 32 W/s does once the slope covers 0.3 s.
    assert got.preaction.tolist()[:40] == [True] * 30 + [False] * 10
    assert got.preaction.tolist()[40:50] == [False] * 3 + [True] * 7
    assert not any(got.preaction.tolist()[50:])


def test_latest_risk_is_compacted(spark, tmp_path):
    path = str(tmp_path / "compact")
    write = q.publish_latest(path, compact_every=3)
    ddl = "server STRING, ts TIMESTAMP, risk INT"
    for epoch in range(7):
        write(spark.createDataFrame([("a", at(epoch), epoch), (f"s{epoch}", at(epoch), 1)], ddl), epoch)
    folders = sorted(p.name for p in (tmp_path / "compact").iterdir() if p.is_dir())
    assert folders == ["batch=5.all", "batch=6"]
    got = {r.server: r.risk for r in q.read_latest(spark, path).collect()}
    assert got == {"a": 6, **{f"s{k}": 1 for k in range(7)}}


def test_predictions_are_stored_and_published(spark, tmp_path):
    """A scored batch, written again on replay, is there once."""
    store, latest = str(tmp_path / "pred"), str(tmp_path / "flag")
    score = q.score_batches(lambda b: b.withColumn("spike_risk", (F.col("proba") > 0.5).cast("int")).withColumn("model", F.lit("rf")), store, latest)
    df = spark.createDataFrame([("a", at(1), 0.9), ("b", at(1), 0.2), ("a", at(2), 0.1)], "server STRING, ts TIMESTAMP, proba DOUBLE")
    score(df, 0)
    score(df, 0)
    stored = spark.read.parquet(store)
    assert stored.count() == 3 and dict(stored.dtypes)["spike_risk"] == "int" and {r.model for r in stored.collect()} == {"rf"}
    assert {(r.server, r.risk) for r in q.read_latest(spark, latest).collect()} == {("a", 0), ("b", 0)}
