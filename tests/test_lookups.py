"""Ties of largest values, nearest entries and rule boards on small written tables."""

import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe import Series, catalog
from wattframe.operators import events, features, match, score


@pytest.fixture
def written(spark, tmp_path):
    """Folder of an events table of (user, type, value) rows in the given order, and a query with its SQL over it."""

    def make(rows, files=1):
        catalog.load()
        full = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), u, t, v, '{"k": 5}') for i, (u, t, v) in enumerate(rows)]
        df = spark.createDataFrame(full, "event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE, props STRING")
        df.coalesce(files).write.parquet(f"{tmp_path}/events.parquet")

        def both(name):
            con = duckdb.connect(config={"threads": 1})
            con.execute("SET TimeZone='UTC'")
            con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet' ORDER BY event_id")
            got = catalog.QUERIES[name](spark, str(tmp_path))
            want = con.execute(catalog.ORACLES[name]).fetchall()
            return {tuple(r) for r in got.collect()}, set(want)

        return both

    return make


def test_label_of_tied_largest_values_is_the_first(written):
    rows = [(u, t, 50.0) for t in ("click", "view", "error") for u in range(8)] + [(9, None, 90.0), (9, "view", 10.0), (10, "click", None)]
    both = written(rows)
    for name in ("g46_confusion_table", "g46_recovery"):
        got, want = both(name)
        assert got == want
    assert ("click", 2) in {r[1:3] for r in both("g46_confusion_table")[0]}


def test_row_of_the_largest_value_with_ties_and_nulls(written):
    rows = [(u, "view", v) for v in (50.0, None, 50.0, 20.0) for u in range(4)] + [(9, "view", None), (9, "view", None)]
    got, want = written(rows)("o3_argmax_by_server")
    assert got == want
    assert (0, 0, round(50 / 0.997, 6)) in got and (9, None, None) in got


def test_rule_grid_like_a_loop_in_one_pass(spark):
    r = random.Random(3)
    rows = [(s, i, r.choice([None, 0.0, 1.0, 2.0])) for s in "ab" for i in range(1, 200)]
    on = [(s, i) for s, i, _ in rows if r.random() < 0.1]
    scored, onsets = spark.createDataFrame(rows, "server STRING, rn INT, v DOUBLE"), spark.createDataFrame(on, "server STRING, rn INT")
    level = {"over 0": 0.5, "over 1": 1.5, "never": 9.0}
    got = score.rule_grid(scored, onsets, Series(("server",), "rn", (), 7.0), {n: F.col("v") > x for n, x in level.items()}, 3, 4, 2)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 4
    got = {x.rule: x for x in got.collect()}
    for name, x in level.items():
        flags = {(s, i) for s, i, v in rows if v is not None and v > x}
        lags = [next((k for k in range(4) if (s, i + k) in flags), None) for s, i in on]
        known = [k for k in lags if k is not None]
        eps = [(s, i) for s, i in flags if not any((s, i - k) in flags for k in range(1, 5))]
        false = sum(all((s, i + k) not in on for k in range(-2, 3)) for s, i in eps)
        y = got[name]
        assert (y.n_onsets, y.detected, y.median_lat, y.p90_lat) == (len(on), len(known), *([float(np.quantile(known, q)) for q in (0.5, 0.9)] if known else [None, None]))
        assert (y.n_episodes, y.false_ep) == ((len(eps), false) if eps else (None, None))
    assert score.rule_grid(scored, onsets.limit(0), Series(("server",), "rn", (), 7.0), {"over 0": F.col("v") > 0.5}, 3, 4, 2).count() == 0


def test_landings_follow_onsets(spark):
    r = random.Random(4)
    rows = [(s, i, r.uniform(0, 100)) for s in "ab" for i in range(300)]
    df = spark.createDataFrame(rows, "server STRING, at LONG, v DOUBLE")
    axis = Series(("server",), "at", (), 50.0)
    stepped = features.with_spikes(df, axis, "v", row_number="rn")
    want = {(x.server, x.rn + 1) for x in events.hf_onsets(df, axis, "v", 40.0, 5).collect()}
    assert {tuple(x) for x in events.landings(stepped, axis, "d1", 40.0, 5).collect()} == want


@pytest.mark.parametrize("few", [500_000, 0])
def test_nearest_value_looks_up_each_value_once(spark, monkeypatch, few):
    monkeypatch.setattr(match, "FEW", few, raising=False)
    r = random.Random(5)
    values = [None, -3.0, 500.0, *[float(r.randrange(40)) for _ in range(3000)]]
    entries = [1.0, 4.0, 10.0, 11.0, 30.0]
    df = spark.createDataFrame(list(enumerate(values)), "id LONG, v DOUBLE")
    table = spark.createDataFrame([(x, 2 * x) for x in entries], "w DOUBLE, y DOUBLE")
    looked = []
    asof = match.asof
    monkeypatch.setattr(match, "asof", lambda left, *a, **k: looked.append(left.count()) or asof(left, *a, **k))
    got = {x.id: x.near for x in match.nearest_value(df, table, "v", "w", "y", "near", 7.0).collect()}
    assert len(got) == len(values) and max(looked) == len(set(values)) - 1
    assert all(got[i] == (None if v is None else 2 * min(entries, key=lambda x: (abs(x - v), x))) for i, v in enumerate(values))
