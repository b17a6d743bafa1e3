"""Distributed plans against plain pandas on skewed, multi-bucket input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import T0
from wattframe import Series
from wattframe.operators.features import with_ewma
from wattframe.plans import decay, folds, quantiles
from wattframe.plans import timeline as tl

S = Series(("server",), "ts", ("id",), 50.0)


@pytest.fixture(scope="module")
def skewed(spark):
    """One series holds most rows, another only one."""
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for server, n in (("hot", 600), ("b", 40), ("one", 1)):
        at = np.cumsum(rng.integers(1, 4, n))
        for t in at:
            v = None if rng.random() < 0.2 else float(rng.normal(100, 20))
            rows.append((server, T0 + pd.Timedelta(seconds=int(t)), i, v))
            i += 1
    df = spark.createDataFrame(rows, "server STRING, ts TIMESTAMP, id LONG, v DOUBLE").persist()
    return df, df.toPandas().sort_values(["server", "ts", "id"]).reset_index(drop=True)


def back(df):
    return df.toPandas().sort_values(["server", "ts", "id"]).reset_index(drop=True)


def test_running_state_crosses_buckets(skewed):
    df, pdf = skewed
    g = pdf.groupby("server").v
    out = back(
        tl.Timeline(df, S).scan(
            rn=tl.running_count(), s=tl.running_sum(F.col("v")), m=tl.running_max(F.col("v")),
            f=tl.last_seen(F.col("v")), p=tl.previous(F.col("v")), pb=tl.last_before(F.col("v")),
        ).done()
    )
    assert (out.rn == pdf.groupby("server").cumcount() + 1).all()
    assert out.f.equals(g.ffill())
    assert out.p.equals(g.shift(1))
    assert out.pb.equals(g.ffill().groupby(pdf.server).shift(1))
    assert np.allclose(out.s.fillna(0), pdf.v.fillna(0).groupby(pdf.server).cumsum())


def test_row_windows_cross_blocks(skewed):
    df, pdf = skewed
    out = back(
        tl.by_rows(
            df, S, lambda w: {"a": F.sum("v").over(w.rowsBetween(-7, 0)), "n": F.lead("v", 3).over(w)},
            before=7, after=3, block_rows=16,
        )
    )
    g = pdf.groupby("server").v
    assert len(out) == len(pdf)
    assert out.n.equals(g.shift(-3))
    exp = g.rolling(8, min_periods=1).sum().reset_index(drop=True)
    assert np.allclose(out.a.fillna(0), exp.fillna(0))


def test_time_windows_cross_buckets(skewed):
    df, pdf = skewed
    reach = tl.reach(df, S, 20.0)
    out = back(tl.by_time(df, S, lambda w: {"c": F.count("*").over(w.rangeBetween(-reach, reach))}, before=20.0, after=20.0))
    for server, part in pdf.groupby("server"):
        t = part.ts.to_numpy().astype("datetime64[s]").astype(int)
        exp = [((t >= x - 20) & (t <= x + 20)).sum() for x in t]
        assert out[out.server == server].c.tolist() == exp


@pytest.mark.parametrize("gap,inclusive", [(5.0, False), (5.0, True), (70.0, False)])
def test_greedy_thinning_matches_loop(skewed, gap, inclusive):
    df, pdf = skewed
    kept = set(folds.refractory(df, S, gap, inclusive).toPandas().id)
    exp = set()
    for _, part in pdf.groupby("server"):
        last = None
        for t, i in zip(part.ts, part.id):
            d = None if last is None else (t - last).total_seconds()
            if d is None or d > gap or (inclusive and d == gap):
                exp.add(i)
                last = t
    assert kept == exp


def test_decay_scan_matches_loop(skewed):
    df, pdf = skewed
    out = back(decay.decayed_sums(df, S, d=decay.Decay(F.coalesce(F.col("v"), F.lit(0.0)), 6.0)))
    for server, part in pdf.groupby("server"):
        acc, prev, exp = 0.0, None, []
        for t, v in zip(part.ts, part.v.fillna(0)):
            acc = v if prev is None else acc * np.exp(-(t - prev).total_seconds() / 6.0) + v
            prev = t
            exp.append(acc)
        assert np.allclose(out[out.server == server].d, exp, rtol=1e-12)


def test_quantiles_are_exact_beyond_the_sketch(skewed):
    df, pdf = skewed
    for acc in (50, 10_000):
        got = quantiles.order_statistics(
            df, ["server"], "v", {"lo": (0.1, "linear"), "up": (0.75, "element")}, accuracy=acc
        ).toPandas().set_index("server")
        for server, part in pdf.dropna().groupby("server"):
            v = np.sort(part.v.to_numpy())
            assert got.lo[server] == pytest.approx(np.quantile(v, 0.1))
            assert got.up[server] == v[int(len(v) * 0.75)]


def test_ranks_with_a_huge_tie(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 400, 1.0).otherwise(F.col("id") / 1000.0).alias("s"))
    out = quantiles.descending_rank(df, [], "s", [F.col("id")], spread=F.floor(F.col("id") / 50)).toPandas()
    out = out.sort_values("rank")
    assert out["rank"].tolist() == list(range(1, 501))
    assert out.id.tolist()[:400] == list(range(400))


def test_fold_in_slices_equals_one_pass(skewed):
    from wattframe.operators.features import kalman

    df, _ = skewed
    a = back(kalman(df, S, "v", adapt=True))
    b = back(kalman(df, S, "v", adapt=True, slice_width=300.0))
    assert len(a) == len(b)
    assert np.allclose(a.level, b.level, rtol=1e-12)


def test_ewma_keeps_its_mean_over_a_gap(series_of):
    """A gap of many blocks: the mean stays, and new values outweigh old ones as in one array."""
    values = [100.0 + (i * 7) % 11 for i in range(300)] + [None] * 12_000 + [200.0 + i % 5 for i in range(50)]
    got = with_ewma(series_of(power=values), Series(("server",), "ts", (), 2_000.0), "power", 30).orderBy("ts").toPandas()
    exp = pd.Series(values, dtype=float).ewm(span=30, adjust=True)
    assert np.allclose(got["ewma_mean"], exp.mean(), rtol=1e-9, equal_nan=True)
    # Far into the gap and just after it pandas loses the deviation, by underflow.
    std, known = exp.std(), exp.std().notna().to_numpy()
    assert known[:5_000].sum() == 4_999 and known[-49:].all()
    known[5_000:12_300] = False
    assert np.allclose(got["ewma_std"][known], std[known], rtol=1e-6, atol=1e-9)


def test_package_ships_to_workers(spark):
    from wattframe.plans.session import ship

    ship(spark)
    assert any("wattframe.zip" in str(p) for p in spark.sparkContext._python_includes)
