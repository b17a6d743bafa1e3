"""Models learn from all rows of their training range."""

import random
from datetime import datetime, timedelta
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe import Series
from wattframe.operators import match, ml, score
from wattframe.plans.quantiles import quantile_values

S = Series(("server",), "ts", ("event_id",), 3600.0)
TREE = ml.Learner("rf", trees=2, depth=2, min_leaf=1)


def labelled(spark, n, every):
    rows = [("a", datetime(2024, 1, 1) + timedelta(seconds=60 * i), i, float(i % 7), int(i % every == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "server STRING, ts TIMESTAMP, event_id LONG, x DOUBLE, label INT")


def test_direction_heads_learn_from_all_rows(spark):
    few = labelled(spark, 600, 30)  # 20 positives, 29 negatives to each
    got = ml.attach_direction_heads(ml.Detector(None, ["x"], 0.5), {"rise": few, "drop": few.filter("label = 0")}, S, TREE).heads
    assert (got["rise"]["positives"], got["rise"]["rows"]) == (20, 600)
    assert got["drop"] == {"status": "skipped: pos=0 neg=580 min=10"}


def test_detectors_are_scored_together_like_alone(spark):
    """Counts of one pass over stacked alerts equal those of the per-series score, with ties, gaps and empty detectors."""
    r = random.Random(7)
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    spans = spark.createDataFrame([(s, at(0), at(40_000)) for s in "abc"], "server STRING, start_ts TIMESTAMP, end_ts TIMESTAMP")
    events = [(s, at(r.randrange(-300, 40_300))) for s in "abcd" for _ in range(40)]
    alerts = {m: [(s, at(r.randrange(0, 40_000, 20)), bool(r.randrange(2))) for s in "ab" for _ in range(k)] for m, k in (("few", 30), ("many", 400))}
    ev = spark.createDataFrame(events, "server STRING, ts TIMESTAMP")
    for lead, lag, gap in ((60, 60, 30), (5, 10, 200), (200, 0, 20)):
        flags = [(m, *row) for m, rows in alerts.items() for row in rows]
        flags = spark.createDataFrame(flags, "model STRING, server STRING, ts TIMESTAMP, good BOOLEAN")
        stacked = reduce(DataFrame.unionByName, [ev.withColumn("model", F.lit(m)) for m in ("few", "many", "none")])
        got = score.pooled_event_scores(stacked, flags, S, spans, "model", lead, lag, gap, "good")
        for name in ("few", "many", "none"):
            mine = flags.filter(F.col("model") == name)
            want = score.event_score(ev, mine, S, lead, lag, gap, spans).toPandas()
            for c in ("n_events", "n_events_detected", "n_alert_episodes", "n_false_alert_episodes"):
                assert got[name][c] == want[c].sum(), (name, c, lead, lag, gap)
            assert abs(got[name]["event_eval_hours"] - want["event_eval_hours"].sum()) < 1e-9
            first = match.first_alert(ev.join(spans, "server").filter("ts BETWEEN start_ts AND end_ts"), mine, S, lead, lag)
            soon = match.next_event(mine.filter("good").select("server", "ts"), ev, S, lead)
            for c, rows, value in (("event_latency_median_s", first, "latency_s"), ("lead_time_median_s", soon, "lead_s")):
                alone = rows.agg(F.percentile(value, 0.5)).first()[0]
                assert got[name][c] == alone or abs(got[name][c] - alone) < 1e-9, (name, c, lead, lag, gap)


def test_more_detectors_take_no_more_jobs(spark):
    """Column sets are fitted from one table, and a generation's detectors are scored by the jobs of one."""
    xy = labelled(spark, 600, 4).withColumn("z", F.col("x") % 3)
    one, two = ml.train_detectors(xy, S, [["x"], ["x", "z"]], TREE, events=xy.filter("label = 1").select("server", "ts"))
    assert (one.features, two.features) == (["x"], ["x", "z"])
    events = xy.filter("label = 1").select("server", "ts")

    def jobs(name, detectors):
        spark.sparkContext.setJobGroup(name, name)
        try:
            return ml.score_folds(detectors, xy, S, events, 60.0, 120.0), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    alone, few = jobs("one detector", {"a": one})
    both, more = jobs("three detectors", {"a": one, "b": two, "c": None, "d": one})
    assert both["a"] == both["d"] == alone["a"] and both["c"] is None
    assert few > 0 and more <= few + 2


def test_a_hundred_quantiles_in_one_plan(spark):
    rows = spark.range(20_001).select(((F.col("id") * 7919) % 20_001 / 8).alias("v"))
    assert quantile_values(rows, "v", [i / 100 for i in range(101)]) == pytest.approx([i * 25.0 for i in range(101)])
    assert quantile_values(rows.filter("v < 0"), "v", [0.5]) == []
