"""Queries over model jobs.  Fitted models have no SQL twin, so most of these
are checked by tests; counting and error tables are checked by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe import bindings as b
from wattframe.catalog import query
from wattframe.catalog.events import schedule
from wattframe.catalog.features import RN_SQL, SPIKE_SQL, KALMAN_SQL
from wattframe.operators import events as e
from wattframe.operators import features as ft
from wattframe.operators import ml
from wattframe.plans.folds import checkpoint

FOREST = ml.Learner("rf", trees=5, depth=4, min_leaf=20)
LOGREG = ml.Learner("logreg")
AXIS = b.SAMPLES
DAY = b.DAY
BLOCK = 3 * DAY


def xy(spark, d, horizon=5, upstream=True):
    rows, names = ft.build_xy(b.samples(spark, d), AXIS, horizon=horizon, upstream=upstream)
    return checkpoint(rows), names


def folds(rows):
    return ml.expanding_folds(rows, "ts", 8 * DAY, 4 * DAY, DAY / 4)


def onsets(spark, d, way="rise"):
    return checkpoint(e.true_transitions(b.samples(spark, d), AXIS, "power_watts", way, 60.0))


def table(spark, rows: list[dict], ddl: str):
    names = [c.strip().split()[0] for c in ddl.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


LABEL_ROWS = f"""{SPIKE_SQL}, lab AS (SELECT *, coalesce(max(spike_both) OVER (PARTITION BY server ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS label FROM spikes),
  x AS (SELECT server, label, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY server) AS x FROM lab),
  tr AS (SELECT server, label, unnest(generate_series(greatest(CAST(floor((x - 864000000000) / 172800000000) AS BIGINT) + 1, 0), CAST(floor(x / 172800000000) AS BIGINT))) AS fold FROM x),
  te AS (SELECT server, label, CAST(floor((x - 864000000000) / 172800000000) AS BIGINT) AS fold FROM x WHERE x >= 864000000000),
  c AS (SELECT server, fold, sum(t) AS n_train, sum(h) AS n_test, sum(t * label) AS train_pos, sum(h * label) AS test_pos FROM (SELECT server, fold, label, 1 AS t, 0 AS h FROM tr UNION ALL SELECT server, fold, label, 0, 1 FROM te) GROUP BY 1, 2),
  fc AS (SELECT * FROM c WHERE n_train >= 5 AND n_test > 0)"""


def counts(spark, d):
    lab = ft.with_label(b.samples(spark, d), AXIS)
    return ml.fold_counts(lab, AXIS, 10 * DAY, 2 * DAY, min_train=5, label="label")


@query("m1_walk_forward_folds", "server, fold, n_train, n_test, train_pos, test_pos", f"WITH {LABEL_ROWS} SELECT * FROM fc")
def m1(spark, d):
    return counts(spark, d)


@query("m2_expanding_scores", "server, event_id, label, fold, score")
def m2(spark, d):
    rows, names = xy(spark, d)
    return ml.walk_forward(rows, AXIS, names, folds(rows), FOREST)


@query("m4_logistic_scores", "server, event_id, label, fold, score")
def m4(spark, d):
    rows, names = xy(spark, d, upstream=False)
    return ml.walk_forward(rows, AXIS, names, folds(rows), LOGREG)


@query("m6_walk_forward_metrics", "pr_auc, precision, recall, n_rows, n_spikes, n_flags, n_tp, lead_time_median_s, lead_true_median_s")
def m6(spark, d):
    rows, names = xy(spark, d)
    scored = ml.walk_forward(rows, AXIS, names, folds(rows), FOREST)
    spikes = ft.with_spikes(b.samples(spark, d), AXIS, directions=("both",)).filter("spike_both = 1")
    out = ml.evaluate_scores(scored, AXIS, spikes.select("server", "ts", "event_id"), onsets(spark, d), DAY)
    ddl = "pr_auc DOUBLE, precision DOUBLE, recall DOUBLE, n_rows LONG, n_spikes LONG, n_flags LONG, n_tp LONG, lead_time_median_s DOUBLE, lead_true_median_s DOUBLE"
    return table(spark, [out], ddl)


@query("m7_rolling_forecast", "server, event_id, ~4pred, ~4rmse, ~4threshold, flag")
def m7(spark, d):
    return ml.rolling_forecast(b.samples(spark, d), AXIS, 15 * DAY, 1, (0, 1), 12)


@query("m9_event_threshold", "base_threshold, threshold, n_events, base_event_recall, event_recall, reason")
def m9(spark, d):
    rows, names = xy(spark, d)
    held = ml.cross_fitted(rows, AXIS, names, FOREST, block_s=BLOCK).persist()
    base = ml.calibrate_threshold(held)
    _, meta = ml.tune_threshold(held, onsets(spark, d), AXIS, base, DAY, DAY)
    ddl = "base_threshold DOUBLE, threshold DOUBLE, n_events LONG, base_event_recall DOUBLE, event_recall DOUBLE, reason STRING"
    return table(spark, [meta], ddl)


@query("m13_generations", "generation, train_rows, train_spikes, feature_set, pr_auc, event_recall, alert_duty, promoted")
def m13(spark, d):
    rows, names = xy(spark, d)
    up = [n for n in names if n.startswith(("nr_running", "freq", "procs")) or n == "temp_celsius_d3"]
    base = [n for n in names if n not in up]
    windows = ml.sliding_folds(rows, "ts", 8 * DAY, 4 * DAY, DAY / 4)
    _, log = ml.walk_generations(
        rows, AXIS, base, up, onsets(spark, d), windows, FOREST, block_s=BLOCK, horizon_s=DAY, gap_s=DAY
    )
    ddl = "generation INT, train_rows LONG, train_spikes LONG, feature_set STRING, pr_auc DOUBLE, event_recall DOUBLE, alert_duty DOUBLE, promoted BOOLEAN"
    return table(spark, log, ddl)


@query(
    "m14_gate_windows", "server, fold, n_train, train_pos, test_pos, next_pos",
    f"""WITH {LABEL_ROWS}, p AS (SELECT a.*, n.test_pos AS next_pos FROM fc a JOIN fc n ON n.server = a.server AND n.fold = a.fold + 1 WHERE a.n_train >= 8 AND a.train_pos >= 1 AND a.test_pos + n.test_pos >= 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY server ORDER BY fold DESC) AS k FROM p) SELECT * FROM r WHERE k = 1""",
)
def m14(spark, d):
    return ml.viable_gate(counts(spark, d), ["server"], 8, 1, 1)


def with_heads(spark, d, cut):
    """Features, and a detector with rise and drop heads trained before ``cut``."""
    ways = {f"label_{way}": (way, 60.0, 2.0) for way in ("rise", "drop")}
    rows, names = ft.build_xy(b.samples(spark, d), AXIS, upstream=True, also=ways)
    rows = checkpoint(rows)
    past = rows.filter(F.col("ts") < cut)
    det = ml.train_detector(past, AXIS, names, FOREST, block_s=BLOCK)
    heads = {way: past.withColumn("label", F.col(name)) for name, (way, _, _) in ways.items()}
    return rows, ml.attach_direction_heads(det, heads, AXIS, FOREST, block_s=BLOCK)


@query("m18_model_report", "target, threshold, n_events, n_events_detected, event_recall, event_latency_median_s, n_alert_episodes, alert_event_precision, alert_duty")
def m18(spark, d):
    cut = F.lit("2024-01-20").cast("timestamp")
    rows, det = with_heads(spark, d, cut)
    ways = {w: onsets(spark, d, w) for w in ("rise", "drop")}
    out = ml.evaluate_model(det, rows.filter(F.col("ts") >= cut), AXIS, ways, DAY, DAY)
    ddl = "target STRING, threshold DOUBLE, n_events LONG, n_events_detected LONG, event_recall DOUBLE, event_latency_median_s DOUBLE, n_alert_episodes LONG, alert_event_precision DOUBLE, alert_duty DOUBLE"
    return table(spark, out, ddl)


@query("m19_inference", "server, event_id, spike_proba, model_threshold, decision_threshold, spike_risk, rise_now, drop_now, rise_risk, drop_risk")
def m19(spark, d):
    """As it runs live: the threshold follows the scores, and both heads decide."""
    cut = F.lit("2024-01-20").cast("timestamp")
    rows, det = with_heads(spark, d, cut)
    live = checkpoint(rows.filter(F.col("ts") >= cut))
    scored = ml.predict(det.model, live.na.drop(subset=det.features), "p").select("server", "ts", "event_id", "p")
    slow = ft.capped_threshold(scored, AXIS, "p", det.threshold, 4 * DAY, DAY / 2, 10, slice_width=6 * DAY, name="slow")
    return ml.infer(det, live.join(slow, ["server", "ts", "event_id"], "left"), F.col("slow"), version="v1")


@query("m20_horizon_curve", "horizon, rate, pr_auc, lift, trivial_pr_auc, trivial_lift")
def m20(spark, d):
    trivial = ft.trivial_score(b.samples(spark, d), AXIS).select("server", "ts", "event_id", "trivial")
    horizons = [1, 2, 3, 5, 8, 12, 20]
    rows, names = xy(spark, d, horizons, upstream=False)  # the features are the same for all, only labels differ
    ends = folds(rows)
    out = ml.horizon_curve(
        lambda h: (rows.withColumn("label", F.col(f"label_{h}")), names), horizons, AXIS, lambda r, h: ends, FOREST, trivial
    )
    ddl = "horizon INT, rate DOUBLE, pr_auc DOUBLE, lift DOUBLE, trivial_pr_auc DOUBLE, trivial_lift DOUBLE"
    return table(spark, out, ddl)


@query(
    "m21_isolated_label", "server, event_id, isolated, iso_label",
    f"""WITH {SPIKE_SQL}, i AS (SELECT *, CASE WHEN spike_both = 1 AND coalesce(max(spike_both) OVER (PARTITION BY server ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS isolated FROM spikes)
    SELECT server, event_id, isolated, coalesce(max(isolated) OVER (PARTITION BY server ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS iso_label FROM i""",
)
def m21(spark, d):
    return ml.isolated_labels(ft.with_spikes(b.samples(spark, d), AXIS), AXIS, "spike_both", 5)


@query("m21_isolated_lift", "target, rate, pr_auc, lift, trivial_pr_auc, trivial_lift")
def m21b(spark, d):
    rows, names = xy(spark, d, upstream=False)
    trivial = ft.trivial_score(b.samples(spark, d), AXIS).select("server", "ts", "event_id", "trivial")
    events = ft.with_spikes(b.samples(spark, d), AXIS)
    out = ml.isolated_report(events, rows, names, AXIS, folds(rows), FOREST, trivial)
    return table(spark, out, "target STRING, rate DOUBLE, pr_auc DOUBLE, lift DOUBLE, trivial_pr_auc DOUBLE, trivial_lift DOUBLE")


@query("m22_upstream_walk_forward", "rate, pr_auc, lift, n_onsets, detected, frac_early, median_lead_s, n_flags")
def m22(spark, d):
    from wattframe.plans.timeline import by_rows

    src = b.samples(spark, d)
    lab = e.hf_label(src, AXIS, "power_watts", 10, 40.0, 5)
    feats = by_rows(lab, AXIS, lambda w: ft.hf_features(w, ["procs_running"]), before=30)
    names = ["nr_lag0", "nr_lag1", "nr_lag2", "nr_lag5", "nr_lag10", "nr_d10", "nr_d30", "procs_running", "procs_running_d30"]
    rows = checkpoint(feats.na.drop(subset=names))
    out = ml.upstream_walk_forward(
        rows, names, e.true_transitions(src, AXIS, "power_watts", "rise", 40.0, 5), AXIS, folds(rows), FOREST, DAY, 5
    )
    ddl = "rate DOUBLE, pr_auc DOUBLE, lift DOUBLE, n_onsets LONG, detected LONG, frac_early DOUBLE, median_lead_s DOUBLE, n_flags LONG"
    return table(spark, [out], ddl)


@query("m23_stress_score", "server, n_bursts, n_detected, ~frac_early, ~median_lead_s, quiet_rows, false_alarms, ~false_alarm_rate")
def m23(spark, d):
    scored = b.samples(spark, d).withColumn("score", F.col("usage_percent") / 100)
    return ml.stress_score(scored, schedule(spark, d), AXIS, 0.75, DAY / 8, DAY / 24)


@query("m24_feature_variants", "variant, rate, pr_auc, lift")
def m24(spark, d):
    rows, names = xy(spark, d, upstream=False)
    plain = [n for n in names if n != "temp_celsius_slope"]
    out = ml.compare_variants(rows, AXIS, {"base": plain, "thermal": names}, folds(rows), FOREST)
    return table(spark, out, "variant STRING, rate DOUBLE, pr_auc DOUBLE, lift DOUBLE")


@query("m25_kalman_grid", "server, q, r, ~rmse")
def m25(spark, d):
    grid = ml.kalman_grid(b.samples(spark, d), AXIS, "power_watts", slice_width=15 * DAY)
    return ml.best_setting(grid, ["server"])


@query(
    "m25_filter_board", "server, filter, ~rmse, ~mae",
    None,
)
def m25b(spark, d):
    return ml.filter_board(b.samples(spark, d), AXIS, "power_watts", slice_width=15 * DAY)


@query(
    "m25_fixed_filter_error", "server, ~rmse, ~mae",
    f"""WITH RECURSIVE {KALMAN_SQL}, p AS (SELECT server, rn, z, lag(lvl + slp) OVER (PARTITION BY server ORDER BY rn) AS pred FROM kf WHERE NOT seed)
    SELECT server, sqrt(avg((pred - z) ** 2)) AS rmse, avg(abs(pred - z)) AS mae FROM p WHERE pred IS NOT NULL GROUP BY 1""",
)
def m25c(spark, d):
    k = ft.kalman(b.samples(spark, d), AXIS, "power_watts")
    return ft.one_step_errors(k, AXIS, "power_watts", "pred_next").filter("rmse IS NOT NULL")
