"""Queries over detector scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe import bindings as b
from wattframe.catalog import query
from wattframe.catalog.events import (
    DAY_US, EDGE_SQL, EPISODE_SQL, REGION_SQL, RUN_SQL, edged, runs, schedule,
)
from wattframe.catalog.features import RN_SQL, S, SPIKE_SQL, W, onset_sql
from wattframe.operators import events as e
from wattframe.operators import features as f
from wattframe.operators import score as s
from wattframe.plans.tables import cut
from wattframe.plans.timeline import by_rows

ID = "server, event_id"

LABEL_SQL = f"""{SPIKE_SQL}, lab AS (SELECT *, coalesce(max(spike_both) OVER (PARTITION BY server ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS label, abs(d1) AS score FROM spikes)"""


def labelled(spark, d):
    out = f.with_label(b.samples(spark, d), b.SAMPLES)
    return out.withColumn("score", F.abs("d1"))


AP_SQL = """lv AS (SELECT {k} score, sum(label) AS tp, count(*) AS n FROM {src} WHERE score IS NOT NULL GROUP BY {g} score),
  cm AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM lv WINDOW w AS ({p} ORDER BY score DESC))"""


@query(
    "g28_pr_auc", "positives, rows, ~pr_auc",
    f"""WITH {LABEL_SQL}, {AP_SQL.format(k='', g='', p='', src='lab')} SELECT sum(tp * ctp / cn) / sum(tp) AS pr_auc, sum(tp) AS positives, sum(n) AS rows FROM cm""",
)
def g28(spark, d):
    return s.pr_auc(labelled(spark, d).filter("score IS NOT NULL"), [], "label", "score", 10.0)


@query(
    "g28_pr_auc_by_server", "server, positives, rows, ~pr_auc",
    f"""WITH {LABEL_SQL}, {AP_SQL.format(k='server,', g='server,', p='PARTITION BY server', src='lab')}
    SELECT server, sum(tp * ctp / cn) / nullif(sum(tp), 0) AS pr_auc, sum(tp) AS positives, sum(n) AS rows FROM cm GROUP BY 1""",
)
def g28b(spark, d):
    return s.pr_auc(labelled(spark, d).filter("score IS NOT NULL"), ["server"], "label", "score", 100.0)


@query(
    "g29_flag_score", "server, n_spikes, n_flags, n_tp, ~precision, ~recall",
    f"""WITH {LABEL_SQL}, x AS (SELECT server, count(*) FILTER (label > 0) AS n_spikes, count(*) FILTER (score > 60) AS n_flags, count(*) FILTER (label > 0 AND score > 60) AS n_tp
      FROM lab WHERE score IS NOT NULL GROUP BY 1) SELECT *, n_tp / nullif(n_flags, 0) AS precision, n_tp / nullif(n_spikes, 0) AS recall FROM x""",
)
def g29(spark, d):
    return s.flag_score(labelled(spark, d).withColumn("score", F.col("score") - 60), ["server"], "label", "score")


@query(
    "g30_equal_budget_flags", f"{ID}, flag",
    f"""WITH {LABEL_SQL}, r AS (SELECT {ID}, row_number() OVER (PARTITION BY server ORDER BY score DESC, ts) AS k, sum(label) OVER (PARTITION BY server) AS n FROM lab WHERE score IS NOT NULL)
    SELECT {ID}, k <= n AS flag FROM r""",
)
def g30(spark, d):
    return s.equal_budget(labelled(spark, d).filter("score IS NOT NULL"), ["server"], "label", "score", "ts")


def event_score_sql(lead_us: int, lag_us: int, bounded: bool = False, name: str = "es") -> str:
    """Event score of views truth, alerts and episodes; ``bounds`` when bounded."""
    hours = (
        "greatest((epoch_us(any_value(bd.end_ts)) - epoch_us(any_value(bd.start_ts))) / 3600e6, 1e-9)"
        if bounded
        else """CASE WHEN any_value(na) > 1 THEN greatest((epoch_us(any_value(a1)) - epoch_us(any_value(a0))) / 3600e6, 1e-9)
          WHEN any_value(n_events) > 1 THEN greatest((epoch_us(any_value(e1)) - epoch_us(any_value(e0))) / 3600e6, 1e-9) END"""
    )
    every = "bounds" if bounded else "(SELECT server FROM truth UNION SELECT server FROM alerts)"
    join = "LEFT JOIN bounds bd USING (server)" if bounded else ""
    return f"""hit AS (SELECT t.server, t.ts, (min(epoch_us(a.ts)) - epoch_us(t.ts)) / 1e6 AS lat FROM truth t LEFT JOIN alerts a
        ON a.server = t.server AND epoch_us(a.ts) BETWEEN epoch_us(t.ts) - {lead_us} AND epoch_us(t.ts) + {lag_us} GROUP BY t.server, t.ts, t.event_id),
    pe AS (SELECT server, count(*) AS n_events, count(lat) AS n_events_detected, median(lat) AS event_latency_median_s, quantile_cont(lat, 0.25) AS event_latency_p25_s,
      avg(CASE WHEN lat < 0 THEN 1.0 WHEN lat IS NOT NULL THEN 0.0 END) AS event_pre_onset_frac, min(ts) AS e0, max(ts) AS e1 FROM hit GROUP BY 1),
    om AS (SELECT e.server, e.episode, any_value(e.start_ts) AS s0, any_value(e.end_ts) AS s1, any_value(n_points) AS np,
      bool_or(coalesce(epoch_us(e.end_ts) >= epoch_us(t.ts) - {lead_us} AND epoch_us(e.start_ts) <= epoch_us(t.ts) + {lag_us}, FALSE)) AS matched
      FROM episodes e LEFT JOIN truth t USING (server) GROUP BY 1, 2),
    pa AS (SELECT server, count(*) AS neps, count(*) FILTER (matched) AS nm, sum(np) AS na, min(s0) AS a0, max(s1) AS a1 FROM om GROUP BY 1),
    {name} AS (SELECT q.server, coalesce(any_value(n_events), 0) AS n_events, coalesce(any_value(n_events_detected), 0) AS n_events_detected,
      any_value(n_events_detected) / any_value(n_events) AS event_recall, any_value(event_latency_median_s) AS event_latency_median_s, any_value(event_latency_p25_s) AS event_latency_p25_s,
      any_value(event_pre_onset_frac) AS event_pre_onset_frac, coalesce(any_value(neps), 0) AS n_alert_episodes, any_value(nm) / any_value(neps) AS alert_event_precision,
      coalesce(any_value(neps), 0) - coalesce(any_value(nm), 0) AS n_false_alert_episodes, {hours} AS event_eval_hours,
      (coalesce(any_value(neps), 0) - coalesce(any_value(nm), 0)) / {hours} AS false_alert_episodes_per_h
      FROM {every} q LEFT JOIN pe USING (server) LEFT JOIN pa USING (server) {join} GROUP BY 1)"""


SCORE_COLUMNS = """server, n_events, n_events_detected, ~event_recall, ~event_latency_median_s, ~event_latency_p25_s, ~event_pre_onset_frac, n_alert_episodes,
    ~alert_event_precision, n_false_alert_episodes, ~false_alert_episodes_per_h, ~event_eval_hours"""


@query("g31_event_score", SCORE_COLUMNS, f"WITH {EPISODE_SQL}, {event_score_sql(DAY_US, DAY_US // 2)} SELECT * FROM es")
def g31(spark, d):
    return s.event_score(b.truth(spark, d), b.alerts(spark, d), b.MATCH, b.DAY, b.DAY / 2, b.DAY)


ALERT_EPS = f"""ae AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY server ORDER BY ts) > {DAY_US} THEN 1 ELSE 0 END AS brk FROM alerts),
  ai AS (SELECT *, sum(brk) OVER (PARTITION BY server ORDER BY ts) AS episode FROM ae),
  episodes AS (SELECT server, episode, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_points FROM ai GROUP BY 1, 2),
  bounds AS (SELECT server, min(ts) AS start_ts, max(ts) AS end_ts FROM samples GROUP BY 1)"""


@query(
    "g32_live_score", SCORE_COLUMNS,
    f"""WITH RECURSIVE {RN_SQL}, {onset_sql('power_watts', 40, 1)}, truth AS (SELECT server, onset_ts AS ts, rn AS event_id FROM onset),
    alerts AS (SELECT server, ts FROM samples WHERE usage_percent > 75), {ALERT_EPS}, {event_score_sql(DAY_US, DAY_US, True)} SELECT * FROM es""",
)
def g32(spark, d):
    src = b.samples(spark, d)
    risk = src.select("server", "ts", F.when(F.col("usage_percent") > 75, 1).otherwise(0).alias("risk"))
    series = b.SAMPLES.__class__(("server",), "ts", (), 5 * b.DAY)
    return s.live_score(src, risk, series, "power_watts", 40.0, b.DAY, b.DAY, b.DAY)


@query(
    "g34_usage_edge_score", SCORE_COLUMNS + ", ~alert_duty, n_alert_points, n_eval_points",
    f"""WITH RECURSIVE {EDGE_SQL}, n AS (SELECT *, row_number() OVER w AS rn FROM samples WINDOW w AS {W}), {onset_sql('power_watts', 40, 1)},
    truth AS (SELECT server, onset_ts AS ts, rn AS event_id FROM onset), alerts AS (SELECT server, ts FROM edges WHERE edge <> 0), {ALERT_EPS},
    {event_score_sql(DAY_US, DAY_US, True)}, du AS (SELECT server, avg(CASE WHEN edge <> 0 THEN 1.0 ELSE 0.0 END) AS alert_duty, count(*) FILTER (edge <> 0) AS n_alert_points, count(*) AS n_eval_points FROM edges GROUP BY 1)
    SELECT * FROM es JOIN du USING (server)""",
)
def g34(spark, d):
    series = b.SAMPLES.__class__(("server",), "ts", (), 5 * b.DAY)
    return s.usage_edge_score(b.samples(spark, d), series, 60.0, 0.002, 40.0, b.DAY, b.DAY, b.DAY)


@query("g35_alert_duty", "server, ~alert_duty", f"WITH {S} SELECT server, avg(CASE WHEN usage_percent > 75 THEN 1.0 ELSE 0.0 END) AS alert_duty FROM samples GROUP BY 1")
def g35(spark, d):
    return s.duty(b.samples(spark, d).withColumn("flag", F.col("usage_percent") > 75), ["server"])


@query(
    "g36_false_alarms", "server, quiet_rows, false_alarms, ~false_alarm_rate, ~busy_flag_frac",
    f"""WITH {REGION_SQL}, x AS (SELECT server, count(*) FILTER (region IN ('dip', 'idle')) AS quiet_rows, count(*) FILTER (region IN ('dip', 'idle') AND usage_percent > 75) AS false_alarms,
      avg(CASE WHEN region = 'busy' THEN CASE WHEN usage_percent > 75 THEN 1.0 ELSE 0.0 END END) AS busy_flag_frac FROM region GROUP BY 1)
    SELECT *, false_alarms / nullif(quiet_rows, 0) AS false_alarm_rate FROM x""",
)
def g36(spark, d):
    lab = e.phase_labels(b.samples(spark, d), schedule(spark, d), b.SAMPLES)
    return s.false_alarms(lab.withColumn("flag", F.col("usage_percent") > 75), ["server"])


@query(
    "g37_pooled_folds", "model, folds, ~event_recall, ~alert_event_precision, ~recall, ~precision, ~alert_duty, ~event_latency_median_s",
    f"""WITH {EPISODE_SQL}, {event_score_sql(DAY_US, DAY_US // 2)}, f AS (SELECT server % 3 AS model, * FROM es)
    SELECT model, count(*) AS folds, sum(n_events_detected) / sum(n_events) AS event_recall, (sum(n_alert_episodes) - sum(n_false_alert_episodes)) / sum(n_alert_episodes) AS alert_event_precision,
    sum(n_events_detected) / sum(n_events + 7) AS recall, sum(n_events_detected) / sum(n_alert_episodes + 3) AS precision, sum(n_alert_episodes + 3) / sum(n_events * 9 + 50) AS alert_duty,
    avg(event_latency_median_s) AS event_latency_median_s FROM f GROUP BY 1""",
)
def g37(spark, d):
    es = s.event_score(b.truth(spark, d), b.alerts(spark, d), b.MATCH, b.DAY, b.DAY / 2, b.DAY)
    folds = es.withColumns(
        {
            "model": F.col("server") % 3, "pr_auc": F.lit(None).cast("double"), "n_tp": F.col("n_events_detected"),
            "n_spikes": F.col("n_events") + 7, "n_flags": F.col("n_alert_episodes") + 3, "n_rows": F.col("n_events") * 9 + 50,
        }
    )
    return s.pool_folds(folds)


RULES_SQL = f"""{SPIKE_SQL}, rules AS (SELECT * FROM (VALUES ('z>0.5', 0.5, 0), ('z>1', 1.0, 0), ('z>1.5', 1.5, 0), ('z>0.5 and u>50', 0.5, 50), ('z>1 and u>70', 1.0, 70)) AS r(rule, zk, uk)),
  rl AS (SELECT rule, server, rn FROM spikes, rules WHERE z > zk AND usage_percent > uk),
  rg AS (SELECT *, rn - lag(rn) OVER (PARTITION BY rule, server ORDER BY rn) AS g FROM rl),
  ep AS (SELECT rule, server, rn FROM rg WHERE g IS NULL OR g > 3),
  lt AS (SELECT r.rule, o.server, o.rn, min(f.rn) - o.rn AS lat FROM rules r CROSS JOIN on_rows o LEFT JOIN rl f ON f.rule = r.rule AND f.server = o.server AND f.rn BETWEEN o.rn AND o.rn + 3 GROUP BY 1, 2, 3),
  pr AS (SELECT ep.rule, ep.server, ep.rn, coalesce(bool_or(abs(o.rn - ep.rn) <= 2), FALSE) AS hit FROM ep LEFT JOIN on_rows o USING (server) GROUP BY 1, 2, 3),
  board AS (SELECT l.rule, count(*) AS n_onsets, count(lat) AS detected, count(lat) / count(*) AS det_rate, median(lat) AS median_lat, any_value(p.n) AS n_episodes, any_value(p.n) - any_value(p.m) AS false_ep, any_value(p.m) / any_value(p.n) AS precision
    FROM lt l JOIN (SELECT rule, count(*) AS n, count(*) FILTER (hit) AS m FROM pr GROUP BY 1) p USING (rule) GROUP BY 1)"""
RULE_LIST = [
    ("z>0.5", 0.5, 0.0), ("z>1", 1.0, 0.0), ("z>1.5", 1.5, 0.0), ("z>0.5 and u>50", 0.5, 50.0), ("z>1 and u>70", 1.0, 70.0),
]
GRID_SQL = RULES_SQL.replace(", rules AS", f", {onset_sql('power_watts', 40, 5)}, on_rows AS (SELECT server, rn + 1 AS rn FROM onset), rules AS", 1)


def board(spark, d):
    src = b.samples(spark, d).select("server", "ts", "event_id", "power_watts", "usage_percent")
    scored = f.with_spikes(src, b.SAMPLES, row_number="rn")
    scored = cut(scored.select("server", "rn", "d1", "ewma_z", "usage_percent"))
    onsets = e.landings(scored, b.SAMPLES, "d1", 40.0, 5)
    rules = {r: (F.col("ewma_z") > zk) & (F.col("usage_percent") > uk) for r, zk, uk in RULE_LIST}
    return s.rule_grid(scored, onsets, b.SAMPLES, rules, 3, 3, 2)


@query("g38_rule_grid", "rule, n_onsets, detected, ~det_rate, ~median_lat, n_episodes, false_ep, ~precision", f"WITH RECURSIVE {GRID_SQL} SELECT * FROM board")
def g38(spark, d):
    return board(spark, d)


@query(
    "j11_pareto_nearest_rule", "rule, frontier_rule, ~det_rate, ~precision, ~frontier_precision, wins",
    f"""WITH RECURSIVE {GRID_SQL}, x AS (SELECT a.rule, c.rule AS frontier_rule, a.det_rate, a.precision, c.precision AS frontier_precision, a.precision > c.precision AS wins,
      row_number() OVER (PARTITION BY a.rule ORDER BY abs(c.det_rate - a.det_rate), c.det_rate) AS k FROM board a, board c WHERE a.rule LIKE '%and%' AND c.rule NOT LIKE '%and%') SELECT * FROM x WHERE k = 1""",
)
def j11(spark, d):
    from wattframe.operators.match import nearest_rule

    return nearest_rule(board(spark, d), ~F.col("rule").contains("and"))


@query(
    "g39_regime_contrast", "server, regime, rows, ~mean_score, ~flagged_frac",
    f"""WITH {RUN_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY server ORDER BY epoch_us(end_ts) - epoch_us(start_ts) DESC, start_ts) AS k FROM runs), o AS (SELECT * FROM k WHERE k = 1),
    x AS (SELECT s.*, start_ts, end_ts, row_number() OVER (PARTITION BY s.server, s.ts < start_ts ORDER BY s.ts DESC, s.event_id DESC) AS r FROM samples s JOIN o USING (server)),
    y AS (SELECT server, power_watts, CASE WHEN ts < start_ts THEN 'before' ELSE 'run' END AS regime FROM x WHERE (ts >= start_ts AND ts < end_ts) OR (ts < start_ts AND r <= 12))
    SELECT server, regime, count(*) AS rows, avg(power_watts) AS mean_score, avg(CASE WHEN power_watts > 50 THEN 1.0 ELSE 0.0 END) AS flagged_frac FROM y GROUP BY 1, 2""",
)
def g39(spark, d):
    best = e.longest_run(runs(spark, d), b.SAMPLES)
    scores = b.samples(spark, d).select("server", "ts", "event_id", F.col("power_watts").alias("score"))
    return s.regime_contrast(scores, best, b.SAMPLES, 50.0, 12)
