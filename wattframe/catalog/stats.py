"""Queries over statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe import bindings as b
from wattframe.catalog import query
from wattframe.catalog.events import EPISODE_SQL, RUN_SQL, runs
from wattframe.catalog.events import DAY_US
from wattframe.catalog.features import RN_SQL, S, SPIKE_SQL, W
from wattframe.catalog.score import event_score_sql
from wattframe.catalog.traces import K, T
from wattframe.operators import features as f
from wattframe.operators import matrix as mx
from wattframe.operators import score as sc
from wattframe.operators import stats as s
from wattframe.plans.timeline import number_rows

IDLE_SQL = f"""{RUN_SQL}, idle AS (SELECT s.server, median(power_watts) AS idle_w FROM samples s WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.server = s.server AND s.ts BETWEEN r.start_ts AND r.end_ts) GROUP BY 1)"""


@query(
    "g12_pooled_detector", "~event_recall, ~alert_precision, ~event_latency_s, ~lead_time_s, n_truth",
    f"""WITH {EPISODE_SQL}, {event_score_sql(DAY_US, DAY_US // 2)} SELECT sum(n_events_detected) / sum(n_events) AS event_recall, sum(round_even(alert_event_precision * n_alert_episodes, 0)) / sum(n_alert_episodes) AS alert_precision,
    median(event_latency_median_s) AS event_latency_s, -median(event_latency_median_s) AS lead_time_s, sum(n_events) AS n_truth FROM es""",
)
def g12(spark, d):
    es = sc.event_score(b.truth(spark, d), b.alerts(spark, d), b.MATCH, b.DAY, b.DAY / 2, b.DAY)
    return mx.pooled_detector(
        es.select(
            "n_alert_episodes", F.col("n_events").alias("n_truth"), F.col("n_events_detected").alias("n_detected"),
            F.col("alert_event_precision").alias("precision"), F.col("event_latency_median_s").alias("latency_median_s"),
        )
    )


@query(
    "g33_actuation_score", "server, n_events, n_events_detected, ~event_recall, ~event_latency_median_s, n_alert_episodes, ~alert_event_precision",
    f"""WITH {EPISODE_SQL}, {event_score_sql(DAY_US, DAY_US // 2)}, m AS (SELECT server, lat, row_number() OVER (PARTITION BY server ORDER BY lat) - 1 AS k, count(*) OVER (PARTITION BY server) AS c FROM hit WHERE lat IS NOT NULL)
    SELECT es.server, n_events, n_events_detected, event_recall, lat AS event_latency_median_s, n_alert_episodes, alert_event_precision FROM es LEFT JOIN (SELECT * FROM m WHERE k = c // 2) q USING (server)""",
)
def g33(spark, d):
    return sc.event_score(
        b.truth(spark, d), b.alerts(spark, d), b.MATCH, b.DAY, b.DAY / 2, b.DAY, element_median=True
    )


@query(
    "g21_idle_baseline", "server, event_id, ~idle_w, ~net_power_watts",
    f"WITH {IDLE_SQL} SELECT server, event_id, idle_w, power_watts - idle_w AS net_power_watts FROM samples JOIN idle USING (server)",
)
def g21(spark, d):
    src = b.samples(spark, d)
    return s.net_power(src, s.idle_baseline_watts(src, runs(spark, d), b.SAMPLES), b.SAMPLES)


@query(
    "g22_describe_run", "server, count, ~mean, ~std, ~min, ~max, ~p50, ~p90, ~p99, ~cv, ~peak_to_mean, ~ramp_per_day",
    f"""WITH {S}, a AS (SELECT server, ts, abs(power_watts - lag(power_watts) OVER w) AS da FROM samples WINDOW w AS {W}),
    r AS (SELECT server, max(s) AS ramp FROM (SELECT server, sum(da) OVER (PARTITION BY server ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW) AS s FROM a) GROUP BY 1),
    d AS (SELECT server, count(power_watts) AS count, avg(power_watts) AS mean, stddev_samp(power_watts) AS std, min(power_watts) AS min, max(power_watts) AS max, quantile_cont(power_watts, 0.5) AS p50,
      quantile_cont(power_watts, 0.9) AS p90, quantile_cont(power_watts, 0.99) AS p99 FROM samples GROUP BY 1) SELECT *, std / mean AS cv, max / mean AS peak_to_mean, ramp AS ramp_per_day FROM d JOIN r USING (server)""",
)
def g22(spark, d):
    out = s.describe_run(b.samples(spark, d), b.SAMPLES, "power_watts", b.DAY)
    return out.withColumn("ramp_per_day", F.col("ramp_rate") * b.DAY)


@query(
    "g23_correlations", "a, b, ~corr",
    f"""WITH {S} SELECT 'power_watts' AS a, 'temp_celsius' AS b, corr(power_watts, temp_celsius) AS corr FROM samples UNION ALL SELECT 'power_watts', 'freq_mhz', corr(power_watts, freq_mhz) FROM samples
    UNION ALL SELECT 'temp_celsius', 'freq_mhz', corr(temp_celsius, freq_mhz) FROM samples UNION ALL SELECT 'power_watts', 'power_watts', 1.0 UNION ALL SELECT 'temp_celsius', 'temp_celsius', 1.0 UNION ALL SELECT 'freq_mhz', 'freq_mhz', 1.0""",
)
def g23(spark, d):
    return s.correlations(b.samples(spark, d), ["power_watts", "temp_celsius", "freq_mhz"])


SCREEN_SQL = f"""{SPIKE_SQL}, l AS (SELECT *, coalesce(max(spike_both) OVER (PARTITION BY server ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS label FROM spikes),
  u AS (SELECT label, 'usage_percent' AS feature, usage_percent AS x FROM l UNION ALL SELECT label, 'temp_celsius', temp_celsius FROM l UNION ALL SELECT label, 'd1', d1 FROM l),
  m AS (SELECT feature, count(x) FILTER (label > 0) AS n_pre, count(x) FILTER (label = 0) AS n_normal, avg(x) FILTER (label > 0) AS mean_pre, avg(x) FILTER (label = 0) AS mean_normal,
    var_samp(x) FILTER (label > 0) AS v1, var_samp(x) FILTER (label = 0) AS v0 FROM u WHERE x IS NOT NULL GROUP BY 1)"""


@query(
    "g24_group_screen", "feature, n_pre, n_normal, ~mean_pre, ~mean_normal, ~t, ~dof, ~cohens_d",
    f"""WITH {SCREEN_SQL} SELECT *, (mean_pre - mean_normal) / sqrt(v1 / n_pre + v0 / n_normal) AS t, (v1 / n_pre + v0 / n_normal) ** 2 / ((v1 / n_pre) ** 2 / (n_pre - 1) + (v0 / n_normal) ** 2 / (n_normal - 1)) AS dof,
    (mean_pre - mean_normal) / sqrt((v1 + v0) / 2) AS cohens_d FROM m""",
)
def g24(spark, d):
    lab = f.with_label(b.samples(spark, d), b.SAMPLES)
    return s.screen(lab, ["usage_percent", "temp_celsius", "d1"], "label")


OLS_SQL = f"""{S}, x AS (SELECT server, power_watts AS y, usage_percent AS a, nr_running AS c FROM samples),
  q AS (SELECT server, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(c) AS mc, var_pop(y) AS vy, var_pop(a) AS va, var_pop(c) AS vc, covar_pop(a, c) AS ac, covar_pop(a, y) AS ay, covar_pop(c, y) AS cy FROM x GROUP BY 1),
  o AS (SELECT *, (ay * vc - cy * ac) / (va * vc - ac * ac) AS ba, (cy * va - ay * ac) / (va * vc - ac * ac) AS bc FROM q WHERE n > 3),
  r AS (SELECT *, (ba * ay + bc * cy) / vy AS r2, my - ba * ma - bc * mc AS b0 FROM o)"""


@query(
    "g25_linear_fit", "server, term, ~coef, ~std_coef, ~r2, ~adj_r2, ~rmse, n",
    f"""WITH {OLS_SQL}, t AS (SELECT server, 'intercept' AS term, b0 AS coef, 0.0 AS std_coef, r2, vy, n FROM r UNION ALL SELECT server, 'usage_percent', ba, ba * sqrt(va / vy), r2, vy, n FROM r
      UNION ALL SELECT server, 'nr_running', bc, bc * sqrt(vc / vy), r2, vy, n FROM r)
    SELECT *, 1 - (1 - r2) * (n - 1) / (n - 3) AS adj_r2, sqrt(vy * (1 - r2)) AS rmse FROM t""",
)
def g25(spark, d):
    return s.fit_ols(b.samples(spark, d), "power_watts", ["usage_percent", "nr_running"], ["server"])


@query(
    "g26_polynomial_fit", "degree, term, ~4coef, ~r2, ~4rmse, n",
    f"""WITH {S}, x AS (SELECT power_watts AS y, usage_percent AS a, usage_percent ** 2 AS c FROM samples),
    q AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(c) AS mc, var_pop(y) AS vy, var_pop(a) AS va, var_pop(c) AS vc, covar_pop(a, c) AS ac, covar_pop(a, y) AS ay, covar_pop(c, y) AS cy FROM x),
    o AS (SELECT *, (ay * vc - cy * ac) / (va * vc - ac * ac) AS ba, (cy * va - ay * ac) / (va * vc - ac * ac) AS bc, ay / va AS b1 FROM q)
    SELECT 1 AS degree, 'intercept' AS term, my - b1 * ma AS coef, b1 * ay / vy AS r2, sqrt(vy - b1 * ay) AS rmse, n FROM o UNION ALL SELECT 1, 'usage_percent^1', b1, b1 * ay / vy, sqrt(vy - b1 * ay), n FROM o
    UNION ALL SELECT 2, 'intercept', my - ba * ma - bc * mc, (ba * ay + bc * cy) / vy, sqrt(vy - ba * ay - bc * cy), n FROM o UNION ALL SELECT 2, 'usage_percent^1', ba, (ba * ay + bc * cy) / vy, sqrt(vy - ba * ay - bc * cy), n FROM o
    UNION ALL SELECT 2, 'usage_percent^2', bc, (ba * ay + bc * cy) / vy, sqrt(vy - ba * ay - bc * cy), n FROM o""",
)
def g26(spark, d):
    return s.fit_poly(b.samples(spark, d), "power_watts", "usage_percent", [1, 2])


@query("g27_polynomial_interactions", "term, ~coef, ~r2, ~adj_r2, ~rmse, n")
def g27(spark, d):
    return s.fit_poly_interactions(
        b.samples(spark, d), "power_watts", ["usage_percent", "temp_celsius", "nr_running"], 2
    )


@query(
    "g40_density_histogram", "kind, bin, ~lo_edge, ~hi_edge, count, ~density",
    f"""WITH {S}, e AS (SELECT kind, min(power_watts) AS lo, (max(power_watts) - min(power_watts)) / 45 AS w, count(*) AS n FROM samples GROUP BY 1),
    x AS (SELECT kind, CAST(least(floor((power_watts - lo) / w), 44) AS INT) AS bin, lo, w, n FROM samples JOIN e USING (kind))
    SELECT kind, bin, lo + bin * w AS lo_edge, lo + bin * w + w AS hi_edge, count(*) AS count, count(*) / (any_value(n) * any_value(w)) AS density FROM x GROUP BY kind, bin, lo, w""",
)
def g40(spark, d):
    out = s.density_histogram(b.samples(spark, d), "power_watts", ["kind"])
    return out.withColumnsRenamed({"left": "lo_edge", "right": "hi_edge"})


@query(
    "g41_top_periods", "server, rank, k, n, ~period, ~2power",
    f"""WITH {RN_SQL}, c AS (SELECT server, rn - 1 AS j, power_watts - avg(power_watts) OVER (PARTITION BY server) AS x, count(*) OVER (PARTITION BY server) AS n FROM n),
    f AS (SELECT server, n, unnest(generate_series(1, n // 2)) AS k FROM (SELECT DISTINCT server, n FROM c)),
    p AS (SELECT f.server, f.n, f.k, sum(x * cos(2 * pi() * ((j * k) % f.n) / f.n)) ** 2 + sum(x * sin(2 * pi() * ((j * k) % f.n) / f.n)) ** 2 AS power FROM f JOIN c USING (server) GROUP BY 1, 2, 3),
    r AS (SELECT *, n / k AS period, row_number() OVER (PARTITION BY server ORDER BY power DESC) AS rank FROM p WHERE n / k >= 2) SELECT * FROM r WHERE rank <= 5""",
)
def g41(spark, d):
    return s.top_periods(b.samples(spark, d), b.SAMPLES, "power_watts")


@query(
    "g48_calibration_table", "arm, setting, ~mean_w, rows",
    f"""WITH {T}, s AS (SELECT *, CAST(floor(power_W / 50) AS BIGINT) AS setting FROM traces), z AS (SELECT *, min(time_s) OVER (PARTITION BY arm, setting) AS t0 FROM s),
    m AS (SELECT arm, setting, avg(power_W) AS mean_w, count(*) AS rows FROM z WHERE time_s >= t0 + 864000 GROUP BY 1, 2),
    o AS (SELECT *, coalesce(bool_or(mean_w > 300) OVER (PARTITION BY arm ORDER BY setting ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS ov FROM m) SELECT * FROM o WHERE NOT ov""",
)
def g48(spark, d):
    tr = b.traces(spark, d).withColumn("setting", F.floor(F.col("power_W") / 50).cast("long"))
    return s.calibration_table(tr, ["arm"], "setting", "time_s", "power_W", 864_000.0, 300.0)


@query(
    "g49_stepwise_deltas", "arm, run, ~mean_w, ~delta_first, ~step",
    f"""WITH {T}, m AS (SELECT arm, run, avg(power_W) AS mean_w FROM traces GROUP BY 1, 2) SELECT *, mean_w - first_value(mean_w) OVER w AS delta_first, mean_w - lag(mean_w) OVER w AS step FROM m WINDOW w AS (PARTITION BY arm ORDER BY run)""",
)
def g49(spark, d):
    m = b.traces(spark, d).groupBy("arm", "run").agg(F.avg("power_W").alias("mean_w"))
    return s.stepwise(m, ["arm"], "run", "mean_w")


@query(
    "g50_replay_score", "run, workload, arm, ~engage_duty, ~ballast_peak, ~mean_deficit_w, ~mean_w, ~runnable_busy_cs, ~5up_per_day, ~5down_per_day",
    f"""WITH {T}, m AS (SELECT run, workload, arm, time_s + 10000 AS t, power_W * 0.9 AS meas, seq % 3 = 0 AS engaged, CAST(seq % 8 AS DOUBLE) AS ballast, CAST(seq % 5 AS DOUBLE) AS runnable FROM traces),
    lo AS (SELECT m.*, x.time_s AS t0, x.power_W AS v0 FROM m ASOF LEFT JOIN traces x ON m.run = x.run AND m.workload = x.workload AND m.arm = x.arm AND m.t >= x.time_s),
    hi AS (SELECT lo.*, x.time_s AS t1, x.power_W AS v1 FROM lo ASOF LEFT JOIN traces x ON lo.run = x.run AND lo.workload = x.workload AND lo.arm = x.arm AND lo.t <= x.time_s),
    dm AS (SELECT *, coalesce(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (t - t0) * (v1 - v0) / (t1 - t0) END, v0, v1) AS demand, (lead(meas, 3) OVER w - meas) / (lead(t, 3) OVER w - t) AS ramp FROM hi WINDOW w AS (PARTITION BY run, workload, arm ORDER BY t)),
    bz AS (SELECT run, workload, arm, 0.8 * max(power_W) AS busy FROM traces GROUP BY 1, 2, 3)
    SELECT dm.run, dm.workload, dm.arm, avg(CASE WHEN engaged THEN 1.0 ELSE 0.0 END) AS engage_duty, max(ballast) AS ballast_peak, avg(greatest(demand - (meas - ballast * 2.5), 0.0)) AS mean_deficit_w, avg(meas) AS mean_w,
      coalesce(sum(CASE WHEN demand > busy THEN runnable * 0.05 END), 0.0) AS runnable_busy_cs, max(ramp) * 86400 AS up_per_day, min(ramp) * 86400 AS down_per_day FROM dm JOIN bz USING (run, workload, arm) GROUP BY 1, 2, 3""",
)
def g50(spark, d):
    tr = b.traces(spark, d)
    seq = F.col("seq")
    measured = tr.select(
        *b.TRACES.key, (F.col("time_s") + 10_000).alias("time_s"), (F.col("power_W") * 0.9).alias("meas"),
        (seq % 3 == 0).alias("engaged"), (seq % 8).cast("double").alias("ballast"),
        (seq % 5).cast("double").alias("runnable"),
    )
    out = s.replay_score(measured, tr.drop("seq"), b.TRACES, 3, 2.5, 0.05)
    return out.withColumns({"up_per_day": F.col("max_up") * b.DAY, "down_per_day": F.col("max_down") * b.DAY})
