"""Queries over event detection and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe import bindings as b
from wattframe.catalog import query
from wattframe.catalog.features import RN_SQL, S, SPIKE_SQL, W, onset_sql
from wattframe.operators import events as e
from wattframe.operators import features as f
from wattframe.plans.timeline import by_rows, number_rows
from wattframe.series import Series

ID = "server, event_id"
US = F.unix_micros
DAY_US = 86_400_000_000


@query(
    "e1_find_onsets", "server, rn, ~z, ~z_next, onset_us",
    f"""WITH RECURSIVE {RN_SQL}, {onset_sql('power_watts', 20, 4, extra='z < 40 AND z_next >= 30')}
    SELECT server, rn, z, z_next, epoch_us(onset_ts) AS onset_us FROM onset""",
)
def e1(spark, d):
    out = e.find_onsets(b.samples(spark, d), b.SAMPLES, "power_watts", 50.0, 40.0, 20.0, 4)
    return out.withColumn("onset_us", US("onset_ts"))


KNOWN_SQL = f"{S}, n AS (SELECT *, row_number() OVER w AS rn FROM samples WHERE temp_celsius IS NOT NULL WINDOW w AS {W})"


@query(
    "e2_true_transitions", "server, direction, t_us",
    f"""WITH RECURSIVE {KNOWN_SQL}, {onset_sql('temp_celsius', 10, 1, name='up')}, {onset_sql('-temp_celsius', 10, 1, name='down')}
    SELECT server, 'rise' AS direction, epoch_us(onset_ts) AS t_us FROM up UNION ALL SELECT server, 'drop', epoch_us(onset_ts) FROM down""",
)
def e2(spark, d):
    src = b.samples(spark, d)
    parts = [
        e.true_transitions(src, b.SAMPLES, "temp_celsius", way, 10.0).withColumn("direction", F.lit(way))
        for way in ("rise", "drop")
    ]
    return parts[0].unionByName(parts[1]).withColumn("t_us", US("ts"))


ONSET25_SQL = f"{RN_SQL}, {onset_sql('power_watts', 25, 10)}"


def onsets25(spark, d):
    return e.hf_onsets(b.samples(spark, d), b.SAMPLES, "power_watts", 25.0, 10)


@query("e3_hf_onsets", "server, rn, ~z, ~z_next", f"WITH RECURSIVE {ONSET25_SQL} SELECT * FROM onset")
def e3(spark, d):
    return onsets25(spark, d)


@query(
    "e4_pre_jump_trend", "server, rn, ~slope, ~resid_std, rising",
    f"""WITH RECURSIVE {ONSET25_SQL}, p AS (SELECT o.server, o.rn, n.rn - o.rn AS x, n.power_watts AS y FROM onset o JOIN n ON n.server = o.server AND n.rn BETWEEN o.rn - 8 AND o.rn - 1),
    f AS (SELECT server, rn, regr_slope(y, x) AS slope, regr_intercept(y, x) AS i FROM p GROUP BY 1, 2 HAVING count(*) = 8),
    r AS (SELECT server, rn, any_value(slope) AS slope, sqrt(avg((y - i - slope * x) ** 2)) AS resid_std FROM p JOIN f USING (server, rn) GROUP BY 1, 2)
    SELECT *, slope > resid_std / 2 AS rising FROM r""",
)
def e4(spark, d):
    num = number_rows(b.samples(spark, d), b.SAMPLES, "rn")
    return e.pre_jump_trend(onsets25(spark, d), num, b.SAMPLES, "power_watts")


LAG_SQL = f"""{ONSET25_SQL}, p AS (SELECT o.server, o.rn, n.rn - o.rn AS x, n.nr_running AS y FROM onset o JOIN n ON n.server = o.server AND n.rn BETWEEN o.rn - 12 AND o.rn + 10),
    s AS (SELECT server, rn, median(y) FILTER (x < -3) + greatest(0.5 * stddev_pop(y) FILTER (x < -3), 1.0) AS thr FROM p GROUP BY 1, 2 HAVING count(*) = 23),
    lagged AS (SELECT server, rn, min(CASE WHEN y > thr THEN x - 1 END) AS lag FROM p JOIN s USING (server, rn) GROUP BY 1, 2)"""


def lags(spark, d):
    num = number_rows(b.samples(spark, d), b.SAMPLES, "rn")
    return e.step_lag(onsets25(spark, d), num, b.SAMPLES, "nr_running", 12, 3, 0.5, 1.0)


@query("e5_step_lag", "server, rn, lag", f"WITH RECURSIVE {LAG_SQL} SELECT o.server, o.rn, l.lag FROM onset o LEFT JOIN lagged l ON l.server = o.server AND l.rn = o.rn")
def e5(spark, d):
    return lags(spark, d)


@query(
    "e6_lead_report", "server, signal, moved, led, coincident, lagged, ~median_lag",
    f"""WITH RECURSIVE {LAG_SQL} SELECT server, 'nr_running' AS signal, count(*) AS moved, count(*) FILTER (lag < 0) AS led, count(*) FILTER (lag = 0) AS coincident,
    count(*) FILTER (lag > 0) AS lagged, median(lag) AS median_lag FROM lagged WHERE lag IS NOT NULL GROUP BY 1""",
)
def e6(spark, d):
    return e.lead_report(lags(spark, d).withColumn("signal", F.lit("nr_running")), ["server"])


@query(
    "e6_onset_gaps", "server, ~gap_p10, ~gap_median, ~gap_p90",
    f"""WITH RECURSIVE {ONSET25_SQL}, g AS (SELECT server, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY server ORDER BY ts)) / 1e6 AS g FROM onset)
    SELECT server, quantile_cont(g, 0.1) AS gap_p10, quantile_cont(g, 0.5) AS gap_median, quantile_cont(g, 0.9) AS gap_p90 FROM g WHERE g IS NOT NULL GROUP BY 1""",
)
def e6b(spark, d):
    return e.onset_gaps(onsets25(spark, d), Series(("server",), "ts", (), 5 * b.DAY))


@query(
    "e7_overshoot", "server, rn, ~pl1, ~pl2, ~overshoot_w, ~window_s",
    f"""WITH RECURSIVE {ONSET25_SQL}, q AS (SELECT server, quantile_cont(power_watts, 0.75) AS p75 FROM n GROUP BY 1),
    bs AS (SELECT server, stddev_pop(power_watts) AS busy FROM n JOIN q USING (server) WHERE power_watts > p75 GROUP BY 1),
    p AS (SELECT o.server, o.rn, n.rn - o.rn AS x, n.power_watts AS y FROM onset o JOIN n ON n.server = o.server AND n.rn BETWEEN o.rn + 1 AND o.rn + 14),
    s AS (SELECT server, rn, median(y) FILTER (x > 8) AS pl1, count(*) AS c FROM p GROUP BY 1, 2 HAVING count(*) >= 12),
    h AS (SELECT p.*, pl1, pl1 + 2 * busy AS hi FROM p JOIN s USING (server, rn) JOIN bs USING (server))
    SELECT server, rn, any_value(pl1) AS pl1, coalesce(median(y) FILTER (y > hi), any_value(pl1)) AS pl2,
      coalesce(median(y) FILTER (y > hi), any_value(pl1)) - any_value(pl1) AS overshoot_w, coalesce(max(x) FILTER (y > hi AND x <= 10), 0) * 0.25 AS window_s FROM h GROUP BY 1, 2""",
)
def e7(spark, d):
    num = number_rows(b.samples(spark, d), b.SAMPLES, "rn")
    return e.overshoot(onsets25(spark, d), num, b.SAMPLES, "power_watts", 0.25, 3.5)


RUN_SQL = f"""{S}, bz AS (SELECT *, usage_percent > 30 AS busy FROM samples), st AS (SELECT *, CASE WHEN busy AND NOT coalesce(lag(busy) OVER w, FALSE) THEN 1 ELSE 0 END AS s FROM bz WINDOW w AS {W}),
  rr AS (SELECT *, sum(s) OVER w AS run FROM st WINDOW w AS {W}),
  runs AS (SELECT server, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS rows FROM rr WHERE busy GROUP BY server, run HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= {DAY_US})"""


def runs(spark, d):
    return e.busy_runs(b.samples(spark, d), b.SAMPLES, "usage_percent", 30.0, b.DAY)


@query("e8_busy_runs", "server, a_us, b_us, rows", f"WITH {RUN_SQL} SELECT server, epoch_us(start_ts) AS a_us, epoch_us(end_ts) AS b_us, rows FROM runs")
def e8(spark, d):
    return runs(spark, d).withColumns({"a_us": US("start_ts"), "b_us": US("end_ts")})


SEGMENT_SQL = f"""{S}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > {DAY_US} THEN 1 ELSE 0 END AS brk FROM samples WINDOW w AS {W}),
  seg AS (SELECT *, sum(brk) OVER w AS segment FROM g WINDOW w AS {W})"""


@query("e9_segments", f"{ID}, segment", f"WITH {SEGMENT_SQL} SELECT * FROM seg")
def e9(spark, d):
    return e.with_segments(b.samples(spark, d), b.SAMPLES, b.DAY)


@query(
    "e9_longest_segment", "server, segment, rows",
    f"""WITH {SEGMENT_SQL}, c AS (SELECT server, segment, count(*) AS rows FROM seg GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY server ORDER BY rows DESC, segment) AS k FROM c)
    SELECT * FROM r WHERE k = 1""",
)
def e9b(spark, d):
    return e.longest_segment(b.samples(spark, d), b.SAMPLES, b.DAY)


@query(
    "e10_longest_run", "server, a_us, b_us",
    f"""WITH {RUN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY server ORDER BY epoch_us(end_ts) - epoch_us(start_ts) DESC, start_ts) AS k FROM runs)
    SELECT server, epoch_us(start_ts) AS a_us, epoch_us(end_ts) AS b_us FROM r WHERE k = 1""",
)
def e10(spark, d):
    return e.longest_run(runs(spark, d), b.SAMPLES).withColumns({"a_us": US("start_ts"), "b_us": US("end_ts")})


EPISODE_SQL = f"""{b.MATCH_SQL}, ae AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > {DAY_US} THEN 1 ELSE 0 END AS brk FROM alerts WINDOW w AS {W}),
  ai AS (SELECT *, sum(brk) OVER w AS episode FROM ae WINDOW w AS {W}),
  episodes AS (SELECT server, episode, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_points FROM ai GROUP BY 1, 2)"""


@query(
    "e11_alert_episodes", "server, a_us, b_us, n_points",
    f"WITH {EPISODE_SQL} SELECT server, epoch_us(start_ts) AS a_us, epoch_us(end_ts) AS b_us, n_points FROM episodes",
)
def e11(spark, d):
    out = e.episodes(b.alerts(spark, d), b.MATCH, b.DAY)
    return out.withColumns({"a_us": US("start_ts"), "b_us": US("end_ts")})


@query(
    "e12_flag_episodes", "server, rn",
    f"""WITH {RN_SQL}, f AS (SELECT server, rn, rn - lag(rn) OVER (PARTITION BY server ORDER BY rn) AS g FROM n WHERE usage_percent > 80)
    SELECT server, rn FROM f WHERE g IS NULL OR g > 5""",
)
def e12(spark, d):
    num = number_rows(b.samples(spark, d), b.SAMPLES, "rn").filter("usage_percent > 80")
    return e.flag_episodes(num, b.SAMPLES, 5)


PLATEAU_SQL = f"""{b.TRACES_SQL}, srt AS (SELECT *, row_number() OVER (PARTITION BY run, workload, arm ORDER BY power_W) - 1 AS k,
    count(*) OVER (PARTITION BY run, workload, arm) AS c FROM traces),
  lv AS (SELECT run, workload, arm, power_W AS plateau FROM srt WHERE k = c // 2 + (c - c // 2) // 2),
  win AS (SELECT t.run, t.workload, t.arm, any_value(plateau) AS plateau, min(time_s) FILTER (power_W >= 0.95 * plateau) AS t_start,
    max(time_s) FILTER (power_W >= 0.95 * plateau) AS t_end, count(*) FILTER (power_W >= 0.95 * plateau) AS hits
    FROM traces t JOIN lv USING (run, workload, arm) GROUP BY 1, 2, 3)"""


@query(
    "e13_plateau_window", "run, workload, arm, ~plateau, ~t_start, ~t_end, hits, found",
    f"WITH {PLATEAU_SQL} SELECT *, hits >= 2 AS found FROM win",
)
def e13(spark, d):
    return e.plateau_window(b.traces(spark, d), b.TRACES, "power_W", 0.95)


@query(
    "e14_trim_to_window", "run, workload, arm, seq, ~time_s, ~power_W",
    f"""WITH {PLATEAU_SQL} SELECT t.run, t.workload, t.arm, t.seq, t.time_s - t_start AS time_s, power_W FROM traces t JOIN win USING (run, workload, arm)
    WHERE hits >= 2 AND time_s BETWEEN t_start AND t_end""",
)
def e14(spark, d):
    tr = b.traces(spark, d)
    return e.trim_to_window(tr, e.plateau_window(tr, b.TRACES, "power_W", 0.95), b.TRACES)


@query(
    "e15_trim_ends", "run, workload, arm, seq, ~time_s",
    f"""WITH {b.TRACES_SQL}, m AS (SELECT *, min(time_s) OVER k AS lo, max(time_s) OVER k AS hi FROM traces WINDOW k AS (PARTITION BY run, workload, arm)),
    x AS (SELECT *, count(*) OVER k AS c, min(time_s) OVER k AS z FROM m WHERE time_s BETWEEN lo + 864000 AND hi - 1728000 WINDOW k AS (PARTITION BY run, workload, arm))
    SELECT run, workload, arm, seq, time_s - z AS time_s FROM x WHERE c >= 2""",
)
def e15(spark, d):
    return e.trim_ends(b.traces(spark, d), b.TRACES, 10 * b.DAY, 20 * b.DAY)[0]


EDGE_SQL = f"""{S}, u AS (SELECT *, lag(usage_percent) OVER w AS p, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS dt FROM samples WINDOW w AS {W}),
  edges AS (SELECT *, CASE WHEN p IS NULL OR dt <= 0 OR greatest(usage_percent, p) < 60 THEN 0
    WHEN least(usage_percent, p) < 60 OR abs(usage_percent - p) / dt >= 0.002 THEN CASE WHEN usage_percent >= p THEN 1 ELSE -1 END ELSE 0 END AS edge FROM u)"""


def edged(spark, d):
    return e.usage_edges(b.samples(spark, d), b.SAMPLES, "usage_percent", 60.0, 0.002)


@query("e16_usage_edges", f"{ID}, edge", f"WITH {EDGE_SQL} SELECT * FROM edges")
def e16(spark, d):
    return edged(spark, d)


def thin_sql(src: str, gap_us: int, out: str) -> str:
    """Greedy thinning of ``src`` (server, ts) at a minimum distance."""
    return f"""{out} AS (SELECT server, min(ts) AS ts FROM {src} GROUP BY 1
      UNION ALL SELECT k.server, min(c.ts) FROM {out} k JOIN {src} c ON c.server = k.server AND epoch_us(c.ts) >= epoch_us(k.ts) + {gap_us} GROUP BY k.server, k.ts)"""


@query(
    "e17_pulse_cooldown", f"{ID}, fired, risk, direction",
    f"""WITH RECURSIVE {EDGE_SQL}, hot AS (SELECT server, ts FROM edges WHERE edge <> 0), {thin_sql('hot', 2 * DAY_US, 'kept')},
    m AS (SELECT e.*, k.ts IS NOT NULL AS fired FROM edges e LEFT JOIN kept k ON k.server = e.server AND k.ts = e.ts),
    l AS (SELECT *, last_value(CASE WHEN fired THEN epoch_us(ts) END IGNORE NULLS) OVER w AS at_us, last_value(CASE WHEN fired THEN edge END IGNORE NULLS) OVER w AS way FROM m WINDOW w AS {W})
    SELECT {ID}, fired, CASE WHEN epoch_us(ts) - at_us < {DAY_US} THEN 1 ELSE 0 END AS risk, CASE WHEN epoch_us(ts) - at_us < {DAY_US} THEN way ELSE 0 END AS direction FROM l""",
)
def e17(spark, d):
    return e.pulses(edged(spark, d), b.SAMPLES, b.DAY, 2 * b.DAY)


@query(
    "e18_thinned_flags", "server, t_us",
    f"""WITH RECURSIVE {b.MATCH_SQL}, {thin_sql('alerts', 3 * DAY_US, 'kept')} SELECT server, epoch_us(ts) AS t_us FROM kept""",
)
def e18(spark, d):
    return e.thinned_flags(b.alerts(spark, d), b.MATCH, 3 * b.DAY).withColumn("t_us", US("ts"))


SCHEDULE_SQL = f"""{S}, sched AS (SELECT server, min(ts) + INTERVAL 1 DAY AS start_ts, max(ts) - INTERVAL 1 DAY AS end_ts, 7200.0 + 10 * (server % 7) AS busy_s, 1800.0 AS dip_s, 3.0 AS stagger_s, 64 AS ranks
  FROM samples GROUP BY 1 HAVING max(ts) - min(ts) > INTERVAL 3 DAY)"""


def schedule(spark, d):
    ends = b.samples(spark, d).groupBy("server").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    ends = ends.filter("unix_micros(z) - unix_micros(a) > 259200000000L")
    return ends.select(
        "server", F.expr("a + INTERVAL 1 DAY").alias("start_ts"), F.expr("z - INTERVAL 1 DAY").alias("end_ts"),
        (7200.0 + 10 * (F.col("server") % 7)).alias("busy_s"), F.lit(1800.0).alias("dip_s"),
        F.lit(3.0).alias("stagger_s"), F.lit(64).alias("ranks"),
    )


@query(
    "e19_burst_schedule", "server, cycle, t_us",
    f"""WITH {SCHEDULE_SQL}, p AS (SELECT server, epoch_us(start_ts) AS a, CAST((busy_s + dip_s + 2 * stagger_s * ranks) * 1000000 AS BIGINT) AS us, epoch_us(end_ts) - epoch_us(start_ts) AS span FROM sched),
    k AS (SELECT *, unnest(generate_series(0, CAST(ceil(span / us) AS BIGINT) - 1)) AS cycle FROM p) SELECT server, cycle, a + cycle * us AS t_us FROM k""",
)
def e19(spark, d):
    return e.burst_schedule(schedule(spark, d), b.SAMPLES).withColumn("t_us", US("ts"))


REGION_SQL = f"""{SCHEDULE_SQL}, ph AS (SELECT s.server, s.event_id, s.ts, s.power_watts, s.usage_percent, (epoch_us(s.ts) - epoch_us(start_ts)) / 1e6 AS secs, s.ts < end_ts AS live, busy_s, stagger_s * ranks AS ramp,
    busy_s + dip_s + 2 * stagger_s * ranks AS period FROM samples s JOIN sched USING (server)),
  region AS (SELECT *, CASE WHEN secs < 0 THEN 'idle' WHEN live AND secs - floor(secs / period) * period < busy_s THEN 'busy'
    WHEN live AND secs - floor(secs / period) * period >= busy_s + ramp THEN 'dip' ELSE 'edge' END AS region FROM ph)"""


@query("e20_phase_labels", f"{ID}, region", f"WITH {REGION_SQL} SELECT * FROM region")
def e20(spark, d):
    return e.phase_labels(b.samples(spark, d), schedule(spark, d), b.SAMPLES)


@query(
    "e21_isolated_onsets", f"{ID}, isolated",
    f"""WITH {SPIKE_SQL} SELECT {ID}, CASE WHEN spike_both = 1 AND coalesce(max(spike_both) OVER (PARTITION BY server ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS isolated FROM spikes""",
)
def e21(spark, d):
    src = f.with_spikes(b.samples(spark, d), b.SAMPLES, row_number="rn")
    return by_rows(src, b.SAMPLES, lambda w: {"isolated": e.isolated(w, "spike_both")}, before=10, row_number="rn")


@query(
    "e22_discords", "server, rn, rank, ~4distance",
    f"""WITH {RN_SQL}, wn AS (SELECT * FROM (SELECT server, rn, list(power_watts) OVER (PARTITION BY server ORDER BY rn ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS y FROM n) WHERE len(y) = 8),
    nz AS (SELECT server, rn, list_transform(y, lambda v: (v - list_avg(y)) / (list_stddev_pop(y) * sqrt(8))) AS u FROM wn),
    dd AS (SELECT a.server, a.rn, sqrt(greatest(16 * (1 - max(list_dot_product(a.u, c.u))), 0)) AS distance FROM nz a JOIN nz c ON a.server = c.server AND abs(a.rn - c.rn) > 2 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY server ORDER BY distance DESC, rn) AS rank FROM dd) SELECT * FROM r WHERE rank <= 3""",
)
def e22(spark, d):
    return e.discords(b.samples(spark, d), b.SAMPLES, "power_watts", 8, 3, 32)


@query(
    "o2_top_steps", f"{ID}, ~step, rank",
    f"""WITH {RN_SQL}, r AS (SELECT {ID}, abs(d1) AS step, row_number() OVER (PARTITION BY server ORDER BY abs(d1) DESC, ts) AS rank FROM n WHERE d1 IS NOT NULL) SELECT * FROM r WHERE rank <= 5""",
)
def o2(spark, d):
    from wattframe.plans.quantiles import descending_rank

    src = f.trivial_score(b.samples(spark, d), b.SAMPLES, name="step")
    return descending_rank(src, ["server"], "step", [F.col("ts")]).filter("rank <= 5")


@query(
    "o3_argmax_by_server", "server, event_id, ~power_watts",
    f"WITH {S} SELECT server, arg_max(event_id, power_watts) AS event_id, max(power_watts) AS power_watts FROM samples GROUP BY 1",
)
def o3(spark, d):
    return b.samples(spark, d).groupBy("server").agg(
        e.argmax("event_id", "power_watts", "event_id").alias("event_id"),
        F.max("power_watts").alias("power_watts"),
    )
