"""Queries over window features and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe import bindings as b
from wattframe.catalog import query
from wattframe.operators import events as e
from wattframe.operators import features as f
from wattframe.plans.timeline import by_rows, number_rows

W = "(PARTITION BY server ORDER BY ts, event_id)"
S = b.SAMPLES_SQL
ID = "server, event_id"


def rows(spark, d, stage, before=0, after=0):
    return by_rows(b.samples(spark, d), b.SAMPLES, stage, before=before, after=after)


@query(
    "w1_lag_features", f"{ID}, ~power_lag0, ~power_lag1, ~power_lag3, usage_lag0, usage_lag2, usage_lag3",
    f"""WITH {S} SELECT {ID}, power_watts AS power_lag0, lag(power_watts, 1) OVER w AS power_lag1,
    lag(power_watts, 3) OVER w AS power_lag3, usage_percent AS usage_lag0, lag(usage_percent, 2) OVER w AS usage_lag2,
    lag(usage_percent, 3) OVER w AS usage_lag3 FROM samples WINDOW w AS {W}""",
)
def w1(spark, d):
    return rows(spark, d, f.lag_features, before=3)


@query(
    "w2_trailing_deltas", f"{ID}, ~usage_d1, ~usage_d3, ~usage_slope3, ~usage_abs_d1",
    f"""WITH {S}, x AS (SELECT {ID}, usage_percent - lag(usage_percent) OVER w AS d1,
    usage_percent - lag(usage_percent, 3) OVER w AS d3 FROM samples WINDOW w AS {W})
    SELECT {ID}, d1 AS usage_d1, d3 AS usage_d3, d3 / 3 AS usage_slope3, abs(d1) AS usage_abs_d1 FROM x""",
)
def w2(spark, d):
    return rows(spark, d, f.usage_deltas, before=3)


@query(
    "w3_threshold_cross", f"{ID}, usage_cross_up_10, usage_cross_down_10, usage_cross_up_20, usage_cross_up_40, usage_cross_down_40",
    f"""WITH {S}, x AS (SELECT {ID}, usage_percent AS u, lag(usage_percent) OVER w AS p FROM samples WINDOW w AS {W})
    SELECT {ID}, CASE WHEN u >= 10 AND p < 10 THEN 1.0 ELSE 0.0 END AS usage_cross_up_10,
    CASE WHEN u <= 10 AND p > 10 THEN 1.0 ELSE 0.0 END AS usage_cross_down_10,
    CASE WHEN u >= 20 AND p < 20 THEN 1.0 ELSE 0.0 END AS usage_cross_up_20,
    CASE WHEN u >= 40 AND p < 40 THEN 1.0 ELSE 0.0 END AS usage_cross_up_40,
    CASE WHEN u <= 40 AND p > 40 THEN 1.0 ELSE 0.0 END AS usage_cross_down_40 FROM x""",
)
def w3(spark, d):
    return rows(spark, d, f.cross_flags, before=1)


FILLED_SQL = f"""{S}, filled AS (SELECT *, last_value(temp_celsius IGNORE NULLS) OVER w AS temp_f,
  last_value(freq_mhz IGNORE NULLS) OVER w / 1000.0 AS ghz FROM samples WINDOW w AS {W})"""


@query(
    "w4_thermal_slope", f"{ID}, ~temp_celsius_slope",
    f"""WITH {FILLED_SQL} SELECT {ID}, (temp_f - lag(temp_f, 30) OVER w) / 30.0 AS temp_celsius_slope FROM filled WINDOW w AS {W}""",
)
def w4(spark, d):
    src = f.filled(b.samples(spark, d), b.SAMPLES, ["temp_celsius"])
    stage = lambda w: {"temp_celsius_slope": f.delta("temp_celsius_f", 30, w) / 30.0}
    return by_rows(src, b.SAMPLES, stage, before=30, row_number="rn")


@query(
    "w5_procs_slope", f"{ID}, procs_running, ~procs_slope",
    f"WITH {S} SELECT {ID}, procs_running, (procs_running - lag(procs_running, 3) OVER w) / 3 AS procs_slope FROM samples WINDOW w AS {W}",
)
def w5(spark, d):
    return rows(spark, d, f.procs_features, before=3)


FEATURE_SQL = f"""{FILLED_SQL},
phys AS (SELECT *, ghz * ghz * usage_percent AS freq_sq_x_usage, ghz * ghz * ghz AS freq_cubed, ghz * usage_percent AS freq_x_usage,
  nr_running - lag(nr_running) OVER w AS nr_d1, row_number() OVER w AS rn FROM filled WINDOW w AS {W}),
feat AS (SELECT *, nr_running - lag(nr_running, 3) OVER w AS nr_running_d3, temp_f AS temp_celsius_level,
  temp_f - lag(temp_f, 3) OVER w AS temp_celsius_d3,
  (freq_sq_x_usage - lag(freq_sq_x_usage, 30) OVER w) / 30 AS freq_sq_x_usage_slope30,
  (freq_cubed - lag(freq_cubed, 30) OVER w) / 30 AS freq_cubed_slope30,
  CASE WHEN count(nr_d1) OVER r30 = 30 THEN stddev_samp(nr_d1) OVER r30 END AS nr_running_jerk,
  CASE WHEN count(nr_running) OVER r30 = 30 THEN stddev_samp(nr_running) OVER r30 / (avg(nr_running) OVER r30 + 1e-6) END AS nr_running_cv,
  CASE WHEN count(nr_running) OVER r30 = 30 THEN max(nr_running) OVER r30 / (avg(nr_running) OVER r30 + 1e-6) END AS nr_running_peak_to_mean
  FROM phys WINDOW w AS {W}, r30 AS (PARTITION BY server ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""


@query(
    "w6_upstream_levels", f"{ID}, nr_running, ~nr_running_d3, ~temp_celsius, ~temp_celsius_d3",
    f"WITH {FEATURE_SQL} SELECT {ID}, nr_running, nr_running_d3, temp_celsius_level AS temp_celsius, temp_celsius_d3 FROM feat",
)
def w6(spark, d):
    return f.feature_frame(b.samples(spark, d), b.SAMPLES, upstream=True)[0]


@query(
    "w7_dvfs_physics", f"{ID}, ~freq_sq_x_usage, ~freq_cubed, ~freq_x_usage, ~freq_sq_x_usage_slope30, ~freq_cubed_slope30",
    f"WITH {FEATURE_SQL} SELECT * FROM feat",
)
def w7(spark, d):
    return f.feature_frame(b.samples(spark, d), b.SAMPLES, upstream=True)[0]


@query("w8_runqueue_jerk", f"{ID}, ~nr_running_jerk", f"WITH {FEATURE_SQL} SELECT * FROM feat")
def w8(spark, d):
    src = number_rows(b.samples(spark, d), b.SAMPLES, "rn")
    first = lambda w: {"d1": f.delta("nr_running", 1, w)}
    second = lambda w: {"nr_running_jerk": f.rolling_std(w, "d1", 30)}
    return by_rows(src, b.SAMPLES, first, second, before=31, row_number="rn")


@query("w9_rolling_shape", f"{ID}, ~nr_running_cv, ~nr_running_peak_to_mean", f"WITH {FEATURE_SQL} SELECT * FROM feat")
def w9(spark, d):
    def stage(w):
        cv, peak = f.rolling_shape(w, "nr_running", 30, 1e-6)
        return {"nr_running_cv": cv, "nr_running_peak_to_mean": peak}

    return rows(spark, d, stage, before=29)


@query(
    "w10_hawkes_intensity", f"{ID}, ~hawkes",
    f"""WITH {S}, m AS (SELECT {ID}, row_number() OVER w AS rn, coalesce(greatest(nr_running - lag(nr_running) OVER w, 0.0), 0.0) AS mark
      FROM samples WINDOW w AS {W})
    SELECT a.server, a.event_id, sum(c.mark * exp(-(a.rn - c.rn) / 35.0)) AS hawkes
    FROM m a JOIN m c ON a.server = c.server AND c.rn <= a.rn GROUP BY 1, 2""",
)
def w10(spark, d):
    return f.with_hawkes(b.samples(spark, d), b.SAMPLES, "nr_running", "hawkes")


def ewma_sql(src: str, col: str, span: int, part: str = "server", out: str = "ewma") -> str:
    """Adjusted EWMA by weighted self-join; ``src`` has rn and ``col``."""
    a = f"(1 - 2.0 / ({span} + 1))"
    on = " AND ".join(f"a.{k} = c.{k}" for k in part.split(", "))
    keys = ", ".join(f"a.{k}" for k in part.split(", "))
    return f"""{out}_s AS (SELECT {keys}, a.rn, any_value(a.{col}) AS x, sum(pow({a}, a.rn - c.rn)) AS w,
      sum(pow({a}, 2 * (a.rn - c.rn))) AS ww, sum(pow({a}, a.rn - c.rn) * c.{col}) AS wx
      FROM {src} a JOIN {src} c ON {on} AND c.rn <= a.rn AND c.{col} IS NOT NULL GROUP BY {keys}, a.rn),
    {out}_v AS (SELECT {keys}, a.rn, any_value(a.x) AS x, any_value(a.wx / a.w) AS mean, any_value(a.w) AS w, any_value(a.ww) AS ww,
      sum(pow({a}, a.rn - c.rn) * (c.{col} - a.wx / a.w) * (c.{col} - a.wx / a.w)) AS ss
      FROM {out}_s a JOIN {src} c ON {on} AND c.rn <= a.rn AND c.{col} IS NOT NULL GROUP BY {keys}, a.rn),
    {out} AS (SELECT {part}, rn, mean, CASE WHEN w * w - ww > 1e-9 * w * w THEN sqrt(ss / w * w * w / (w * w - ww)) END AS std,
      CASE WHEN w * w - ww > 1e-9 * w * w AND ss > 0 THEN (x - mean) / sqrt(ss / w * w * w / (w * w - ww)) END AS z FROM {out}_v)"""


RN_SQL = f"{S}, n AS (SELECT *, row_number() OVER w AS rn, power_watts - lag(power_watts) OVER w AS d1 FROM samples WINDOW w AS {W})"
EWMA_SQL = f"{RN_SQL}, {ewma_sql('n', 'power_watts', 30)}"


@query(
    "w11_ewma_z", f"{ID}, ~ewma_mean, ~ewma_std, ~ewma_z",
    f"WITH {EWMA_SQL} SELECT n.server, n.event_id, mean AS ewma_mean, std AS ewma_std, z AS ewma_z FROM n JOIN ewma USING (server, rn)",
)
def w11(spark, d):
    return f.with_ewma(b.samples(spark, d), b.SAMPLES, "power_watts")


@query(
    "w12_ewma_flags", f"{ID}, ~ewma_z",
    f"WITH {EWMA_SQL} SELECT n.server, n.event_id, z AS ewma_z FROM n JOIN ewma USING (server, rn) WHERE abs(z) > 3",
)
def w12(spark, d):
    return f.ewma_flags(b.samples(spark, d), b.SAMPLES, "power_watts")


SPIKE_SQL = f"""{EWMA_SQL}, spikes AS (SELECT n.*, z,
  CASE WHEN d1 > 97 OR z > 3 THEN 1 ELSE 0 END AS spike_rise, CASE WHEN d1 < -97 OR z < -3 THEN 1 ELSE 0 END AS spike_drop,
  CASE WHEN abs(d1) > 97 OR abs(z) > 3 THEN 1 ELSE 0 END AS spike_both FROM n JOIN ewma USING (server, rn))"""


@query("w13_signed_spikes", f"{ID}, ~d1, spike_rise, spike_drop, spike_both", f"WITH {SPIKE_SQL} SELECT * FROM spikes")
def w13(spark, d):
    return f.with_spikes(b.samples(spark, d), b.SAMPLES)


@query(
    "w14_horizon_label", f"{ID}, label",
    f"""WITH {SPIKE_SQL} SELECT {ID}, coalesce(max(spike_both) OVER (PARTITION BY server ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS label
    FROM spikes""",
)
def w14(spark, d):
    return f.with_label(b.samples(spark, d), b.SAMPLES)


@query(
    "spike_rate_by_server", "server, n_rows, n_events, n_rises, ~event_rate, ~label_rate",
    f"""WITH {SPIKE_SQL}, l AS (SELECT *, coalesce(max(spike_both) OVER (PARTITION BY server ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS label FROM spikes)
    SELECT server, count(*) AS n_rows, sum(spike_both) AS n_events, sum(spike_rise) AS n_rises, avg(spike_both) AS event_rate, avg(label) AS label_rate
    FROM l GROUP BY 1""",
)
def spike_rate(spark, d):
    spikes = f.with_spikes(b.samples(spark, d), b.SAMPLES, row_number="rn")
    stage = lambda w: {"label": f.horizon_label(w, "spike_both")}
    lab = by_rows(spikes, b.SAMPLES, stage, after=5, row_number="rn")
    return lab.groupBy("server").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("spike_both").alias("n_events"),
        F.sum("spike_rise").alias("n_rises"), F.avg("spike_both").alias("event_rate"),
        F.avg("label").alias("label_rate"),
    )


def onset_sql(z: str, step: float, gap: int, src: str = "n", extra: str = "TRUE", name: str = "onset") -> str:
    """Greedy thinned onsets by recursion; ``src`` has server, rn, ts and ``z``."""
    return f"""{name}_c AS (SELECT * FROM (SELECT server, rn, ts, {z} AS z, lead({z}) OVER o AS z_next, lead(ts) OVER o AS onset_ts FROM {src}
        WINDOW o AS (PARTITION BY server ORDER BY rn)) WHERE rn >= 3 AND z_next - z > {step} AND {extra}),
    {name}_k AS (SELECT server, min(rn) AS rn FROM {name}_c GROUP BY 1
      UNION ALL SELECT k.server, min(c.rn) FROM {name}_k k JOIN {name}_c c ON c.server = k.server AND c.rn > k.rn + {gap} GROUP BY k.server, k.rn),
    {name} AS (SELECT c.* FROM {name}_c c JOIN {name}_k USING (server, rn))"""


@query(
    "w15_onset_label", f"{ID}, label",
    f"""WITH RECURSIVE {RN_SQL}, {onset_sql('power_watts', 25, 5)},
    l AS (SELECT n.*, CASE WHEN o.rn IS NULL THEN 0 ELSE 1 END AS landed FROM n LEFT JOIN onset o ON o.server = n.server AND o.rn + 1 = n.rn)
    SELECT {ID}, coalesce(max(landed) OVER (PARTITION BY server ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), 0) AS label FROM l""",
)
def w15(spark, d):
    return e.hf_label(b.samples(spark, d), b.SAMPLES, "power_watts", 10, 25.0, 5)


@query(
    "w16_hf_features", f"{ID}, nr_lag0, nr_lag5, nr_lag10, ~nr_d10, ~nr_d30, ~procs_running_d30",
    f"""WITH {S} SELECT {ID}, nr_running AS nr_lag0, lag(nr_running, 5) OVER w AS nr_lag5, lag(nr_running, 10) OVER w AS nr_lag10,
    nr_running - lag(nr_running, 10) OVER w AS nr_d10, nr_running - lag(nr_running, 30) OVER w AS nr_d30,
    procs_running - lag(procs_running, 30) OVER w AS procs_running_d30 FROM samples WINDOW w AS {W}""",
)
def w16(spark, d):
    return rows(spark, d, lambda w: f.hf_features(w, ["procs_running"]), before=30)


@query(
    "w17_precursor_candidates", f"{ID}, ~rolling_cv, ~rolling_peak_to_mean, ~ewma_z, ~usage_slope_per_s, ~temp_celsius_slope, ~3power_resid",
    f"""WITH {EWMA_SQL}, f AS (SELECT n.*, z, last_value(temp_celsius IGNORE NULLS) OVER w AS temp_f,
      last_value(freq_mhz IGNORE NULLS) OVER w / 1000.0 AS ghz FROM n JOIN ewma USING (server, rn) WINDOW w AS (PARTITION BY server ORDER BY rn)),
    q AS (SELECT *, ghz * ghz * usage_percent AS fsq FROM f), m AS (SELECT server, avg(power_watts) AS mp, avg(fsq) AS mq FROM q GROUP BY 1)
    SELECT {ID}, CASE WHEN count(*) OVER r = 30 THEN stddev_samp(power_watts) OVER r / avg(power_watts) OVER r END AS rolling_cv,
    CASE WHEN count(*) OVER r = 30 THEN max(power_watts) OVER r / avg(power_watts) OVER r END AS rolling_peak_to_mean, z AS ewma_z,
    (usage_percent - lag(usage_percent, 30) OVER w) / 30 AS usage_slope_per_s, (temp_f - lag(temp_f, 30) OVER w) / 30 AS temp_celsius_slope,
    power_watts - mp / greatest(mq, 1e-9) * fsq AS power_resid
    FROM q JOIN m USING (server) WINDOW w AS (PARTITION BY server ORDER BY rn), r AS (PARTITION BY server ORDER BY rn ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
)
def w17(spark, d):
    return f.candidate_features(b.samples(spark, d), b.SAMPLES)[0]


@query(
    "w18_upstream_candidates", f"{ID}, ~nr_running_slope, ~nr_running_jerk, ~nr_running_cv, ~temp_celsius_slope, ~procs_running_slope",
    f"""WITH {FEATURE_SQL} SELECT {ID}, (nr_running - lag(nr_running, 30) OVER w) / 30 AS nr_running_slope, nr_running_jerk, nr_running_cv,
    (temp_f - lag(temp_f, 30) OVER w) / 30 AS temp_celsius_slope, (procs_running - lag(procs_running, 30) OVER w) / 30 AS procs_running_slope
    FROM feat WINDOW w AS (PARTITION BY server ORDER BY rn)""",
)
def w18(spark, d):
    return f.upstream_candidates(b.samples(spark, d), b.SAMPLES)[0]


GAP_S = 172_800.0
SEG_SQL = f"""{S}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 172800000000 THEN 1 ELSE 0 END AS brk FROM samples WINDOW w AS {W}),
seg AS (SELECT *, sum(brk) OVER w AS segment FROM g WINDOW w AS {W}),
long_seg AS (SELECT *, count(*) OVER (PARTITION BY server, segment) AS c FROM seg),
sn AS (SELECT *, row_number() OVER w AS rn, power_watts - lag(power_watts) OVER w AS d1 FROM long_seg WHERE c >= 15
  WINDOW w AS (PARTITION BY server, segment ORDER BY ts, event_id)),
sj AS (SELECT *, CASE WHEN count(d1) OVER r = 8 THEN stddev_samp(d1) OVER r END AS jerk FROM sn
  WINDOW r AS (PARTITION BY server, segment ORDER BY rn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
sh AS (SELECT a.server, a.segment, a.rn, sum(greatest(coalesce(c.d1, 0), 0) * exp(-(a.rn - c.rn) * 0.1 / 2.0)) AS hawkes
  FROM sj a JOIN sj c ON a.server = c.server AND a.segment = c.segment AND c.rn <= a.rn GROUP BY 1, 2, 3),
sf AS (SELECT sj.*, hawkes FROM sj JOIN sh USING (server, segment, rn))"""


@query(
    "w19_segment_features", f"{ID}, segment, ~p_z, ~j_z, ~h_z",
    f"""WITH {SEG_SQL}, {ewma_sql('sf', 'power_watts', 20, 'server, segment', 'ep')}, {ewma_sql('sf', 'jerk', 20, 'server, segment', 'ej')},
    {ewma_sql('sf', 'hawkes', 20, 'server, segment', 'eh')}
    SELECT sf.server, sf.event_id, sf.segment, ep.z AS p_z, ej.z AS j_z, eh.z AS h_z FROM sf
    LEFT JOIN ep USING (server, segment, rn) LEFT JOIN ej USING (server, segment, rn) LEFT JOIN eh USING (server, segment, rn)""",
)
def w19(spark, d):
    return f.segment_features(
        b.samples(spark, d), b.SAMPLES, GAP_S, 15, 20, 8, 2.0, 0.1, "power_watts", "power_watts"
    )


@query(
    "w20_max_ramp", "server, ~up_per_day, ~down_per_day",
    f"""WITH {S}, r AS (SELECT server, (lead(power_watts, 5) OVER w - power_watts) / ((epoch_us(lead(ts, 5) OVER w) - epoch_us(ts)) / 1e6) AS ramp
      FROM samples WINDOW w AS {W})
    SELECT server, max(ramp) * 86400 AS up_per_day, min(ramp) * 86400 AS down_per_day FROM r GROUP BY 1""",
)
def w20(spark, d):
    out = f.max_ramp(b.samples(spark, d), b.SAMPLES, "power_watts", 5)
    return out.withColumns({"up_per_day": F.col("max_up") * b.DAY, "down_per_day": F.col("max_down") * b.DAY})


@query(
    "w21_ramp_rate", "server, ~rate_per_day",
    f"""WITH {S}, a AS (SELECT server, ts, abs(power_watts - lag(power_watts) OVER w) AS da FROM samples WINDOW w AS {W}),
    r AS (SELECT server, sum(da) OVER (PARTITION BY server ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW) AS s FROM a)
    SELECT server, max(s) AS rate_per_day FROM r GROUP BY 1""",
)
def w21(spark, d):
    out = f.ramp_rate(b.samples(spark, d), b.SAMPLES, "power_watts", b.DAY)
    return out.withColumn("rate_per_day", F.col("ramp_rate") * b.DAY)


DAY_FRAME = "(PARTITION BY server ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)"


@query(
    "w22_least_squares_slope", f"{ID}, ~4slope_per_day",
    f"""WITH {S}, x AS (SELECT *, epoch_us(ts) / 86400e6 - 19723 AS dx FROM samples)
    SELECT {ID}, CASE WHEN count(*) OVER r >= 3 AND dx - min(dx) OVER r >= 0.6 THEN coalesce(regr_slope(power_watts, dx) OVER r, 0) ELSE 0 END AS slope_per_day
    FROM x WINDOW r AS {DAY_FRAME}""",
)
def w22(spark, d):
    out = f.slope_feature(b.samples(spark, d), b.SAMPLES, "power_watts", b.DAY)
    return out.withColumn("slope_per_day", F.col("deriv_w_s") * b.DAY)


@query(
    "w23_idle_baseline", f"{ID}, ~baseline_w",
    f"""WITH {S}, x AS (SELECT {ID}, list_sort(list(power_watts) OVER r) AS l FROM samples
      WINDOW r AS (PARTITION BY server ORDER BY ts RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND CURRENT ROW))
    SELECT {ID}, CASE WHEN len(l) < 10 THEN 225.0 ELSE least(l[CAST(len(l) // 10 + 1 AS INT)], 8.0) END AS baseline_w FROM x""",
)
def w23(spark, d):
    return f.idle_baseline(b.samples(spark, d), b.SAMPLES, "power_watts", 5 * b.DAY, 10, clamp=8.0)


@query(
    "w24_despike_median", f"{ID}, ~despiked_w",
    f"""WITH {S}, z AS (SELECT *, round(power_watts / 60, 0) AS pq FROM samples), x AS (SELECT *, lag(pq) OVER w AS p FROM z WINDOW w AS {W}),
    c AS (SELECT *, list_sort(list(pq) OVER (PARTITION BY server ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS l
      FROM x WHERE p IS NULL OR p <> pq)
    SELECT x.server, x.event_id, last_value(c.l[CAST(len(c.l) // 2 + 1 AS INT)] IGNORE NULLS) OVER (PARTITION BY x.server ORDER BY x.ts, x.event_id) AS despiked_w
    FROM x LEFT JOIN c USING (server, event_id)""",
)
def w24(spark, d):
    src = b.samples(spark, d).withColumn("pq", F.round(F.col("power_watts") / 60, 0))
    return f.despike(src, b.SAMPLES, "pq")


FIT_SQL = f"""{S}, fit AS (SELECT *, CASE WHEN ok THEN a END AS fit_alpha, CASE WHEN ok THEN i END AS fit_idle FROM (
  SELECT *, count(*) OVER r >= 6 AND var_pop(usage_percent) OVER r >= 50 AS ok, regr_slope(power_watts, usage_percent) OVER r AS a,
    regr_intercept(power_watts, usage_percent) OVER r AS i FROM samples
  WINDOW r AS (PARTITION BY server ORDER BY ts RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW)))"""


def fitted(spark, d):
    return f.rolling_fit(b.samples(spark, d), b.SAMPLES, "power_watts", "usage_percent", 3 * b.DAY, 6, 50.0)


@query("w25_rolling_fit", f"{ID}, ~fit_alpha, ~fit_idle", f"WITH {FIT_SQL} SELECT * FROM fit")
def w25(spark, d):
    return fitted(spark, d)


@query(
    "w26_stale_blend", f"{ID}, ~estimated_w",
    f"""WITH {FIT_SQL}, z AS (SELECT *, round(power_watts / 60, 0) AS pq FROM fit), x AS (SELECT *, lag(pq) OVER w AS p FROM z WINDOW w AS {W}),
    s AS (SELECT *, epoch_us(ts) - last_value(CASE WHEN p IS NULL OR p <> pq THEN epoch_us(ts) END IGNORE NULLS) OVER w AS us FROM x WINDOW w AS {W}),
    m AS (SELECT *, us / 1e6 AS age, greatest(0.0, fit_idle + fit_alpha * usage_percent) AS model FROM s)
    SELECT {ID}, CASE WHEN fit_alpha IS NULL OR age <= 21600 THEN pq
      ELSE pq * (1 - least(1.0, (age - 21600) / 21600)) + model * least(1.0, (age - 21600) / 21600) END AS estimated_w FROM m""",
)
def w26(spark, d):
    src = fitted(spark, d).withColumn("pq", F.round(F.col("power_watts") / 60, 0))
    return f.stale_blend(src, b.SAMPLES, "pq", "usage_percent", 21_600.0)


@query(
    "w27_cliff_arm", f"{ID}, ~drop_w, trigger",
    f"""WITH {S}, x AS (SELECT *, first_value(power_watts) OVER r AS p0, epoch_us(ts) - epoch_us(first_value(ts) OVER r) AS us, max(power_watts) OVER r - power_watts AS drop_w,
      avg(usage_percent) OVER r AS mu FROM samples WINDOW r AS (PARTITION BY server ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW))
    SELECT {ID}, drop_w, CASE WHEN us > 0 AND drop_w > 5 AND mu < 60 THEN CASE WHEN (power_watts - p0) / (us / 1e6) <= -0.0004 THEN 'rate'
      WHEN drop_w > 60 THEN 'delta' END END AS trigger FROM x""",
)
def w27(spark, d):
    return f.cliff_arm(b.samples(spark, d), b.SAMPLES, "power_watts", "usage_percent", 2 * b.DAY, -0.0004, 60.0, 5.0, 60.0)


@query(
    "w28_edge_score", f"{ID}, score",
    f"""WITH {S} SELECT {ID}, CASE WHEN lag(1, 20) OVER w = 1 THEN greatest(nr_running - lag(nr_running, 10) OVER w, nr_running - lag(nr_running, 20) OVER w, 0.0) END AS score
    FROM samples WINDOW w AS {W}""",
)
def w28(spark, d):
    return rows(spark, d, lambda w: {"score": f.edge_score(w, "nr_running", 10, 20)}, before=20)


RANK_SQL = f"""{RN_SQL}, thr AS (SELECT {ID}, ts, rn, CASE WHEN count(*) OVER r >= 10 THEN greatest(quantile_cont(nr_running, 0.8) OVER r, 6.0) ELSE 6.0 END AS t
  FROM n WINDOW r AS (PARTITION BY server ORDER BY rn ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING))"""


@query("w29_rank_threshold", f"{ID}, ~threshold", f"WITH {RANK_SQL} SELECT {ID}, t AS threshold FROM thr")
def w29(spark, d):
    return f.rank_threshold(b.samples(spark, d), b.SAMPLES, "nr_running", 25, 0.8, 6.0, 10)


@query(
    "w29_rank_threshold_refreshed", f"{ID}, ~threshold",
    f"""WITH {RANK_SQL} SELECT {ID}, last_value(CASE WHEN (rn - 1) % 5 = 0 THEN t END IGNORE NULLS) OVER (PARTITION BY server ORDER BY rn) AS threshold FROM thr""",
)
def w29b(spark, d):
    return f.rank_threshold(b.samples(spark, d), b.SAMPLES, "nr_running", 25, 0.8, 6.0, 10, every=5)


@query("w30_capped_threshold", f"{ID}, ~threshold")
def w30(spark, d):
    src = b.samples(spark, d).withColumn("score", F.col("usage_percent") / 100)
    return f.capped_threshold(src, b.SAMPLES, "score", 0.35, 10 * b.DAY, b.DAY, 10, slice_width=15 * b.DAY)


LAG_SQL = f"""{S}, lags AS (SELECT {ID}, power_watts AS p0, lag(power_watts) OVER w AS p1, lag(power_watts, 2) OVER w AS p2, lag(power_watts, 3) OVER w AS p3,
  usage_percent AS u0, lag(usage_percent) OVER w AS u1, lag(usage_percent, 2) OVER w AS u2, lag(usage_percent, 3) OVER w AS u3 FROM samples WINDOW w AS {W})"""


@query(
    "w31_idle_mask", f"{ID}, idle",
    f"WITH {LAG_SQL} SELECT {ID}, coalesce(u0 < 30 AND greatest(p0, p1, p2, p3) - least(p0, p1, p2, p3) < 45, FALSE) AS idle FROM lags",
)
def w31(spark, d):
    return rows(spark, d, f.lag_features, before=3).withColumn("idle", f.idle_mask(30.0, 45.0))


@query(
    "w32_usage_idle_gate", f"{ID}, gate",
    f"WITH {LAG_SQL} SELECT {ID}, coalesce(greatest(u0, u1, u2, u3) <= 60 AND greatest(u0, u1, u2, u3) - least(u0, u1, u2, u3) <= 40, FALSE) AS gate FROM lags",
)
def w32(spark, d):
    return rows(spark, d, f.lag_features, before=3).withColumn("gate", f.usage_idle_gate(60.0, 40.0))


@query(
    "w33_signed_power_state", f"{ID}, ~power_delta, rise_now, drop_now, direction",
    f"""WITH {LAG_SQL} SELECT {ID}, p0 - p1 AS power_delta, CASE WHEN p0 - p1 > 97 THEN 1 ELSE 0 END AS rise_now, CASE WHEN p0 - p1 < -97 THEN 1 ELSE 0 END AS drop_now,
    CASE WHEN p0 - p1 > 97 THEN 1 WHEN p0 - p1 < -97 THEN -1 ELSE 0 END AS direction FROM lags""",
)
def w33(spark, d):
    return rows(spark, d, f.lag_features, before=3).withColumns(f.signed_state())


@query("w34_peak_hold", f"{ID}, ~peak_w", f"WITH {S} SELECT {ID}, max(power_watts) OVER r AS peak_w FROM samples WINDOW r AS {DAY_FRAME}")
def w34(spark, d):
    return f.peak_hold(b.samples(spark, d), b.SAMPLES, "power_watts", b.DAY)


KALMAN_SQL = f"""{RN_SQL}, kf AS (SELECT server, event_id, rn, power_watts AS z, power_watts AS lvl, 0.0::DOUBLE AS slp, 1000.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 1000.0::DOUBLE AS p11,
    0.0::DOUBLE AS innov, TRUE AS seed FROM n WHERE rn = 1
  UNION ALL SELECT server, event_id, rn, z, m0 + a00 / s * (z - m0), m1 + a01 / s * (z - m0), (1 - a00 / s) * a00, (1 - a00 / s) * a01, a11 - a01 / s * a01, z - m0, FALSE FROM (
    SELECT *, a00 + 5.0 AS s FROM (SELECT n.server, n.event_id, n.rn, n.power_watts AS z, k.lvl + k.slp AS m0, k.slp AS m1,
      k.p00 + 2 * k.p01 + k.p11 + 0.1 / 3 AS a00, k.p01 + k.p11 + 0.05 AS a01, k.p11 + 0.1 AS a11
      FROM kf k JOIN n ON n.server = k.server AND n.rn = k.rn + CASE WHEN k.seed THEN 0 ELSE 1 END)))"""


@query(
    "w35_kalman_fixed", f"{ID}, ~level, ~slope, ~pred_next",
    f"WITH RECURSIVE {KALMAN_SQL} SELECT {ID}, lvl AS level, slp AS slope, lvl + slp AS pred_next FROM kf WHERE NOT seed",
)
def w35(spark, d):
    return f.kalman(b.samples(spark, d), b.SAMPLES, "power_watts")


@query("w35_kalman_adaptive", f"{ID}, ~level, ~slope, ~pred_next, ~innov")
def w35b(spark, d):
    return f.kalman(b.samples(spark, d), b.SAMPLES, "power_watts", adapt=True, slice_width=15 * b.DAY)


SLEW_SQL = f"""{RN_SQL}, slew AS (SELECT server, event_id, rn, power_watts AS y FROM n WHERE rn = 1
  UNION ALL SELECT n.server, n.event_id, n.rn, CASE WHEN power_watts > y THEN least(y + 10, power_watts) ELSE greatest(y - 15, power_watts) END
  FROM slew s JOIN n ON n.server = s.server AND n.rn = s.rn + 1)"""


@query("w36_slew_limit", f"{ID}, ~limited", f"WITH RECURSIVE {SLEW_SQL} SELECT {ID}, y AS limited FROM slew")
def w36(spark, d):
    return f.slew_limit(b.samples(spark, d), b.SAMPLES, "power_watts", 10.0, 15.0)


@query(
    "w37_feature_matrix", f"{ID}, label, ~power_lag3, ~usage_slope3, usage_cross_up_20, ~temp_celsius_slope, ~freq_cubed_slope30, ~nr_running_jerk, ~nr_running_cv",
    f"""WITH {SPIKE_SQL}, l AS (SELECT *, coalesce(max(spike_both) OVER (PARTITION BY server ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS label FROM spikes),
    x AS (SELECT *, lag(power_watts, 3) OVER w AS power_lag3, (usage_percent - lag(usage_percent, 3) OVER w) / 3 AS usage_slope3,
      CASE WHEN usage_percent >= 20 AND lag(usage_percent) OVER w < 20 THEN 1.0 ELSE 0.0 END AS usage_cross_up_20,
      last_value(temp_celsius IGNORE NULLS) OVER w AS temp_f, last_value(freq_mhz IGNORE NULLS) OVER w / 1000.0 AS ghz, nr_running - lag(nr_running) OVER w AS nd
      FROM l WINDOW w AS (PARTITION BY server ORDER BY rn)),
    y AS (SELECT *, (temp_f - lag(temp_f, 30) OVER w) / 30 AS temp_celsius_slope, (ghz * ghz * ghz - lag(ghz * ghz * ghz, 30) OVER w) / 30 AS freq_cubed_slope30,
      CASE WHEN count(nd) OVER r = 30 THEN stddev_samp(nd) OVER r END AS nr_running_jerk, stddev_samp(nr_running) OVER r / (avg(nr_running) OVER r + 1e-6) AS nr_running_cv
      FROM x WINDOW w AS (PARTITION BY server ORDER BY rn), r AS (PARTITION BY server ORDER BY rn ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
    SELECT * FROM y WHERE temp_celsius_slope IS NOT NULL AND freq_cubed_slope30 IS NOT NULL AND nr_running_jerk IS NOT NULL""",
)
def w37(spark, d):
    return f.build_xy(b.samples(spark, d), b.SAMPLES, upstream=True)[0]


@query("w38_trivial_score", f"{ID}, ~trivial", f"WITH {RN_SQL} SELECT {ID}, abs(d1) AS trivial FROM n")
def w38(spark, d):
    return f.trivial_score(b.samples(spark, d), b.SAMPLES)


@query(
    "w39_persistence_errors", "server, ~rmse, ~mae",
    f"WITH {RN_SQL} SELECT server, sqrt(avg(d1 * d1)) AS rmse, avg(abs(d1)) AS mae FROM n GROUP BY 1",
)
def w39(spark, d):
    return f.persistence_errors(b.samples(spark, d), b.SAMPLES, "power_watts")


@query(
    "w40_noise_reduction", "server, ~raw_std, ~filtered_std, ~ratio",
    f"""WITH RECURSIVE {SLEW_SQL}, d AS (SELECT n.server, n.rn, n.d1 AS dz, y - lag(y) OVER (PARTITION BY n.server ORDER BY n.rn) AS dl FROM n JOIN slew USING (server, rn)),
    c AS (SELECT server, rn, CASE WHEN count(dz) OVER f = 12 THEN avg(abs(dz)) OVER f END AS calm FROM d WINDOW f AS (PARTITION BY server ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)),
    s AS (SELECT server, arg_min(rn, calm) AS s FROM c WHERE calm IS NOT NULL GROUP BY 1)
    SELECT d.server, stddev_pop(dz) AS raw_std, stddev_pop(dl) AS filtered_std, stddev_pop(dl) / nullif(stddev_pop(dz), 0) AS ratio
    FROM d JOIN s USING (server) WHERE rn > s AND rn < s + 12 GROUP BY 1""",
)
def w40(spark, d):
    src = b.samples(spark, d)
    lim = f.slew_limit(src, b.SAMPLES, "power_watts", 10.0, 15.0, name="level")
    both = src.join(lim, ["server", "ts", "event_id"])
    return f.noise_reduction(both, b.SAMPLES, "power_watts", "level", 12)


@query(
    "w41_transient_error", "server, ~transient_error",
    f"""WITH {RN_SQL}, k AS (SELECT server, rn, row_number() OVER (PARTITION BY server ORDER BY abs(d1) DESC, rn DESC) AS r FROM n WHERE d1 IS NOT NULL),
    w AS (SELECT server, unnest(generate_series(rn - 3, rn + 2)) AS rn FROM k WHERE r <= 5)
    SELECT w.server, avg(abs(d1)) AS transient_error FROM w JOIN n USING (server, rn) WHERE d1 IS NOT NULL GROUP BY 1""",
)
def w41(spark, d):
    src = b.samples(spark, d).withColumn("last", F.col("power_watts"))
    return f.transient_error(src, b.SAMPLES, "power_watts", "last", 5)


@query(
    "w42_noise_gate", f"{ID}, ~variance",
    f"""WITH {S} SELECT {ID}, CASE WHEN count(*) OVER r >= 20 THEN var_pop(power_watts) OVER r END AS variance FROM samples
    WINDOW r AS (PARTITION BY server ORDER BY ts, event_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)""",
)
def w42(spark, d):
    return rows(spark, d, lambda w: {"variance": f.noise_gate(w, "power_watts")}, before=39)


@query(
    "w43_quiescent", f"{ID}, resolved",
    f"""WITH {S}, x AS (SELECT *, epoch_us(ts) - last_value(CASE WHEN power_watts > 60 THEN epoch_us(ts) END IGNORE NULLS) OVER w AS q FROM samples WINDOW w AS {W})
    SELECT {ID}, power_watts <= 60 AND coalesce(q >= 43200000000, TRUE) AS resolved FROM x""",
)
def w43(spark, d):
    src = b.samples(spark, d).withColumn("base", F.lit(20.0))
    return f.quiescent(src, b.SAMPLES, "power_watts", "base", 40.0, 43_200.0)
