"""Queries over power traces and the experiment matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe import bindings as b
from wattframe.catalog import query
from wattframe.catalog.grid import resample_sql
from wattframe.operators import grid as g
from wattframe.operators import matrix as mx
from wattframe.operators import risk as r
from wattframe.series import Series

KEYS = "run, workload, arm"
T = b.TRACES_SQL
K = "PARTITION BY run, workload, arm ORDER BY time_s"
YEAR = 365.25 * 24 * 3600
LOADED = Series(("run", "workload", "arm", "n_servers"), "time_s", (), 45 * b.DAY)

ENERGY_SQL = f"""{T}, st AS (SELECT *, lag(time_s) OVER w AS t0, lag(power_W) OVER w AS p0 FROM traces WINDOW w AS ({K})),
  en AS (SELECT run, workload, arm, coalesce(sum((time_s - t0) * (power_W + p0) / 2), 0.0) AS energy_j, max(time_s) - min(time_s) AS duration_s, avg(power_W) AS mean_w, min(power_W) AS min_w, max(power_W) AS max_w
    FROM st GROUP BY 1, 2, 3)"""


@query("g1_trace_energy", f"{KEYS}, ~2energy_j, ~duration_s, ~mean_w, ~min_w, ~max_w", f"WITH {ENERGY_SQL} SELECT * FROM en")
def g1(spark, d):
    return r.energy(b.traces(spark, d), b.TRACES)


def gridded(spark, d):
    return g.resample(b.traces(spark, d), b.TRACES, "power_W", 21_600.0).withColumn("P_W", F.col("power_W") * 1e6)


GRID_SQL = f"""{T}, {resample_sql(21600.0)}, gs AS (SELECT *, power_W * 1e6 AS P_W, lag(power_W * 1e6) OVER w AS p0, lag(time_s) OVER w AS t0 FROM grid WINDOW w AS ({K})),
  ex AS (SELECT *, time_s - t0 AS dt, greatest(abs((P_W - p0) / 1e6 / (time_s - t0)) - 0.002, 0.0) AS excess FROM gs),
  rk AS (SELECT run, workload, arm, count(*) FILTER (excess > 0) AS n, coalesce(sum(excess * dt), 0.0) AS nrs, max(time_s) - min(time_s) AS span, max(P_W) AS mx, avg(P_W) AS mean, stddev_pop(P_W) AS sd, sum(dt * (P_W + p0) / 2) AS ej FROM ex GROUP BY 1, 2, 3)"""


@query(
    "g2_ramp_risk", f"{KEYS}, n_exceedances_in_trace, ~1rrei_exceedances_per_year, ~3nrs_MW_per_year, ~4lole_proxy_days_per_year, ~4lole_ratio, ~4cv, ~4peak_to_mean, ~1trace_duration_s",
    f"""WITH {GRID_SQL} SELECT run, workload, arm, n AS n_exceedances_in_trace, round_even(n * {YEAR} / nullif(span, 0), 1) AS rrei_exceedances_per_year, nrs * {YEAR} / nullif(span, 0) AS nrs_MW_per_year,
    n * {YEAR} / nullif(span, 0) * (mx / 1e6 / 10000 * 2) / 24 AS lole_proxy_days_per_year, n * {YEAR} / nullif(span, 0) * (mx / 1e6 / 10000 * 2) / 24 / 0.1 AS lole_ratio, sd / mean AS cv, mx / mean AS peak_to_mean, span AS trace_duration_s FROM rk""",
)
def g2(spark, d):
    return r.risk_metrics(gridded(spark, d), b.TRACES, "P_W", 0.002)


@query(
    "g3_frequency_metrics", f"{KEYS}, ~4freq_nadir_hz, ~4freq_nadir_deviation_hz, ~5rocof_per_day, ~1under_freq_events_per_year",
    f"""WITH {T}, f AS (SELECT *, (power_W - 250) / 313 AS df FROM traces), s AS (SELECT *, lag(df) OVER w AS d0, lag(time_s) OVER w AS t0 FROM f WINDOW w AS ({K}))
    SELECT run, workload, arm, 60 + min(df) AS freq_nadir_hz, min(df) AS freq_nadir_deviation_hz, round_even(max(abs((df - d0) / (time_s - t0))), 5) * 86400 AS rocof_per_day,
    count(*) FILTER (df < -0.4) * {YEAR} / nullif(max(time_s) - min(time_s), 0) AS under_freq_events_per_year FROM s GROUP BY 1, 2, 3""",
)
def g3(spark, d):
    dev = b.traces(spark, d).withColumn("delta_f_hz", (F.col("power_W") - 250) / 313)
    out = r.frequency_metrics(dev, b.TRACES, "delta_f_hz", -0.4)
    return out.withColumn("rocof_per_day", F.col("rocof_max_hz_per_s") * 86_400)


@query(
    "g4_voltage_metrics", f"{KEYS}, ~5min_voltage_pu, ~5voltage_sag_depth_pu, ~1voltage_sag_events_per_yr, ~5mean_voltage_pu",
    f"""WITH {T}, v AS (SELECT *, 1 - power_W / 5300 AS v FROM traces) SELECT run, workload, arm, min(v) AS min_voltage_pu, 1 - min(v) AS voltage_sag_depth_pu,
    count(*) FILTER (v < 0.95) * {YEAR} / nullif(max(time_s) - min(time_s), 0) AS voltage_sag_events_per_yr, avg(v) AS mean_voltage_pu FROM v GROUP BY 1, 2, 3""",
)
def g4(spark, d):
    return r.voltage_metrics(b.traces(spark, d).withColumn("v_pu", 1 - F.col("power_W") / 5300), b.TRACES)


@query(
    "g5_power_block", f"{KEYS}, ~4peak_MW, ~4mean_MW, ~1trace_energy_MJ",
    f"WITH {GRID_SQL} SELECT run, workload, arm, mx / 1e6 AS peak_MW, mean / 1e6 AS mean_MW, coalesce(ej, 0.0) / 1e6 AS trace_energy_MJ FROM rk",
)
def g5(spark, d):
    return r.power_block(gridded(spark, d), b.TRACES)


@query(
    "g6_efficiency", f"{KEYS}, ~4hpl_gflops_server, ~2fleet_tflops_sustained, ~6gflops_per_watt_server",
    f"""WITH {ENERGY_SQL} SELECT run, workload, arm, max_w / 3 AS hpl_gflops_server, max_w / 3 * 10 AS fleet_tflops_sustained, max_w / 3 / greatest(1.0, mean_w * 20000 / 1.35 / 10000 - 300) AS gflops_per_watt_server FROM en""",
)
def g6(spark, d):
    e = r.energy(b.traces(spark, d), b.TRACES)
    e = e.withColumns({"gflops": F.col("max_w") / 3, "facility_w": F.col("mean_w") * 20_000})
    return r.efficiency(e, "gflops", "facility_w")


CELL_SQL = f"""{ENERGY_SQL}, cell AS (SELECT e.*, c.cv FROM en e JOIN (SELECT run, workload, arm, stddev_pop(power_W) / avg(power_W) AS cv FROM traces GROUP BY 1, 2, 3) c USING (run, workload, arm)),
  lng AS (SELECT run, workload, arm, 'energy' AS metric, energy_j AS value FROM cell UNION ALL SELECT run, workload, arm, 'runtime', duration_s FROM cell
    UNION ALL SELECT run, workload, arm, 'cv', cv FROM cell UNION ALL SELECT run, workload, arm, 'peak', max_w / mean_w FROM cell),
  pct AS (SELECT s.run, s.workload, s.arm, s.metric, s.value, o.value AS value_base, (s.value / nullif(o.value, 0) - 1) * 100 AS pct FROM lng s JOIN lng o ON s.run = o.run AND s.workload = o.workload AND s.metric = o.metric AND o.arm = 'O' WHERE s.arm <> 'O'),
  prun AS (SELECT arm, metric, run, avg(pct) AS m FROM pct GROUP BY 1, 2, 3),
  brd AS (SELECT arm, metric, avg(m) AS mean, CASE WHEN count(m) > 1 THEN stddev_samp(m) WHEN count(m) = 1 THEN 0.0 END AS sd FROM prun GROUP BY 1, 2)"""


def cells(spark, d):
    """Long metric rows per trace: energy, runtime, cv, peak."""
    tr = b.traces(spark, d)
    key = list(b.TRACES.key)
    e = r.energy(tr, b.TRACES)
    cv = tr.groupBy(*key).agg((F.stddev_pop("power_W") / F.avg("power_W")).alias("cv"))
    flat = e.join(cv, key).select(
        *key, F.col("energy_j").alias("energy"), F.col("duration_s").alias("runtime"), "cv",
        (F.col("max_w") / F.col("mean_w")).alias("peak"),
    )
    return flat.unpivot(key, ["energy", "runtime", "cv", "peak"], "metric", "value")


@query("g7_percent_change", f"{KEYS}, metric, ~4pct", f"WITH {CELL_SQL} SELECT * FROM pct")
def g7(spark, d):
    return mx.pair_changes(cells(spark, d), "O")


@query(
    "g7_percent_of_magnitude", f"{KEYS}, metric, ~4pct",
    f"WITH {CELL_SQL} SELECT run, workload, arm, metric, 100 * (abs(value) - abs(value_base)) / nullif(abs(value_base), 0) AS pct FROM pct",
)
def g7b(spark, d):
    return mx.pair_changes(cells(spark, d), "O", magnitude=["cv"], sweep=True)


@query(
    "g8_pair_table", f"{KEYS}, metric, ~2value, ~2value_base, ~4pct",
    f"""WITH {ENERGY_SQL}, g AS MATERIALIZED (SELECT *, max_w / 3 AS gf FROM en), l AS MATERIALIZED (SELECT run, workload, arm, 'energy_j' AS metric, energy_j AS value FROM g UNION ALL SELECT run, workload, arm, 'runtime_s', duration_s FROM g
      UNION ALL SELECT run, workload, arm, 'gflops', gf FROM g UNION ALL SELECT run, workload, arm, 'gflops_per_W', gf / nullif(energy_j / nullif(duration_s, 0), 0) FROM g
      UNION ALL SELECT run, workload, arm, 'CV', round_even(c, 4) FROM (SELECT run, workload, arm, stddev_pop(power_W) / avg(power_W) AS c FROM traces GROUP BY 1, 2, 3)
      UNION ALL SELECT run, workload, arm, 'Peak-to-mean', round_even(c, 4) FROM (SELECT run, workload, arm, max(power_W) / avg(power_W) AS c FROM traces GROUP BY 1, 2, 3))
    SELECT s.run, s.workload, s.arm, s.metric, s.value, o.value AS value_base, (s.value / nullif(o.value, 0) - 1) * 100 AS pct FROM l s JOIN l o ON s.run = o.run AND s.workload = o.workload AND s.metric = o.metric AND o.arm = 'O' WHERE s.arm <> 'O'""",
)
def g8(spark, d):
    tr = b.traces(spark, d)
    key = list(b.TRACES.key)
    risk = r.risk_metrics(tr, b.TRACES, "power_W")
    docs = risk.select(*key, F.struct("cv", "peak_to_mean").alias("risk"))
    gf = tr.groupBy(*key).agg((F.max("power_W") / 3).alias("gflops"))
    fields = {"CV": "risk.cv", "Peak-to-mean": "risk.peak_to_mean"}
    return mx.pair_table(tr, docs, b.TRACES, "O", gf, fields)


@query("g9_two_level", "arm, metric, ~4mean, ~4sd", f"WITH {CELL_SQL} SELECT * FROM brd")
def g9(spark, d):
    return mx.two_level(mx.pair_changes(cells(spark, d), "O"), ["arm", "metric"], "pct")


@query(
    "g10_ranked_board", "rank, arm, ~1cv, ~1cv_sd, ~1energy, verdict",
    f"""WITH {CELL_SQL}, w AS (SELECT arm, round_even(max(mean) FILTER (metric = 'cv'), 1) AS cv, round_even(max(sd) FILTER (metric = 'cv'), 1) AS cv_sd, round_even(max(mean) FILTER (metric = 'energy'), 1) AS energy FROM brd GROUP BY 1),
    t AS (SELECT *, CASE WHEN cv_sd <> 0 THEN ' (+/-' || CAST(round_even(cv_sd, 0) AS BIGINT) || ')' ELSE '' END AS band FROM w)
    SELECT row_number() OVER (ORDER BY cv NULLS LAST, arm) AS rank, arm, cv, cv_sd, energy, CASE WHEN cv IS NULL THEN 'no data' WHEN cv <= -20 THEN 'strong smoothing: ' || CAST(round_even(-cv, 0) AS BIGINT) || '%' || band || ' less variability'
      WHEN cv <= -5 THEN 'modest smoothing: ' || CAST(round_even(-cv, 0) AS BIGINT) || '%' || band || ' less variability'
      WHEN cv < 5 THEN 'no measurable smoothing (' || CASE WHEN cv >= 0 THEN '+' ELSE '-' END || CAST(round_even(abs(cv), 0) AS BIGINT) || '%' || band || ')'
      ELSE 'WORSENS variability by ' || CAST(round_even(cv, 0) AS BIGINT) || '%' || band END AS verdict FROM t""",
)
def g10(spark, d):
    board = mx.two_level(mx.pair_changes(cells(spark, d), "O"), ["arm", "metric"], "pct")
    return mx.ranked(mx.spread_metrics(board, ["arm"], ["cv", "energy"]), "cv")


@query(
    "g11_metric_winners", "metric, trust, tier, winner",
    f"""WITH {CELL_SQL} SELECT metric, CASE WHEN metric IN ('energy', 'runtime') THEN 'measured' WHEN metric = 'cv' THEN 'simulated' ELSE 'derived' END AS trust,
    CASE WHEN metric IN ('energy', 'runtime') THEN 1 WHEN metric = 'cv' THEN 2 ELSE 3 END AS tier, arg_min(arm, mean) AS winner FROM brd GROUP BY 1""",
)
def g11(spark, d):
    board = mx.two_level(mx.pair_changes(cells(spark, d), "O"), ["arm", "metric"], "pct")
    trust = {"energy": "measured", "runtime": "measured", "cv": "simulated", "peak": "derived"}
    return mx.winners(board, trust, ["measured", "simulated", "derived"])


@query(
    "g13_fleet_sweep", "n_servers, ~3mean_MW, ~3peak_MW, ~6MW_per_1000",
    f"""WITH {ENERGY_SQL}, n AS (SELECT unnest([1000, 5000, 10000, 20000]) AS n_servers)
    SELECT n_servers, avg((mean_w + 300) * n_servers / 1e6) AS mean_MW, avg((max_w + 300) * n_servers / 1e6) AS peak_MW, avg((mean_w + 300) * n_servers / 1e6) / n_servers * 1e3 AS MW_per_1000 FROM en, n GROUP BY 1""",
)
def g13(spark, d):
    e = r.energy(b.traces(spark, d), b.TRACES)
    sizes = F.array(*[F.lit(n) for n in (1000, 5000, 10_000, 20_000)])
    docs = e.withColumn("n_servers", F.explode(sizes))
    docs = docs.select(
        "n_servers", ((F.col("mean_w") + 300) * F.col("n_servers") / 1e6).alias("mean"),
        ((F.col("max_w") + 300) * F.col("n_servers") / 1e6).alias("peak"),
    )
    return mx.fleet_sweep(docs, {"mean_MW": "mean", "peak_MW": "peak"})


SPLIT_SQL = f"""{ENERGY_SQL}, srt AS (SELECT *, row_number() OVER (PARTITION BY run, workload, arm ORDER BY power_W) - 1 AS k, count(*) OVER (PARTITION BY run, workload, arm) AS c FROM traces WHERE arm = 'F'),
  lv AS (SELECT run, workload, arm, power_W AS plateau FROM srt WHERE k = c // 2 + (c - c // 2) // 2),
  win AS (SELECT t.run, t.workload, t.arm, min(time_s) FILTER (power_W >= 0.9 * plateau) AS a, max(time_s) FILTER (power_W >= 0.9 * plateau) AS z FROM traces t JOIN lv USING (run, workload, arm) GROUP BY 1, 2, 3 HAVING count(*) FILTER (power_W >= 0.9 * plateau) >= 2),
  ins AS (SELECT t.*, lag(time_s) OVER w AS t0, lag(power_W) OVER w AS p0 FROM traces t JOIN win USING (run, workload, arm) WHERE time_s BETWEEN a AND z WINDOW w AS ({K})),
  cut AS (SELECT run, workload, arm, coalesce(sum((time_s - t0) * (power_W + p0) / 2), 0.0) AS energy_j, max(time_s) - min(time_s) AS duration_s FROM ins GROUP BY 1, 2, 3),
  lw AS (SELECT run, workload, arm, 'energy_with' AS metric, energy_j AS v FROM en UNION ALL SELECT run, workload, arm, 'runtime_with', duration_s FROM en
    UNION ALL SELECT run, workload, arm, 'energy_without', energy_j FROM cut UNION ALL SELECT run, workload, arm, 'runtime_without', duration_s FROM cut
    UNION ALL SELECT run, workload, arm, 'energy_without', energy_j FROM en WHERE arm = 'O' UNION ALL SELECT run, workload, arm, 'runtime_without', duration_s FROM en WHERE arm = 'O'),
  pw AS (SELECT s.run, s.arm, s.metric, (s.v / nullif(o.v, 0) - 1) * 100 AS pct FROM lw s JOIN lw o ON s.run = o.run AND s.workload = o.workload AND s.metric = o.metric AND o.arm = 'O' WHERE s.arm <> 'O'),
  pr AS (SELECT arm, metric, run, avg(pct) AS m FROM pw GROUP BY 1, 2, 3), bw AS (SELECT arm, metric, avg(m) AS mean, stddev_samp(m) AS sd FROM pr GROUP BY 1, 2)"""


@query(
    "g14_cost_split", "arm, ~4runtime_with, ~4runtime_without, ~4energy_with, ~4energy_without, ~4energy_without_sd, ~4energy_edge_share",
    f"""WITH {SPLIT_SQL}, x AS (SELECT arm, max(mean) FILTER (metric = 'runtime_with') AS runtime_with, max(mean) FILTER (metric = 'runtime_without') AS runtime_without, max(mean) FILTER (metric = 'energy_with') AS energy_with,
      max(mean) FILTER (metric = 'energy_without') AS energy_without, max(sd) FILTER (metric = 'energy_without') AS energy_without_sd FROM bw GROUP BY 1)
    SELECT *, (energy_with - energy_without) / nullif(energy_with, 0) AS energy_edge_share FROM x""",
)
def g14(spark, d):
    return mx.cost_split(b.traces(spark, d), b.TRACES, ["F"], "O", 0.9)


@query("g15_cost_table", "arm, metric, ~4mean, ~4sd", f"WITH {CELL_SQL} SELECT * FROM brd WHERE metric IN ('energy', 'runtime')")
def g15(spark, d):
    return mx.cost_table(b.traces(spark, d), b.TRACES, "O")


@query(
    "g16_per_workload", "workload, arm, metric, ~4mean, ~4sd, n",
    f"WITH {CELL_SQL} SELECT workload, arm, metric, avg(value) AS mean, CASE WHEN count(value) > 1 THEN stddev_samp(value) WHEN count(value) = 1 THEN 0.0 END AS sd, count(value) AS n FROM lng GROUP BY 1, 2, 3",
)
def g16(spark, d):
    return mx.per_workload(cells(spark, d))


@query(
    "g17_identity_check", "violations, checked",
    f"""WITH {GRID_SQL}, x AS (SELECT n, round_even(n * {YEAR} / nullif(span, 0), 1) AS rrei, round_even(span, 1) AS d FROM rk)
    SELECT count(*) FILTER (coalesce(n <> 1 OR abs(rrei - {YEAR} / nullif(d, 0)) > 1e-3 * rrei, TRUE)) AS violations, count(*) AS checked FROM x""",
)
def g17(spark, d):
    return mx.identity_check(r.risk_metrics(gridded(spark, d), b.TRACES, "P_W", 0.002))


@query(
    "g18_effect_verdict", "arm, metric, ~4mean, ~4sd, effect",
    f"""WITH {CELL_SQL}, wl AS (SELECT arm, metric, workload, avg(pct) AS m FROM pct GROUP BY 1, 2, 3), en2 AS (SELECT arm, metric, min(abs(m)) AS lo, max(abs(m)) AS hi FROM wl GROUP BY 1, 2)
    SELECT arm, metric, mean, sd, CASE WHEN mean IS NULL THEN 'no data' WHEN abs(mean) < 1 OR (sd <> 0 AND abs(mean) < 2 * sd) THEN 'within-noise' WHEN hi > 3 * lo THEN 'real (workload-driven)' ELSE 'real' END AS effect
    FROM brd JOIN en2 USING (arm, metric)""",
)
def g18(spark, d):
    return mx.effects(mx.pair_changes(cells(spark, d), "O"))


WARM_SQL = f"""{T}, wm AS (SELECT unnest([864000.0, 2592000.0]) AS warmup_s), k AS (SELECT *, min(time_s) OVER (PARTITION BY run, workload, arm) AS t0 FROM traces),
  c AS (SELECT warmup_s, run, workload, arm, stddev_pop(power_W) / avg(power_W) AS cv FROM k, wm WHERE time_s >= t0 + warmup_s GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
  p AS (SELECT s.warmup_s, s.run, s.workload, s.arm, (s.cv / nullif(o.cv, 0) - 1) * 100 AS pct FROM c s JOIN c o ON s.warmup_s = o.warmup_s AND s.run = o.run AND s.workload = o.workload AND o.arm = 'O' WHERE s.arm <> 'O'),
  pr AS (SELECT warmup_s, arm, run, avg(pct) AS m FROM p GROUP BY 1, 2, 3)"""


@query(
    "g19_rescored_board", "warmup_s, arm, workload, ~4mean, ~4sd",
    f"""WITH {WARM_SQL} SELECT warmup_s, arm, workload, avg(pct) AS mean, CASE WHEN count(pct) > 1 THEN stddev_samp(pct) ELSE 0.0 END AS sd FROM p GROUP BY 1, 2, 3
    UNION ALL SELECT warmup_s, arm, 'mean', avg(m), CASE WHEN count(m) > 1 THEN stddev_samp(m) ELSE 0.0 END FROM pr GROUP BY 1, 2""",
)
def g19(spark, d):
    tr = b.traces(spark, d)
    key = list(b.TRACES.key)
    parts = []
    for skip in (864_000.0, 2_592_000.0):
        kept = g.drop_warmup(tr, key, "time_s", skip)[0]
        cv = kept.groupBy(*key).agg((F.stddev_pop("power_W") / F.avg("power_W")).alias("value"))
        parts.append(cv.select("*", F.lit("cv").alias("metric"), F.lit(skip).alias("warmup_s")))
    pct = mx.pair_changes(parts[0].unionByName(parts[1]), "O", ids=("warmup_s", "run", "workload"))
    return mx.rescored_board(pct)


@query(
    "g20_voltage_swing", "arm, metric, ~4mean, ~4sd",
    f"""WITH {T}, v AS (SELECT *, 1 - power_W / 5300 AS v FROM traces), c AS (SELECT run, workload, arm, 100 * (max(v) - min(v)) AS s, min(v) AS m FROM v GROUP BY 1, 2, 3),
    l AS (SELECT run, arm, 'v_swing_pct' AS metric, s AS x FROM c UNION ALL SELECT run, arm, 'min_v_pu', m FROM c), r AS (SELECT arm, metric, run, avg(x) AS x FROM l GROUP BY 1, 2, 3)
    SELECT arm, metric, avg(x) AS mean, stddev_samp(x) AS sd FROM r GROUP BY 1, 2""",
)
def g20(spark, d):
    return mx.voltage_swing(b.traces(spark, d).withColumn("v_pu", 1 - F.col("power_W") / 5300), b.TRACES)


TAU = 200_000.0
LOAD_SQL = f"""{T}, pk AS (SELECT run, workload, arm, max(power_W + 300) AS pk FROM traces GROUP BY 1, 2, 3),
  rw AS (SELECT t.*, (power_W + 300) / pk AS frac, (power_W + 300) * (1.60 - 0.45 * ((power_W + 300) / pk)) AS raw, row_number() OVER w AS rn, time_s - lag(time_s) OVER w AS dt
    FROM traces t JOIN pk USING (run, workload, arm) WINDOW w AS (PARTITION BY t.run, t.workload, t.arm ORDER BY time_s)),
  mk AS (SELECT *, CASE WHEN rn = 1 THEN raw ELSE (1 - exp(-dt / {TAU})) * raw END AS mark FROM rw),
  lp AS (SELECT a.run, a.workload, a.arm, a.seq, any_value(a.frac) AS frac, any_value(a.time_s) AS time_s, sum(c.mark * exp(-(a.time_s - c.time_s) / {TAU})) AS p
    FROM mk a JOIN mk c ON a.run = c.run AND a.workload = c.workload AND a.arm = c.arm AND c.time_s <= a.time_s GROUP BY 1, 2, 3, 4)"""


@query(
    "f1_fleet_load", f"{KEYS}, seq, n_servers, ~it_fraction, ~power_factor, ~2P_W, ~2Q_var",
    f"""WITH {LOAD_SQL}, n AS (SELECT unnest([1000, 10000]) AS n_servers) SELECT run, workload, arm, seq, n_servers, frac AS it_fraction, 0.85 + 0.12 * frac AS power_factor, p * n_servers AS P_W,
    p * n_servers * tan(acos(0.85 + 0.12 * frac)) AS Q_var FROM lp, n""",
)
def f1(spark, d):
    return r.fleet_load(b.traces(spark, d), b.TRACES, servers=(1000, 10_000), tau_s=TAU)[0]


@query("f4_ups_low_pass", f"{KEYS}, seq, ~2P_W", f"WITH {LOAD_SQL} SELECT run, workload, arm, seq, p * 10000 AS P_W FROM lp")
def f4(spark, d):
    return r.fleet_load(b.traces(spark, d), b.TRACES, tau_s=TAU)[0]


@query(
    "f5_cv_after_warmup", f"{KEYS}, ~cv",
    f"""WITH {T}, e AS (SELECT run, workload, arm, min(time_s) + 864000 AS a, max(time_s) AS z FROM traces GROUP BY 1, 2, 3),
    g AS (SELECT run, workload, arm, a + k * 21600.0 AS px FROM (SELECT *, unnest(generate_series(0, CAST(ceil((z - a) / 21600.0) AS BIGINT) - 1)) AS k FROM e WHERE z > a)),
    lo AS (SELECT g.*, t.time_s AS t0, t.power_W AS v0 FROM g ASOF JOIN traces t ON g.run = t.run AND g.workload = t.workload AND g.arm = t.arm AND g.px >= t.time_s),
    hi AS (SELECT lo.*, t.time_s AS t1, t.power_W AS v1 FROM lo ASOF JOIN traces t ON lo.run = t.run AND lo.workload = t.workload AND lo.arm = t.arm AND lo.px <= t.time_s),
    v AS (SELECT run, workload, arm, CASE WHEN t1 = t0 THEN v0 ELSE v0 + (px - t0) * (v1 - v0) / (t1 - t0) END AS p FROM hi)
    SELECT run, workload, arm, stddev_pop(p) / avg(p) AS cv FROM v GROUP BY 1, 2, 3""",
)
def f5(spark, d):
    return r.cv_after(b.traces(spark, d), b.TRACES, "power_W", 864_000.0, 21_600.0)
