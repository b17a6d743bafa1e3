"""Queries over event matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe import bindings as b
from wattframe.catalog import query
from wattframe.catalog.events import DAY_US, EPISODE_SQL, ONSET25_SQL, RUN_SQL, onsets25, runs
from wattframe.catalog.features import RN_SQL, S, W
from wattframe.operators import events as e
from wattframe.operators import match as m
from wattframe.plans.timeline import number_rows

ID = "server, event_id"
US = F.unix_micros
HALF_US = DAY_US // 2
NEAR = f"a.server = t.server AND epoch_us(a.ts) BETWEEN epoch_us(t.ts) - {DAY_US} AND epoch_us(t.ts) + {HALF_US}"


@query(
    "j1_first_alert", f"{ID}, alert_us, ~latency_s",
    f"""WITH {b.MATCH_SQL} SELECT t.server, t.event_id, min(epoch_us(a.ts)) AS alert_us, (min(epoch_us(a.ts)) - epoch_us(any_value(t.ts))) / 1e6 AS latency_s
    FROM truth t LEFT JOIN alerts a ON {NEAR} GROUP BY 1, 2""",
)
def j1(spark, d):
    out = m.first_alert(b.truth(spark, d), b.alerts(spark, d), b.MATCH, b.DAY, b.DAY / 2)
    return out.withColumn("alert_us", US("alert_ts"))


@query(
    "j2_episode_overlap", "server, episode, matched",
    f"""WITH {EPISODE_SQL} SELECT e.server, e.episode, bool_or(coalesce(epoch_us(e.end_ts) >= epoch_us(t.ts) - {DAY_US} AND epoch_us(e.start_ts) <= epoch_us(t.ts) + {HALF_US}, FALSE)) AS matched
    FROM episodes e LEFT JOIN truth t USING (server) GROUP BY 1, 2""",
)
def j2(spark, d):
    eps = e.episodes(b.alerts(spark, d), b.MATCH, b.DAY)
    return m.overlaps(eps, b.truth(spark, d), b.MATCH, b.DAY, b.DAY / 2)


@query(
    "j3_next_event", f"{ID}, ~lead_s",
    f"""WITH {b.MATCH_SQL}, x AS (SELECT a.server, a.event_id, (min(epoch_us(t.ts)) - epoch_us(any_value(a.ts))) / 1e6 AS l FROM alerts a LEFT JOIN truth t ON t.server = a.server AND t.ts > a.ts GROUP BY 1, 2)
    SELECT server, event_id, CASE WHEN l > 0 AND l <= 86400 THEN l END AS lead_s FROM x""",
)
def j3(spark, d):
    return m.next_event(b.alerts(spark, d), b.truth(spark, d), b.MATCH, b.DAY)


@query(
    "j4_warned_before", f"{ID}, ~lead_s",
    f"""WITH {b.MATCH_SQL} SELECT t.server, t.event_id, (epoch_us(any_value(t.ts)) - min(epoch_us(a.ts))) / 1e6 AS lead_s
    FROM truth t LEFT JOIN alerts a ON a.server = t.server AND epoch_us(a.ts) >= epoch_us(t.ts) - {DAY_US} AND a.ts < t.ts GROUP BY 1, 2""",
)
def j4(spark, d):
    return m.warned_before(b.truth(spark, d), b.alerts(spark, d), b.MATCH, b.DAY)


@query(
    "j5_confirmed_onsets", "server, rn, flag_rn, near_flag",
    f"""WITH RECURSIVE {ONSET25_SQL}, f AS (SELECT server, rn FROM n WHERE usage_percent > 80)
    SELECT o.server, o.rn, min(f.rn) FILTER (f.rn BETWEEN o.rn AND o.rn + 5) AS flag_rn, coalesce(bool_or(abs(f.rn - o.rn) <= 2), FALSE) AS near_flag FROM onset o LEFT JOIN f USING (server) GROUP BY 1, 2""",
)
def j5(spark, d):
    axis = e.row_axis(b.SAMPLES)
    on = onsets25(spark, d).select("server", "rn")
    flags = number_rows(b.samples(spark, d), b.SAMPLES, "rn").filter("usage_percent > 80").select("server", "rn")
    out = m.confirm(on, flags, axis, 5).withColumnRenamed("alert_ts", "flag_rn")
    return m.near_any(out, flags, axis, 2, "near_flag")


@query(
    "j6_baseline_pairs", "run, workload, arm, ~mean_w, ~mean_w_base",
    f"""WITH {b.TRACES_SQL}, t AS (SELECT run, workload, arm, avg(power_W) AS mean_w FROM traces GROUP BY 1, 2, 3)
    SELECT s.run, s.workload, s.arm, s.mean_w, o.mean_w AS mean_w_base FROM t s JOIN t o ON s.run = o.run AND s.workload = o.workload AND o.arm = 'O' WHERE s.arm <> 'O'""",
)
def j6(spark, d):
    t = b.traces(spark, d).groupBy(*b.TRACES.key).agg(F.avg("power_W").alias("mean_w"))
    return m.pair_baseline(t, ["run", "workload"], "arm", "O", ["mean_w"])


@query(
    "j7_before_onset_label", f"{ID}, label",
    f"""WITH {b.MATCH_SQL}, {S} SELECT s.server, s.event_id, CASE WHEN count(t.event_id) > 0 THEN 1 ELSE 0 END AS label FROM samples s
    LEFT JOIN truth t ON t.server = s.server AND s.ts <= t.ts AND epoch_us(s.ts) > epoch_us(t.ts) - {DAY_US} GROUP BY 1, 2""",
)
def j7(spark, d):
    src = b.samples(spark, d).select("server", "ts", "event_id")
    return m.before_onset(src, b.truth(spark, d), b.MATCH, b.DAY)


@query(
    "j8_outside_runs", f"{ID}",
    f"WITH {RUN_SQL} SELECT s.server, s.event_id FROM samples s WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.server = s.server AND s.ts BETWEEN r.start_ts AND r.end_ts)",
)
def j8(spark, d):
    return m.outside_runs(b.samples(spark, d).select("server", "ts", "event_id"), runs(spark, d), b.SAMPLES)


@query(
    "j9_align_scores", f"{ID}, ~trivial",
    f"WITH {RN_SQL} SELECT server, event_id, CASE WHEN kind = 'error' THEN abs(d1) END AS trivial FROM n",
)
def j9(spark, d):
    from wattframe.operators.features import trivial_score

    src = b.samples(spark, d)
    scores = trivial_score(src, b.SAMPLES).filter("kind = 'error'").select("server", "ts", "trivial")
    return m.align_scores(src.select("server", "ts", "event_id"), scores, ["server", "ts"])


@query(
    "j10_nearest_lookup", "event_id, ~near_key, ~exact",
    """WITH t AS (SELECT DISTINCT round(s_acctbal / 20, 0) AS w FROM supplier),
    e AS (SELECT event_id, round(value, 0) AS v FROM events),
    x AS (SELECT event_id, t.w, row_number() OVER (PARTITION BY event_id ORDER BY abs(t.w - v), t.w) AS k, v FROM e, t)
    SELECT x.event_id, x.w AS near_key, coalesce(t.w * 3, -1.0) AS exact FROM x LEFT JOIN t ON t.w = x.v WHERE k = 1""",
)
def j10(spark, d):
    table = b.table(spark, d, "supplier").select(F.round(F.col("s_acctbal") / 20, 0).alias("w")).distinct()
    table = table.withColumn("y", F.col("w") * 3)
    src = b.events(spark, d).select("event_id", F.round("value", 0).alias("v"))
    near = m.nearest_value(src, table, "v", "w", "w", "near_key")
    return m.exact_value(near, table, "v", "w", "y", "exact")


@query(
    "j12_metadata_lookup", "p_partkey, ~gflops",
    """WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey || '_worst' ELSE CAST(p_partkey AS VARCHAR) END AS name FROM part),
    t AS (SELECT CAST(s_suppkey AS VARCHAR) AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'n/a' ELSE CAST(s_acctbal AS VARCHAR) END AS g FROM supplier)
    SELECT p_partkey, coalesce(TRY_CAST(a.g AS DOUBLE), TRY_CAST(s.g AS DOUBLE)) AS gflops FROM d LEFT JOIN t a ON a.name = d.name LEFT JOIN t s ON s.name = regexp_replace(d.name, '_worst$', '')""",
)
def j12(spark, d):
    key = F.col("p_partkey").cast("string")
    df = b.table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(key, F.lit("_worst"))).otherwise(key).alias("name")
    )
    t = b.table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("name"),
        F.when(F.col("s_suppkey") % 5 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string")).alias("gflops"),
    )
    return m.lookup_by_name(df, t, "name", "gflops")
