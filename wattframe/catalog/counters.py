"""Queries over raw counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe import bindings as b
from wattframe.catalog import query
from wattframe.operators import counters as c

KEY = "PARTITION BY server, socket ORDER BY t_s"
DELTA_SQL = f"""{b.COUNTERS_SQL},
d AS (SELECT *, CASE WHEN e - p < 0 THEN e - p + max_range ELSE e - p END AS delta FROM (
  SELECT server, socket, t_s, energy_uj AS e, max_range, lag(energy_uj) OVER w AS p,
    t_s - lag(t_s) OVER w AS dt FROM counters WINDOW w AS ({KEY})))"""
STALL_SQL = f"""{DELTA_SQL},
mark AS (SELECT *, last_value(CASE WHEN delta IS NULL OR delta > 0 THEN t_s END IGNORE NULLS) OVER
  ({KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM d),
stall AS (SELECT *, CASE WHEN delta > 0 AND t_s > since THEN delta * 1e-6 / (t_s - since) END AS watts FROM mark)"""
MICRO = 1_000_000.0


@query("c1_wrapped_delta", "server, socket, ~t_s, ~delta, ~dt", f"WITH {DELTA_SQL} SELECT * FROM d")
def c1(spark, d):
    return c.energy_deltas(b.counters(spark, d), b.COUNTERS, "energy_uj", "max_range")


@query(
    "c2_naive_power", "server, ~t_s, ~uw",
    f"WITH {DELTA_SQL} SELECT server, t_s, sum(delta) / max(dt) / 0.997 AS uw FROM d WHERE dt > 0 GROUP BY 1, 2",
)
def c2(spark, d):
    out = c.naive_power(b.counters(spark, d), b.COUNTERS, "energy_uj", "max_range", ["server"])
    return out.withColumn("uw", F.col("watts") * MICRO / 0.997)


@query(
    "c3_stall_safe_power", "server, socket, ~t_s, ~uw",
    f"WITH {STALL_SQL} SELECT server, socket, t_s, watts * 1e6 AS uw FROM stall",
)
def c3(spark, d):
    out = c.stall_safe_power(b.counters(spark, d), b.COUNTERS, "energy_uj", "max_range")
    return out.withColumn("uw", F.col("watts") * MICRO)


@query(
    "c4_windowed_power", "server, socket, ~t_s, ~uw",
    f"""WITH RECURSIVE {DELTA_SQL}, n AS (SELECT *, row_number() OVER ({KEY}) AS k FROM d WHERE delta IS NOT NULL),
    walk AS (SELECT server, socket, t_s, k, delta AS uj, dt AS s, delta > 0 AND dt >= 1000000.0 AS emit FROM n WHERE k = 1
      UNION ALL SELECT n.server, n.socket, n.t_s, n.k,
        n.delta + CASE WHEN w.emit THEN 0.0 ELSE w.uj END, n.dt + CASE WHEN w.emit THEN 0.0 ELSE w.s END,
        n.delta > 0 AND n.dt + CASE WHEN w.emit THEN 0.0 ELSE w.s END >= 1000000.0
      FROM walk w JOIN n ON n.server = w.server AND n.socket = w.socket AND n.k = w.k + 1)
    SELECT server, socket, t_s, uj / s AS uw FROM walk WHERE emit""",
)
def c4(spark, d):
    out = c.windowed_power(b.counters(spark, d), b.COUNTERS, "energy_uj", "max_range", 1_000_000.0)
    return out.withColumn("uw", F.col("watts") * MICRO)


COMBINED_SQL = f"""{STALL_SQL},
wide AS (SELECT server, t_s, max(CASE WHEN socket = 0 THEN watts END) AS s0,
  max(CASE WHEN socket = 1 THEN watts END) AS s1 FROM stall GROUP BY 1, 2),
latest AS (SELECT server, t_s, last_value(s0 IGNORE NULLS) OVER w AS s0, last_value(s1 IGNORE NULLS) OVER w AS s1
  FROM wide WINDOW w AS (PARTITION BY server ORDER BY t_s))"""


@query(
    "c5_combined_sockets", "server, ~t_s, ~uw",
    f"WITH {COMBINED_SQL} SELECT server, t_s, (s0 + s1) * 1e6 AS uw FROM latest WHERE s0 + s1 IS NOT NULL",
)
def c5(spark, d):
    polls = c.stall_safe_power(b.counters(spark, d), b.COUNTERS, "energy_uj", "max_range")
    out = c.combined_power(polls, b.COUNTER_SERVERS, "socket", [0, 1])
    return out.withColumn("uw", F.col("watts") * MICRO)


@query(
    "c6_edge_aligned_power", "server, ~t_s, ~uw, edges",
    f"""WITH {COMBINED_SQL}, fresh AS (SELECT DISTINCT server, t_s FROM stall WHERE watts IS NOT NULL)
    SELECT server, floor(t_s / 2592000.0) * 2592000.0 AS t_s, avg(s0 + s1) * 1e6 AS uw, count(*) AS edges
    FROM latest JOIN fresh USING (server, t_s) WHERE s0 + s1 IS NOT NULL GROUP BY 1, 2""",
)
def c6(spark, d):
    out = c.edge_power(
        b.counters(spark, d), b.COUNTERS, "energy_uj", "max_range", "socket", [0, 1],
        b.COUNTER_SERVERS, 30 * b.DAY,
    )
    return out.withColumn("uw", F.col("watts") * MICRO)


@query(
    "c7_counter_rates", "server, socket, ~t_s, ~3raw_per_day",
    f"""WITH {b.COUNTERS_SQL}, r AS (SELECT server, socket, t_s, energy_uj - lag(energy_uj) OVER w AS d,
      t_s - lag(t_s) OVER w AS dt FROM counters WINDOW w AS ({KEY}))
    SELECT server, socket, t_s, d / dt * 86400 AS raw_per_day FROM r WHERE d >= 0 AND dt > 0""",
)
def c7(spark, d):
    out = c.rates(b.counters(spark, d), b.COUNTERS, ["energy_uj"])
    return out.withColumn("raw_per_day", F.col("energy_uj_per_s") * 86_400)


JIFFIES_SQL = """j AS (SELECT l_suppkey AS server, CAST(epoch_us(l_shipdate) / 1000000 AS DOUBLE) AS t_s,
  sum(l_quantity) AS q, sum(l_tax) AS x FROM lineitem GROUP BY 1, 2),
jiffies AS (SELECT server, t_s, sum(CASE WHEN q > 20 THEN q ELSE 0.0 END) OVER w AS total,
  sum(CASE WHEN q > 20 THEN q / 3 ELSE 0.0 END) OVER w AS idle FROM j
  WINDOW w AS (PARTITION BY server ORDER BY t_s))"""


def jiffies(spark, d):
    from wattframe.plans.timeline import Timeline, running_sum

    day = (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1_000_000).cast("double")
    q = F.col("q")
    li = b.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("server"), day.alias("t_s")).agg(
        F.sum("l_quantity").alias("q")
    )
    return Timeline(li, b.COUNTER_SERVERS).scan(
        total=running_sum(F.when(q > 20, q).otherwise(0.0)),
        idle=running_sum(F.when(q > 20, q / 3).otherwise(0.0)),
    ).done()


@query(
    "c8_cpu_usage", "server, ~t_s, ~usage, ~clamped",
    f"""WITH {JIFFIES_SQL}, d AS (SELECT server, t_s, total - lag(total) OVER w AS dt, idle - lag(idle) OVER w AS di
      FROM jiffies WINDOW w AS (PARTITION BY server ORDER BY t_s))
    SELECT server, t_s, CASE WHEN dt > 0 THEN 100 * (1 - di / dt) WHEN dt IS NOT NULL THEN 0.0 END AS usage,
      CASE WHEN dt > 0 THEN greatest(0.0, least(1.0, 1 - di / dt)) WHEN dt IS NOT NULL THEN 0.0 END AS clamped FROM d""",
)
def c8(spark, d):
    out = c.cpu_usage(jiffies(spark, d), b.COUNTER_SERVERS, "idle", "total")
    both = c.cpu_usage(out.withColumnRenamed("usage", "pct"), b.COUNTER_SERVERS, "idle", "total", clamp=True)
    return both.withColumnRenamed("usage", "clamped").withColumnRenamed("pct", "usage")


@query(
    "c9_power_derivative", "server, ~t_s, ~uw, ~udw",
    f"""WITH {DELTA_SQL}, p AS (SELECT server, t_s, sum(delta) / max(dt) / 0.997 AS uw FROM d WHERE dt > 0 GROUP BY 1, 2)
    SELECT server, t_s, uw, coalesce((uw - lag(uw) OVER w) / (t_s - lag(t_s) OVER w), 0.0) * 86400 AS udw FROM p
    WINDOW w AS (PARTITION BY server ORDER BY t_s)""",
)
def c9(spark, d):
    p = c.naive_power(b.counters(spark, d), b.COUNTERS, "energy_uj", "max_range", ["server"])
    out = c.power_and_derivative(p, b.COUNTER_SERVERS)
    return out.withColumns({"uw": F.col("watts") * MICRO / 0.997, "udw": F.col("deriv_w_s") * MICRO * 86_400 / 0.997})
