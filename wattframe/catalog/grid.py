"""Queries over sources and grid operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe import bindings as b
from wattframe.catalog import query
from wattframe.operators import grid as g
from wattframe.plans.timeline import number_rows
from wattframe.series import Series
from wattframe.sources import readers

US = F.unix_micros


@query(
    "s3_clean_trace", "run, workload, arm, seq, ~time_s, ~power_W, was_negative",
    f"""WITH {b.RAW_TRACES_SQL}, shifted AS (SELECT run, workload, arm, time_s, power_W - 60 AS power_W, seq FROM raw_traces),
    ok AS (SELECT *, row_number() OVER (PARTITION BY run, workload, arm, time_s ORDER BY seq) AS r FROM shifted),
    one AS (SELECT *, min(time_s) OVER k AS t0, count(*) OVER k AS n FROM ok WHERE r = 1
      WINDOW k AS (PARTITION BY run, workload, arm))
    SELECT run, workload, arm, seq, time_s - t0 AS time_s, greatest(power_W, 0.0) AS power_W,
      power_W < 0 AS was_negative FROM one WHERE n >= 2""",
)
def s3(spark, d):
    raw = b.raw_traces(spark, d).withColumn("power_W", F.col("power_W") - 60)
    return g.clean_trace(raw, list(b.TRACES.key))[0]


@query(
    "s4_telemetry_range", "server, t_us, ~power_watts, ~usage_percent",
    f"""WITH {b.NODE_SQL} SELECT server, epoch_us(ts) AS t_us, power_watts, usage_percent FROM node_wide
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'""",
)
def s4(spark, d):
    wide = readers.between(b.node_wide(spark, d), "ts", "2024-01-05", "2024-01-12")
    return wide.withColumn("t_us", US("ts"))


@query(
    "s6_store_range_scan", "server, event_id, measurement, ~value",
    f"""WITH {b.LONG_SQL} SELECT * FROM long WHERE measurement IN ('purchase', 'view')
    AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'""",
)
def s6(spark, d):
    long = b.telemetry_long(spark, d)
    return readers.scan_points(long, ["purchase", "view"], "2024-01-10", "2024-01-20")


@query(
    "s13_range_load_keep_last", "server, t_us, event_id, ~value",
    f"""WITH {b.LONG_SQL}, r AS (SELECT *, epoch_us(ts) // 3600000000 * 3600000000 AS t_us FROM long),
    n AS (SELECT *, row_number() OVER (PARTITION BY server, t_us ORDER BY event_id DESC) AS k FROM r)
    SELECT server, t_us, event_id, value FROM n WHERE k = 1""",
)
def s13(spark, d):
    long = b.telemetry_long(spark, d).withColumn("t_us", US(g.floor_time(F.col("ts"), 3600)))
    return g.keep_last(long, ["server", "t_us"], "event_id")


@query(
    "s14_incremental_merge", "server, t_us, event_id, ~value",
    f"""WITH {b.LONG_SQL}, r AS (SELECT *, epoch_us(ts) // 3600000000 * 3600000000 AS t_us FROM long),
    n AS (SELECT *, row_number() OVER (PARTITION BY server, t_us ORDER BY event_id DESC) AS k FROM r)
    SELECT server, t_us, event_id, value FROM n WHERE k = 1""",
)
def s14(spark, d):
    long = b.telemetry_long(spark, d).withColumn("t_us", US(g.floor_time(F.col("ts"), 3600)))
    cut = F.lit("2024-01-15").cast("timestamp")
    cached = g.keep_last(long.filter(F.col("ts") < cut), ["server", "t_us"], "event_id")
    return readers.merge_latest(cached, long.filter(F.col("ts") >= cut), ["server", "t_us"], "event_id")


@query(
    "r1_round_half_even", "event_id, s_us, h_us",
    """WITH u AS (SELECT event_id, epoch_us(ts) AS us FROM events),
    q AS (SELECT event_id, us, us // 1000000 AS a, us % 1000000 AS ar, us // 100000 AS c, us % 100000 AS cr FROM u)
    SELECT event_id,
      (a + CASE WHEN 2 * ar > 1000000 OR (2 * ar = 1000000 AND a % 2 = 1) THEN 1 ELSE 0 END) * 1000000 AS s_us,
      (c + CASE WHEN 2 * cr > 100000 OR (2 * cr = 100000 AND c % 2 = 1) THEN 1 ELSE 0 END) * 100000 AS h_us
    FROM q""",
)
def r1(spark, d):
    ts = F.col("ts")
    return b.events(spark, d).select(
        "event_id", US(g.round_time(ts, 1.0)).alias("s_us"), US(g.round_time(ts, 0.1)).alias("h_us")
    )


@query(
    "r2_pivot_signals", "server, t_us, ~power_watts, ~usage_percent, ~temp_celsius, ~freq_mhz, ~nr_running",
    f"WITH {b.NODE_SQL} SELECT *, epoch_us(ts) AS t_us FROM node_wide",
)
def r2(spark, d):
    return b.node_wide(spark, d).withColumn("t_us", US("ts"))


@query(
    "r3_pivot_fields", "server, t_us, ~nr_running, ~load1, ~mem_used",
    f"""WITH {b.LONG_SQL}, t AS (SELECT server, epoch_us(ts) // 21600000000 * 21600000000 AS t_us, value,
      CASE WHEN measurement = 'error' THEN 'mem.used' WHEN measurement = 'click' THEN 'system.load1'
        WHEN measurement = 'signup' THEN 'run_queue.nr_running' END AS f FROM long)
    SELECT server, t_us, avg(CASE WHEN f = 'run_queue.nr_running' THEN value END) AS nr_running,
      avg(CASE WHEN f = 'system.load1' THEN value END) AS load1,
      avg(CASE WHEN f = 'mem.used' THEN value END) AS mem_used
    FROM t WHERE f IS NOT NULL GROUP BY 1, 2""",
)
def r3(spark, d):
    m = F.col("measurement")
    long = b.telemetry_long(spark, d).withColumns(
        {
            "ts": g.floor_time(F.col("ts"), 21_600),
            "field": F.when(m == "error", "used").when(m == "click", "load1").when(m == "signup", "nr_running"),
            "measurement": F.when(m == "error", "mem").when(m == "click", "system").when(m == "signup", "run_queue"),
        }
    )
    return g.pivot_fields(long, ["server", "ts"]).withColumn("t_us", US("ts"))


@query(
    "r4_rename_signals", "event_id, ~power_watts, ~temp_celsius",
    "SELECT event_id, value AS power_watts, value / 8 AS temp_celsius FROM events",
)
def r4(spark, d):
    ev = b.events(spark, d).select("event_id", F.col("value").alias("cpu_power"), (F.col("value") / 8).alias("cpu_temp"))
    return g.rename_signals(ev)


@query(
    "r5_mean_across_devices", "server, day, measurement, ~value",
    f"""WITH {b.LONG_SQL} SELECT server, epoch_us(ts) // 86400000000 AS day, measurement, avg(value) AS value
    FROM long GROUP BY 1, 2, 3""",
)
def r5(spark, d):
    long = b.telemetry_long(spark, d).withColumn("day", F.floor(US("ts") / F.lit(86_400_000_000)))
    return g.mean_by(long, ["server", "day", "measurement"])


@query(
    "r6_downsample_mean", "server, measurement, t_us, ~value",
    f"""WITH {b.LONG_SQL} SELECT server, measurement, (epoch_us(ts) // 3600000000 + 1) * 3600000000 AS t_us,
    avg(value) AS value FROM long GROUP BY 1, 2, 3""",
)
def r6(spark, d):
    out = g.downsample(b.telemetry_long(spark, d), ["server", "measurement"], 3600, stamp="stop")
    return out.withColumn("t_us", US("ts"))


def hourly(spark, d):
    return g.downsample(b.telemetry_long(spark, d), ["server"], 3600)


HOURLY = Series(("server",), "ts", (), 5 * b.DAY)
HOURLY_SQL = f"""{b.LONG_SQL}, hourly AS (
  SELECT server, epoch_us(ts) // 3600000000 AS h, avg(value) AS value FROM long GROUP BY 1, 2),
ends AS (SELECT server, min(h) AS lo, max(h) AS hi FROM hourly GROUP BY 1),
ticks AS (SELECT server, unnest(generate_series(lo, hi)) AS h FROM ends),
gridded AS (SELECT t.server, t.h, value FROM ticks t LEFT JOIN hourly USING (server, h))"""


@query(
    "r7_uniform_grid", "server, t_us, ~value",
    f"WITH {HOURLY_SQL} SELECT server, h * 3600000000 AS t_us, value FROM gridded",
)
def r7(spark, d):
    return g.reindex(hourly(spark, d), HOURLY, 3600).withColumn("t_us", US("ts"))


@query(
    "r8_fill_limited", "server, t_us, ~value",
    f"""WITH {HOURLY_SQL} SELECT server, h * 3600000000 AS t_us,
    last_value(value IGNORE NULLS) OVER (PARTITION BY server ORDER BY h ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value
    FROM gridded""",
)
def r8(spark, d):
    grid = g.reindex(hourly(spark, d), HOURLY, 3600)
    return g.fill_gaps(grid, HOURLY, ["value"], 3600, 2).withColumn("t_us", US("ts"))


@query(
    "r9_fill_forward", "server, event_id, ~temp_celsius, ~freq_mhz",
    f"""WITH {b.SAMPLES_SQL} SELECT server, event_id, last_value(temp_celsius IGNORE NULLS) OVER w AS temp_celsius,
    last_value(freq_mhz IGNORE NULLS) OVER w AS freq_mhz FROM samples
    WINDOW w AS (PARTITION BY server ORDER BY ts, event_id)""",
)
def r9(spark, d):
    return g.fill_forward(b.samples(spark, d), b.SAMPLES, ["temp_celsius", "freq_mhz"])


@query(
    "r10_asof_tolerance", "server, event_id, ~click_value",
    """WITH l AS (SELECT user_id AS server, ts, event_id FROM events WHERE event_type = 'error'),
    r AS (SELECT user_id AS server, ts, value FROM events WHERE event_type = 'click')
    SELECT l.server, l.event_id, CASE WHEN epoch_us(l.ts) - epoch_us(r.ts) <= 172800000000 THEN r.value END AS click_value
    FROM l ASOF LEFT JOIN r ON l.server = r.server AND l.ts >= r.ts""",
)
def r10(spark, d):
    ev = b.events(spark, d).withColumn("server", F.col("user_id"))
    left = ev.filter("event_type = 'error'").select("server", "ts", "event_id")
    right = ev.filter("event_type = 'click'").select("server", "ts", F.col("value").alias("click_value"))
    return g.align(left, right, b.MATCH, ["click_value"], 2 * b.DAY)


@query(
    "r11_join_upstream", "server, t_us, ~power_watts, ~nr_running",
    f"""WITH {b.NODE_SQL}, up AS (SELECT server, ts, nr_running, -1.0 AS power_watts FROM node_wide WHERE nr_running > 50)
    SELECT n.server, epoch_us(n.ts) AS t_us, n.power_watts, up.nr_running
    FROM node_wide n LEFT JOIN up ON n.server = up.server AND n.ts = up.ts""",
)
def r11(spark, d):
    wide = b.node_wide(spark, d)
    up = wide.filter("nr_running > 50").select("server", "ts", "nr_running", F.lit(-1.0).alias("power_watts"))
    return g.join_upstream(wide.drop("nr_running"), up, ["server", "ts"]).withColumn("t_us", US("ts"))


@query(
    "r12_complete_cases", "server, event_id, ~temp_celsius, ~freq_mhz",
    f"WITH {b.SAMPLES_SQL} SELECT * FROM samples WHERE temp_celsius IS NOT NULL AND freq_mhz IS NOT NULL",
)
def r12(spark, d):
    return g.complete_cases(b.samples(spark, d), ["temp_celsius", "freq_mhz"])


SEQ = Series(("run", "workload", "arm"), "seq", (), 100_000)


@query(
    "r13_drop_nonincreasing", "run, workload, arm, seq, ~time_s, ~power_W",
    f"""WITH {b.RAW_TRACES_SQL}, l AS (SELECT *, lag(time_s) OVER (PARTITION BY run, workload, arm ORDER BY seq) AS prev FROM raw_traces)
    SELECT * FROM l WHERE prev IS NULL OR time_s > prev""",
)
def r13(spark, d):
    return g.drop_nonincreasing(b.raw_traces(spark, d), SEQ, "time_s")


@query("r14_unique_time", "run, workload, arm, seq, ~time_s, ~power_W", f"WITH {b.TRACES_SQL} SELECT * FROM traces")
def r14(spark, d):
    return b.traces(spark, d)


def resample_sql(dt: float, source: str = "traces") -> str:
    """Interpolated grid of traces with step ``dt``, as SQL."""
    return f"""seg AS (
      SELECT run, workload, arm, time_s, power_W, lead(time_s) OVER w AS t1, lead(power_W) OVER w AS p1,
        first_value(time_s) OVER w AS t0 FROM {source}
      WINDOW w AS (PARTITION BY run, workload, arm ORDER BY time_s)),
    cut AS (SELECT *, CAST(ceil((time_s - t0) / {dt}) AS BIGINT) AS lo,
      CAST(CASE WHEN t1 IS NULL THEN ceil((time_s + {dt} / 2 - t0) / {dt}) ELSE ceil((t1 - t0) / {dt}) END AS BIGINT) AS hi FROM seg),
    tick AS (SELECT *, unnest(generate_series(lo, hi - 1)) AS tick FROM cut WHERE hi > lo),
    grid AS (SELECT run, workload, arm, tick, t0 + tick * {dt} AS time_s,
      CASE WHEN t1 IS NULL OR t0 + tick * {dt} <= time_s THEN power_W
        ELSE power_W + (t0 + tick * {dt} - time_s) * (p1 - power_W) / (t1 - time_s) END AS power_W FROM tick)"""


@query(
    "r15_resample_uniform", "run, workload, arm, tick, ~time_s, ~power_W",
    f"WITH {b.TRACES_SQL}, {resample_sql(21600.0)} SELECT * FROM grid",
)
def r15(spark, d):
    return g.resample(b.traces(spark, d), b.TRACES, "power_W", 21_600.0)


@query(
    "r16_interpolate_at", "run, workload, arm, seq, ~demand",
    f"""WITH {b.TRACES_SQL}, p AS (SELECT run, workload, arm, seq, time_s + 40000 AS px FROM traces),
    lo AS (SELECT p.*, t.time_s AS t0, t.power_W AS v0 FROM p ASOF LEFT JOIN traces t
      ON p.run = t.run AND p.workload = t.workload AND p.arm = t.arm AND p.px >= t.time_s),
    hi AS (SELECT lo.*, t.time_s AS t1, t.power_W AS v1 FROM lo ASOF LEFT JOIN traces t
      ON lo.run = t.run AND lo.workload = t.workload AND lo.arm = t.arm AND lo.px <= t.time_s)
    SELECT run, workload, arm, seq, coalesce(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (px - t0) * (v1 - v0) / (t1 - t0) END, v0, v1) AS demand
    FROM hi""",
)
def r16(spark, d):
    tr = b.traces(spark, d)
    points = tr.select(*b.TRACES.key, "seq", (F.col("time_s") + 40_000).alias("at"))
    return g.interpolate_at(points, tr.drop("seq"), b.TRACES, "power_W", "at", "demand")


@query(
    "r17_resample_ticks", "run, workload, arm, tick, ~3power_W",
    f"""WITH {b.TRACES_SQL}, e AS (SELECT run, workload, arm, min(time_s) AS a, max(time_s) AS z FROM traces GROUP BY 1, 2, 3 HAVING max(time_s) > min(time_s)),
    g AS (SELECT *, a + tick * ((z - a) / 59.0) AS px FROM (SELECT *, unnest(generate_series(0, 59)) AS tick FROM e)),
    lo AS (SELECT g.*, t.time_s AS t0, t.power_W AS v0 FROM g ASOF LEFT JOIN traces t
      ON g.run = t.run AND g.workload = t.workload AND g.arm = t.arm AND g.px >= t.time_s),
    hi AS (SELECT lo.*, t.time_s AS t1, t.power_W AS v1 FROM lo ASOF LEFT JOIN traces t
      ON lo.run = t.run AND lo.workload = t.workload AND lo.arm = t.arm AND lo.px <= t.time_s)
    SELECT run, workload, arm, CAST(tick AS BIGINT) AS tick, coalesce(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (px - t0) * (v1 - v0) / (t1 - t0) END, v0, v1) AS power_W FROM hi""",
)
def r17(spark, d):
    return g.resample_ticks(b.traces(spark, d), b.TRACES, "power_W", 60)


@query(
    "r18_rebase_time", "run, workload, arm, seq, ~time_s",
    f"WITH {b.TRACES_SQL} SELECT run, workload, arm, seq, time_s - min(time_s) OVER (PARTITION BY run, workload, arm) AS time_s FROM traces",
)
def r18(spark, d):
    return g.rebase(b.traces(spark, d), list(b.TRACES.key), "time_s")


@query(
    "r19_decimate", "run, workload, arm, seq",
    f"""WITH {b.TRACES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY run, workload, arm ORDER BY time_s) AS k FROM traces)
    SELECT * FROM n WHERE (k - 1) % 10 = 0""",
)
def r19(spark, d):
    return g.decimate(b.traces(spark, d), b.TRACES, 10)


@query(
    "r20_business_hours", "event_id, user_id",
    """SELECT event_id, user_id FROM events WHERE isodow(ts - INTERVAL 5 HOUR) <= 5
    AND hour(ts - INTERVAL 5 HOUR) >= 8 AND hour(ts - INTERVAL 5 HOUR) < 16""",
)
def r20(spark, d):
    return g.business_hours(b.events(spark, d), "ts", "America/New_York")


@query(
    "r21_drop_warmup", "run, workload, arm, seq, ~time_s",
    f"""WITH {b.TRACES_SQL}, k AS (SELECT *, min(time_s) OVER (PARTITION BY run, workload, arm) AS t0 FROM traces),
    l AS (SELECT *, count(*) OVER (PARTITION BY run, workload, arm) AS n FROM k WHERE time_s >= t0 + 2592000)
    SELECT * FROM l WHERE n >= 10""",
)
def r21(spark, d):
    return g.drop_warmup(b.traces(spark, d), list(b.TRACES.key), "time_s", 30 * b.DAY)[0]


@query(
    "r22_latest_rows", "server, event_id, ~power_watts",
    f"""WITH {b.SAMPLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY server ORDER BY ts DESC, event_id DESC) AS k FROM samples)
    SELECT * FROM r WHERE k <= 6""",
)
def r22(spark, d):
    return g.latest_rows(b.samples(spark, d), b.SAMPLES, 6)


@query(
    "r23_unpivot_metrics", "run, workload, arm, metric, ~value",
    f"""WITH {b.TRACES_SQL}, m AS (SELECT run, workload, arm, max(power_W) AS peak, avg(power_W) AS mean FROM traces GROUP BY 1, 2, 3)
    SELECT run, workload, arm, 'peak' AS metric, peak AS value FROM m UNION ALL SELECT run, workload, arm, 'mean', mean FROM m""",
)
def r23(spark, d):
    m = b.traces(spark, d).groupBy(*b.TRACES.key).agg(
        F.struct(F.max("power_W").alias("peak"), F.avg("power_W").alias("mean")).alias("power")
    )
    return g.melt(m, list(b.TRACES.key), {"peak": "power.peak", "mean": "power.mean"})


@query(
    "r24_memory_columns", "l_orderkey, l_partkey, l_linenumber, ~mem_used, ~mem_available, ~mem_swap_used",
    """SELECT l_orderkey, l_partkey, l_linenumber, (l_extendedprice - CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE l_tax END) * 1024 AS mem_used,
    CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE l_tax END * 1024 AS mem_available, (l_quantity - l_discount) * 1024 AS mem_swap_used FROM lineitem""",
)
def r24(spark, d):
    li = b.table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.col("l_extendedprice").alias("mem_total_kb"),
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).alias("mem_available_kb"),
        F.col("l_tax").alias("mem_free_kb"), F.col("l_tax").alias("cached_kb"),
        F.col("l_quantity").alias("swap_total_kb"), F.col("l_discount").alias("swap_free_kb"),
    )
    return g.memory_columns(li)


@query(
    "r25_first_number", "event_id, ~reading",
    """SELECT event_id, coalesce(TRY_CAST(event_type AS DOUBLE), CASE WHEN value > 50 THEN TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) END,
    TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)) AS reading FROM events""",
)
def r25(spark, d):
    return b.events(spark, d).select(
        "event_id",
        g.first_number(
            F.col("event_type"),
            F.when(F.col("value") > 50, F.col("value").cast("string")),
            F.regexp_extract("props", "([0-9]+)", 1),
        ).alias("reading"),
    )


@query(
    "r25_explode_readings", "event_id, member, ~reading",
    """SELECT event_id, 0 AS member, value AS reading FROM events
    UNION ALL SELECT event_id, 2, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) FROM events""",
)
def r25b(spark, d):
    item = lambda c: F.struct(c.cast("string").alias("ReadingWatts"))
    ev = b.events(spark, d).select(
        "event_id",
        F.array(
            item(F.col("value")), item(F.col("event_type")), item(F.regexp_extract("props", "([0-9]+)", 1))
        ).alias("PowerSupplies"),
    )
    return g.explode_readings(ev, "PowerSupplies", ["event_id"], "ReadingWatts", "reading")


@query(
    "r26_device_filters", "o_orderkey, device",
    """SELECT o_orderkey, device FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'sda' WHEN o_orderkey % 4 = 1 THEN 'sda1'
    WHEN o_orderkey % 4 = 2 THEN 'nvme0n1' ELSE 'lo' END AS device FROM orders) WHERE device IN ('sda', 'nvme0n1')""",
)
def r26(spark, d):
    k = F.col("o_orderkey") % 4
    name = F.when(k == 0, "sda").when(k == 1, "sda1").when(k == 2, "nvme0n1").otherwise("lo")
    df = b.table(spark, d, "orders").select("o_orderkey", name.alias("device"))
    return g.keep_devices(g.skip_interfaces(df, "device"), "device")


@query(
    "r27_align_offset", "run, workload, arm, seq, ~time_s",
    f"""WITH {b.TRACES_SQL}, o AS (SELECT run, workload, arm, min(time_s) + 100 AS off FROM traces WHERE arm <> 'O' GROUP BY 1, 2, 3)
    SELECT t.run, t.workload, t.arm, t.seq, t.time_s - coalesce(o.off, 0.0) AS time_s FROM traces t LEFT JOIN o USING (run, workload, arm)""",
)
def r27(spark, d):
    tr = b.traces(spark, d)
    off = tr.filter("arm <> 'O'").groupBy(*b.TRACES.key).agg((F.min("time_s") + 100).alias("offset"))
    return g.shift_time(tr, off, list(b.TRACES.key), "time_s")


@query(
    "r28_wall_clock_anchor", "event_id, off_h, anchor_us",
    """WITH s AS (SELECT event_id, date_trunc('second', ts) AS ev, ts - INTERVAL 4 HOUR - INTERVAL 90 SECOND AS loc FROM events),
    c AS (SELECT *, hour(loc) * 3600 + minute(loc) * 60 + second(loc) AS ls, hour(ev) * 3600 + minute(ev) * 60 + second(ev) AS us FROM s),
    o AS (SELECT *, CAST((CAST(round_even((us - ls) / 3600.0, 0) AS BIGINT) % 24 + 24) % 24 AS BIGINT) AS off_h FROM c),
    t AS (SELECT *, epoch_us(date_trunc('day', ev)) + (ls + off_h * 3600) * 1000000 AS stamp, epoch_us(ev) AS ref FROM o)
    SELECT event_id, off_h, CAST(stamp - greatest(ceil((stamp - ref - 43200000000) / 86400000000), 0) * 86400000000
      + greatest(ceil((ref - stamp - 43200000000) / 86400000000), 0) * 86400000000 - 12500000 AS BIGINT) AS anchor_us FROM t""",
)
def r28(spark, d):
    ev = b.events(spark, d).select(
        "event_id", F.date_trunc("second", "ts").alias("ev"),
        F.expr("ts - INTERVAL 4 HOURS - INTERVAL 90 SECONDS").alias("loc"),
    )
    hms = [F.hour("loc"), F.minute("loc"), F.second("loc")]
    ev = ev.withColumn("off_h", g.utc_offset_hours(F.col("ev"), hms))
    at = g.anchor_utc(F.col("ev"), hms, F.col("off_h"), F.lit(12.5))
    return ev.withColumn("anchor_us", US(at))


@query("o1_sort_by_time", "event_id, user_id, ~value", "SELECT event_id, user_id, value FROM events ORDER BY ts, event_id")
def o1(spark, d):
    return b.events(spark, d).orderBy("ts", "event_id")


@query("o4_head_by_time", "event_id, user_id, ~value", "SELECT event_id, user_id, value FROM events ORDER BY ts, event_id LIMIT 100")
def o4(spark, d):
    return b.events(spark, d).orderBy("ts", "event_id").limit(100)


@query(
    "u1_union_chunks", "server, event_id, ~value, chunk",
    f"""WITH {b.LONG_SQL} SELECT server, event_id, value, 'a' AS chunk FROM long WHERE ts < TIMESTAMP '2024-01-11'
    UNION ALL SELECT server, event_id, value, NULL FROM long WHERE ts >= TIMESTAMP '2024-01-11'""",
)
def u1(spark, d):
    long = b.telemetry_long(spark, d)
    first = readers.between(long, "ts", None, "2024-01-11").withColumn("chunk", F.lit("a"))
    return readers.union_chunks([first, readers.between(long, "ts", "2024-01-11", None)])


@query(
    "u2_index_union", "server, h",
    f"""WITH {b.LONG_SQL} SELECT server, epoch_us(ts) // 3600000000 AS h FROM long WHERE measurement = 'error'
    UNION SELECT server, epoch_us(ts) // 3600000000 FROM long WHERE measurement = 'click'""",
)
def u2(spark, d):
    long = b.telemetry_long(spark, d).withColumn("h", F.floor(US("ts") / F.lit(3_600_000_000)))
    pick = lambda m: long.filter(F.col("measurement") == m).select("server", "h")
    return pick("error").union(pick("click")).distinct()


@query("u4_distinct_grid", "~grid", "SELECT DISTINCT round(value, 0) AS grid FROM events")
def u4(spark, d):
    return b.events(spark, d).select(F.round("value", 0).alias("grid")).distinct().orderBy("grid")
