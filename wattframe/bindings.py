"""Telemetry-shaped views of the star-schema test tables.

Each view has a Spark builder and the same definition as a SQL common table
expression, so a query and its SQL check start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.plans.timeline import Timeline, running_sum
from wattframe.series import Series

DAY = 86_400.0

SAMPLES = Series(("server",), "ts", ("event_id",), 5 * DAY)
TRACES = Series(("run", "workload", "arm"), "time_s", (), 45 * DAY)
COUNTERS = Series(("server", "socket"), "t_s", (), 730 * DAY)
COUNTER_SERVERS = Series(("server",), "t_s", (), 730 * DAY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def telemetry_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow points: server, ts, measurement, value."""
    return events(spark, sf_dir).select(
        (F.col("user_id") % 10).alias("server"), "ts", "event_id",
        F.col("event_type").alias("measurement"), "value",
    )


LONG_SQL = """long AS (
  SELECT user_id % 10 AS server, ts, event_id, event_type AS measurement, value FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per event; the server is the user."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    kind = F.col("event_type")
    return events(spark, sf_dir).withColumn("k", k).select(
        F.col("user_id").alias("server"), "ts", "event_id",
        (F.col("value") / 0.997).alias("power_watts"),
        F.col("k").alias("usage_percent"),
        (F.col("event_id") % 17).cast("double").alias("nr_running"),
        F.when(kind != "view", 40 + F.col("value") / 8).alias("temp_celsius"),
        F.when(kind != "signup", 1000 + 20 * F.col("k")).alias("freq_mhz"),
        (F.col("k") % 7).alias("procs_running"),
        kind.alias("kind"),
    )


SAMPLES_SQL = """samples AS (
  SELECT user_id AS server, ts, event_id, value / 0.997 AS power_watts, k AS usage_percent,
    CAST(event_id % 17 AS DOUBLE) AS nr_running,
    CASE WHEN event_type <> 'view' THEN 40 + value / 8 END AS temp_celsius,
    CASE WHEN event_type <> 'signup' THEN 1000 + 20 * k END AS freq_mhz,
    k % 7 AS procs_running, event_type AS kind
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events))"""


NODE_SIGNALS = {
    "purchase": "power_watts",
    "view": "usage_percent",
    "click": "temp_celsius",
    "error": "freq_mhz",
    "signup": "nr_running",
}


def node_wide(spark: SparkSession, sf_dir: str, step_s: float = 21_600.0) -> DataFrame:
    """Wide 6-hour frame per server."""
    from wattframe.operators.grid import floor_time, pivot_signals

    long = telemetry_long(spark, sf_dir).withColumn("ts", floor_time(F.col("ts"), step_s))
    return pivot_signals(long, ["server", "ts"], NODE_SIGNALS)


NODE_SQL = f"""{LONG_SQL}, node_wide AS (
  SELECT server, make_timestamp((epoch_us(ts) // 21600000000) * 21600000000) AS ts,
    avg(CASE WHEN measurement = 'purchase' THEN value END) AS power_watts,
    avg(CASE WHEN measurement = 'view' THEN value END) AS usage_percent,
    avg(CASE WHEN measurement = 'click' THEN value END) AS temp_celsius,
    avg(CASE WHEN measurement = 'error' THEN value END) AS freq_mhz,
    avg(CASE WHEN measurement = 'signup' THEN value END) AS nr_running
  FROM long GROUP BY 1, 2)"""
NODES = Series(("server",), "ts", (), 10 * DAY)


def raw_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One power sample per order, as written (times may repeat)."""
    d = F.col("o_orderdate").cast("timestamp")
    start = F.date_trunc("quarter", d)
    day = ((F.unix_micros(d) - F.unix_micros(start)) / 86_400_000_000).cast("long")
    return table(spark, sf_dir, "orders").select(
        (F.year(d) * 4 + F.quarter(d)).cast("long").alias("run"),
        F.col("o_orderpriority").alias("workload"),
        F.col("o_orderstatus").alias("arm"),
        (day * 86_400 + F.col("o_orderkey") % 86_400).cast("double").alias("time_s"),
        (F.col("o_totalprice") / 997.0).alias("power_W"),
        F.col("o_orderkey").alias("seq"),
    )


RAW_TRACES_SQL = """raw_traces AS (
  SELECT CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS BIGINT) AS run,
    o_orderpriority AS workload, o_orderstatus AS arm,
    CAST(date_diff('day', date_trunc('quarter', o_orderdate), o_orderdate) * 86400
      + o_orderkey % 86400 AS DOUBLE) AS time_s,
    o_totalprice / 997.0 AS power_W, o_orderkey AS seq
  FROM orders)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power traces with one row per time, the first written one."""
    from wattframe.operators.grid import unique_time

    return unique_time(raw_traces(spark, sf_dir), list(TRACES.key), "time_s", "seq")


TRACES_SQL = f"""{RAW_TRACES_SQL}, traces AS (
  SELECT run, workload, arm, time_s, power_W, seq FROM (
    SELECT *, row_number() OVER (PARTITION BY run, workload, arm, time_s ORDER BY seq) AS r
    FROM raw_traces) WHERE r = 1)"""

COUNTER_RANGE = 5_000.0


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wrapping energy counter per supplier and socket, with stalled polls."""
    d = F.col("l_shipdate").cast("timestamp")
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("server"),
        (F.col("l_linenumber") % 2).cast("long").alias("socket"),
        (F.unix_micros(d) / 1_000_000 + F.col("l_orderkey") % 86_400).cast("double").alias("t_s"),
        F.when(F.col("l_quantity") > 10, F.col("l_quantity")).otherwise(0.0).alias("inc"),
    )
    polls = li.groupBy("server", "socket", "t_s").agg(F.sum("inc").alias("inc"))
    total = Timeline(polls, COUNTERS).scan(total=running_sum(F.col("inc"))).done()
    return total.select(
        "server", "socket", "t_s",
        (F.col("total") % F.lit(COUNTER_RANGE)).alias("energy_uj"),
        F.lit(COUNTER_RANGE).alias("max_range"),
        F.col("total").alias("raw_total"),
    )


COUNTERS_SQL = """polls AS (
  SELECT l_suppkey AS server, CAST(l_linenumber % 2 AS BIGINT) AS socket,
    CAST(epoch_us(l_shipdate) / 1000000 + l_orderkey % 86400 AS DOUBLE) AS t_s,
    sum(CASE WHEN l_quantity > 10 THEN l_quantity ELSE 0.0 END) AS inc
  FROM lineitem GROUP BY 1, 2, 3),
counters AS (
  SELECT server, socket, t_s, total % 5000.0 AS energy_uj, 5000.0 AS max_range, total AS raw_total
  FROM (SELECT *, sum(inc) OVER (PARTITION BY server, socket ORDER BY t_s) AS total FROM polls))"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground-truth events per user."""
    ev = events(spark, sf_dir).filter("event_type = 'error'")
    return ev.select(F.col("user_id").alias("server"), "ts", "event_id")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector alerts per user."""
    ev = events(spark, sf_dir).filter("event_type = 'click'")
    return ev.select(F.col("user_id").alias("server"), "ts", "event_id")


MATCH_SQL = """truth AS (SELECT user_id AS server, ts, event_id FROM events WHERE event_type = 'error'),
alerts AS (SELECT user_id AS server, ts, event_id FROM events WHERE event_type = 'click')"""
MATCH = Series(("server",), "ts", ("event_id",), 5 * DAY)
