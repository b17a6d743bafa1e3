"""Scans of capture, trace, document and log files, and table ranges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.plans.asof import asof
from wattframe.series import Series

# File name patterns and document formats of the inputs.
RUN_PATTERN = r"/run(\d+)/"
NAME_PATTERN = r"/([a-z0-9]+)_([a-z0-9]+)(?:_[^/]*)?\.[a-z.]+$"
# workload, arm, optional run, optional fleet size
DOC_PATTERN = r"/([a-z0-9]+)_([a-z]+)(?:_r(\d+))?(?:_N(\d+))?_worst/"

EVENT_SCHEMA = (
    "ts TIMESTAMP, event STRING, dry_run BOOLEAN, power_w DOUBLE, dir INT, reason STRING, "
    "deriv_w_s DOUBLE, ceiling_w DOUBLE, held_s DOUBLE, ballast_peak_c DOUBLE"
)

METRICS_SCHEMA = """
power STRUCT<peak_MW: DOUBLE, mean_MW: DOUBLE, trace_energy_MJ: DOUBLE>,
risk STRUCT<rrei_exceedances_per_year: DOUBLE, nrs_MW_per_year: DOUBLE,
  lole_proxy_days_per_year: DOUBLE, lole_target_days_per_year: DOUBLE, lole_ratio: DOUBLE,
  cv: DOUBLE, peak_to_mean: DOUBLE, n_exceedances_in_trace: INT, ramp_limit_MW_s: DOUBLE,
  trace_duration_s: DOUBLE, warmup_s: DOUBLE>,
thresholds STRUCT<ramp_limit_MW_s: DOUBLE, ramp_limit_source: STRING,
  lole_target_days_per_yr: DOUBLE, lole_source: STRING>,
frequency STRUCT<freq_nadir_hz: DOUBLE, freq_nadir_deviation_hz: DOUBLE,
  rocof_max_hz_per_s: DOUBLE, under_freq_events_per_year: DOUBLE, under_freq_limit_hz: DOUBLE>,
voltage STRUCT<min_voltage_pu: DOUBLE, voltage_sag_depth_pu: DOUBLE, voltage_sag_limit_pu: DOUBLE,
  voltage_sag_events_per_yr: DOUBLE, mean_voltage_pu: DOUBLE>,
efficiency STRUCT<hpl_gflops_server: DOUBLE, fleet_tflops_sustained: DOUBLE,
  gflops_per_watt_server: DOUBLE>
"""


def _path() -> Column:
    return F.col("_metadata.file_path")


def _place() -> Column:
    """Order of lines within their file, also where the file is split: the
    split's first byte plus the line's number within the task, which is less
    than the split's bytes."""
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") + in_task


def _positional(spark: SparkSession, path, names: Sequence[str]) -> DataFrame:
    """The first columns of a CSV as doubles, whatever follows them; text that
    is no finite number becomes null."""
    raw = spark.read.schema(", ".join(f"{n} STRING" for n in names)).csv(path, header=True, mode="PERMISSIVE")
    number = {n: F.trim(n).try_cast("double") for n in names}
    finite = {n: F.when(F.abs(c) < float("inf"), c).alias(n) for n, c in number.items()}
    return raw.select(*finite.values(), _path().alias("_wf_path"), _place().alias("seq"))


def _file_keys(df: DataFrame) -> DataFrame:
    run = F.regexp_extract("_wf_path", RUN_PATTERN, 1).try_cast("int")
    return df.withColumns(
        {
            "run": run,
            "workload": F.regexp_extract("_wf_path", NAME_PATTERN, 1),
            "arm": F.regexp_extract("_wf_path", NAME_PATTERN, 2),
        }
    ).drop("_wf_path")


def read_traces(spark: SparkSession, path) -> DataFrame:
    """Positional power traces: the first two columns, header text ignored,
    broken rows dropped, keys from the file name (S1).  ``seq`` keeps the
    written order."""
    rows = _positional(spark, path, ["time_s", "power_W"])
    return _file_keys(rows.na.drop(subset=["time_s", "power_W"]))


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """Power capture in either accepted schema."""
    raw = spark.read.csv(path, header=True)
    cols = set(raw.columns)
    if {"time_s", "power_W"} <= cols:
        t, p = "time_s", "power_W"
    elif "mono_s" in cols and "watts" in cols:
        t, p = "mono_s", "watts"
    else:
        raise ValueError(f"unrecognised columns: {raw.columns}")
    return raw.select(F.col(t).try_cast("double").alias("time_s"), F.col(p).try_cast("double").alias("power_W"))


def between(df: DataFrame, ts: str, start: str | None, end: str | None) -> DataFrame:
    """Half-open time range ``[start, end)``; the literals push to the scan."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(ts) < F.lit(end).cast("timestamp"))
    return df


def read_telemetry(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
    date: str = "date",
) -> DataFrame:
    """Cached telemetry in ``[start, end)``, pruned on the date partition."""
    df = spark.read.parquet(path)
    if date in df.columns:
        if start is not None:
            df = df.filter(F.col(date) >= F.to_date(F.lit(start).cast("timestamp")))
        if end is not None:
            df = df.filter(F.col(date) <= F.to_date(F.lit(end).cast("timestamp")))
    return between(df, "ts", start, end)


def read_hf(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """High-rate capture with mixed ISO-8601 fractions."""
    raw = spark.read.csv(path, header=True)
    cols = {c: F.col(c).try_cast("double") for c in raw.columns if c != "time"}
    return between(raw.withColumns({"time": F.try_to_timestamp("time"), **cols}), "time", start, end)


def scan_points(
    long: DataFrame, measurements: Sequence[str], start: str | None = None, end: str | None = None,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """Narrow points filtered by measurement, field and time."""
    out = long.filter(F.col("measurement").isin(*measurements))
    if fields is not None:
        out = out.filter(F.col("field").isin(*fields))
    return between(out, "ts", start, end)


def read_annotated(spark: SparkSession, path: str, width: float = 1 << 26) -> DataFrame:
    """Annotated CSV exports (S7): columns by each table block's own header,
    ``true``/``false`` as 1/0, first point kept per time.

    Every line looks back to the last header of its file, which a comment or a
    blank line ends; a block without time and value columns gives no points,
    nor does an empty or unreadable time or value.  Lines are spread by ``width``
    bytes of their file, so a large file is not read by one task alone.
    """
    lines = spark.read.text(path).select(
        _path().alias("path"), _place().cast("double").alias("pos"),
        F.transform(F.split("value", ","), lambda c: F.trim(c)).alias("cell"),
    )
    ends = (F.size("cell") == 1) & (F.col("cell")[0] == "") | F.col("cell")[0].startswith("#")
    time_at, value_at = (F.array_position("cell", c).cast("int") for c in ("_time", "_value"))
    heads = (time_at > 0) & (value_at > 0)
    marks = lines.filter(ends | heads).select(
        "path", "pos", F.when(~ends, time_at).alias("t"), F.when(~ends, value_at).alias("v")
    )
    rows = asof(
        lines.filter(~(ends | heads)), marks, Series(("path",), "pos", (), width), columns={"t": "time_at", "v": "value_at"}
    ).filter("time_at IS NOT NULL")
    word = F.try_element_at("cell", F.col("value_at"))
    value = F.when(word == "true", 1.0).when(word == "false", 0.0).otherwise(word.try_cast("double"))
    time = F.regexp_replace(F.try_element_at("cell", F.col("time_at")), r"(\.\d{6})\d*", "$1")
    points = rows.select("path", "pos", F.try_to_timestamp(time).alias("ts"), value.alias("value"))
    first = points.na.drop(subset=["ts", "value"]).groupBy("path", "ts").agg(F.min_by("value", "pos").alias("value"))
    return first.orderBy("path", "ts")


def read_epoch(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """Epoch seconds and value, positional."""
    ok = _positional(spark, path, ["epoch", name]).filter("epoch IS NOT NULL")
    return ok.select(F.timestamp_micros(F.bround(F.col("epoch") * 1e6).cast("long")).alias("ts"), name)


def read_metrics(spark: SparkSession, path) -> DataFrame:
    """Nested metrics documents keyed by run, workload, arm and fleet size."""
    docs = spark.read.schema(METRICS_SCHEMA).json(path, multiLine=True)
    docs = docs.select("*", _path().alias("_wf_path"))
    part = lambda i: F.regexp_extract("_wf_path", DOC_PATTERN, i)
    return docs.withColumns(
        {
            "workload": part(1),
            "arm": part(2),
            "run": F.when(part(3) != "", part(3)).cast("int"),
            "n_servers": F.coalesce(F.when(part(4) != "", part(4)).cast("int"), F.lit(10_000)),
        }
    ).drop("_wf_path")


def read_event_log(spark: SparkSession, path) -> DataFrame:
    """JSONL events; other lines and rows without ``ts`` are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), _path().alias("_wf_path"))
    parsed = lines.filter(F.col("line").startswith("{")).select(
        F.from_json("line", EVENT_SCHEMA).alias("e"), "_wf_path"
    )
    return _file_keys(parsed.select("e.*", "_wf_path").filter("ts IS NOT NULL"))


#: Fixed value: the stamped line that the logs contain.
PHASE_PATTERN = r"^\[(\d{2}):(\d{2}):(\d{2})\]\s+(\w+)\s+(START|STOP).*?t=\s*([\d.]+)\s*s"


def read_phase_log(spark: SparkSession, path) -> DataFrame:
    """Stamped phase lines with clock parts and relative time."""
    lines = spark.read.text(path).select(
        F.trim("value").alias("line"), _path().alias("_wf_path"),
        _place().alias("line_no"),
    )
    part = lambda i: F.regexp_extract("line", PHASE_PATTERN, i)
    hit = lines.filter(F.col("line").rlike(PHASE_PATTERN))
    return _file_keys(
        hit.select(
            part(1).cast("int").alias("hh"), part(2).cast("int").alias("mm"),
            part(3).cast("int").alias("ss"), part(4).alias("kind"), part(5).alias("edge"),
            part(6).cast("double").alias("t_rel"), "line_no", "_wf_path",
        )
    )


def clock_anchor(phases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First stamped line per log: the clock anchor."""
    first = F.min_by(F.struct("hh", "mm", "ss", "t_rel"), "line_no").alias("a")
    return phases.groupBy(*keys).agg(first).select(
        *keys, "a.hh", "a.mm", "a.ss", F.col("a.t_rel").alias("anchor_rel")
    )


def read_benchmark_log(spark: SparkSession, path) -> DataFrame:
    """Last result line per file: solve seconds and Gflops."""
    lines = spark.read.text(path).select(
        "value", _path().alias("_wf_path"), _place().alias("line_no")
    )
    words = F.split(F.trim("value"), r"\s+")
    hit = lines.filter(F.col("value").rlike(r"^W[RC][0-9]")).select(
        "_wf_path", "line_no",
        F.element_at(words, -2).try_cast("double").alias("solve_s"),
        F.element_at(words, -1).try_cast("double").alias("gflops"),
    )
    last = hit.groupBy("_wf_path").agg(F.max_by(F.struct("solve_s", "gflops"), "line_no").alias("r"))
    return _file_keys(last.select("r.*", "_wf_path"))


def union_chunks(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack chunks by column name; absent columns become null."""
    return reduce(lambda a, c: a.unionByName(c, allowMissingColumns=True), parts)


def merge_latest(cached: DataFrame, fresh: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """Cached rows plus fresh ones, latest version per key."""
    from wattframe.operators.grid import keep_last

    return keep_last(union_chunks([cached, fresh]), keys, newest)


def load_incremental(
    spark: SparkSession, source: DataFrame, target: str, keys: Sequence[str], newest: str,
    overlap: str = "0 seconds",
) -> DataFrame:
    """Append what lies past the newest cached time.

    Only the date partitions that receive rows are rewritten, after the merge
    has been written beside the target, so a failed run leaves it whole.
    """
    cached = spark.read.parquet(target)
    last = cached.agg((F.max("ts") - F.expr(f"INTERVAL {overlap}")).alias("t")).first()["t"]
    fresh = source.filter(F.col("ts") >= F.lit(last)) if last is not None else source
    fresh = fresh.withColumn("date", F.to_date("ts"))
    dates = fresh.select("date").distinct()
    touched = cached.join(dates, "date", "left_semi")
    merged = merge_latest(touched, fresh, keys, newest)
    staging = f"{target.rstrip('/')}_staging"
    merged.write.mode("overwrite").partitionBy("date").parquet(staging)
    assert_unique(spark.read.parquet(staging), keys)
    (
        spark.read.parquet(staging)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(target)
    )
    return spark.read.parquet(target)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Fail when a key occurs twice."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"duplicate rows for {list(keys)}")
