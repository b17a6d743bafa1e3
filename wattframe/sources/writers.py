"""Batch sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Scoreboard or matrix as CSV or Parquet (K1)."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """Nested metrics documents as JSON lines (K2)."""
    docs.write.mode("overwrite").json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Append rows to a metrics log (K3)."""
    df.write.mode("append").json(path)


def write_telemetry(df: DataFrame, path: str, by: Sequence[str] = ("date",), ts: str = "ts") -> None:
    """Telemetry partitioned by date (and measurement), clustered for range scans."""
    dated = df.withColumn("date", F.to_date(ts)) if "date" not in df.columns else df
    dated.write.mode("overwrite").partitionBy(*by).parquet(path)


def export_trace(df: DataFrame, keys: Sequence[str], path: str, ts: str = "ts", value: str = "value", epoch: bool = False) -> DataFrame:
    """``time_s, value`` export, rebased per key or absolute (K6)."""
    seconds = F.unix_micros(ts) / F.lit(1_000_000.0)
    if not epoch:
        start = df.groupBy(*keys).agg((F.min(F.unix_micros(ts)) / F.lit(1_000_000.0)).alias("_t0"))
        df = df.join(start, list(keys))
        seconds = seconds - F.col("_t0")
    out = df.select(*keys, F.round(seconds, 6).alias("time_s"), F.col(value).alias("power_W"))
    out.repartition(*keys).sortWithinPartitions(*keys, "time_s").write.mode("overwrite").partitionBy(*keys).option(
        "header", True
    ).csv(path)
    return out
