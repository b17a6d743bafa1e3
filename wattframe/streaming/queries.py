"""Streaming queries over telemetry."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wattframe.plans.folds import Step
from wattframe.streaming import steps

STATE = T.StructType([T.StructField("values", T.ArrayType(T.DoubleType()))])


class SeriesProcessor(StatefulProcessor):
    """Runs a step over each series, keeping its flat state per key."""

    def __init__(self, step: Step, ts: str, ttl_ms: int | None):
        self.step, self.ts, self.ttl_ms = step, ts, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.ts, kind="stable").reset_index(drop=True)
        kept = list(self.state.get()[0]) if self.state.exists() else None
        out, state = self.step(kept, pdf)
        self.state.update(([float(v) for v in state],))
        yield out

    def close(self) -> None:
        pass


class TimedProcessor(SeriesProcessor):
    """A step whose state also changes with time alone.

    ``wake(state)`` gives the second at which it does; a timer is set there, and
    if no row has come up to it when the watermark passes, ``silent(key, at,
    state)`` gives the rows to emit and the new state.
    """

    def __init__(self, step: Step, ts: str, wake: Callable, silent: Callable):
        super().__init__(step, ts, None)
        self.wake, self.silent = wake, silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from super().handleInputRows(key, rows, timerValues)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if (at := self.wake(self.state.get()[0])) is not None:
            self.handle.registerTimer(math.ceil(at * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = list(self.state.get()[0])
        if (at := self.wake(state)) is not None:
            out, state = self.silent(key, at, state)
            self.state.update(([float(v) for v in state],))
            yield out


class RingProcessor(StatefulProcessor):
    """A step whose state ends in a bounded window of values (T5).

    The first ``head`` numbers are one value; the window is kept in numbered
    chunks of ``CHUNK`` values. A batch reads the window once and writes the
    chunks it adds to, and drops those that have left.
    """

    CHUNK = 512

    def __init__(self, step: Step, ts: str, head: int, window: int):
        self.step, self.ts, self.head, self.window = step, ts, head, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scalars = handle.getValueState("head", STATE)
        self.chunks = handle.getMapState("ring", "chunk LONG", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.ts, kind="stable").reset_index(drop=True)
        kept, seen, held = None, 0, {}
        if self.scalars.exists():
            *kept, seen = self.scalars.get()[0]
            seen = int(seen)
            held = {int(k[0]): v[0] for k, v in self.chunks.iterator()}
            kept += [x for k in sorted(held) for x in held[k]][-self.window :]
        out, state = self.step(kept, pdf)
        ring, now = state[self.head :], seen + len(pdf)
        oldest = now - len(ring)
        for chunk in range(max(seen, oldest) // self.CHUNK, (now - 1) // self.CHUNK + 1):
            lo, hi = chunk * self.CHUNK, min((chunk + 1) * self.CHUNK, now)
            # Places of values that have left are held, never read.
            values = [0.0] * max(oldest - lo, 0) + [float(x) for x in ring[max(lo - oldest, 0) : hi - oldest]]
            self.chunks.updateValue((chunk,), (values,))
        for chunk in held:
            if (chunk + 1) * self.CHUNK <= oldest:
                self.chunks.removeKey((chunk,))
        self.scalars.update(([*[float(x) for x in state[: self.head]], float(now)],))
        yield out

    def close(self) -> None:
        pass


def _transformed(stream: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema, mode: str) -> DataFrame:
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode=mode
    )


def edge_pulses(
    stream: DataFrame, keys: Sequence[str], ts: str, usage: str, schema: T.StructType | str, threshold: float = 10.0,
    min_slope: float = 25.0, pulse_s: float = 1.0, cooldown_s: float = 5.0, watermark: str = "10 seconds",
) -> DataFrame:
    """Pulses that end by themselves: a server that falls silent gets a row of no risk at the pulse's end."""
    step = steps.edge_pulse(keys, ts, usage, threshold, min_slope, pulse_s, cooldown_s)
    processor = TimedProcessor(step, ts, steps.pulse_end(pulse_s), steps.quiet_row(keys, ts))
    return _transformed(stream.withWatermark(ts, watermark), keys, processor, schema, "EventTime")


def rank_alarms(
    stream: DataFrame, keys: Sequence[str], ts: str, score: str, schema: T.StructType | str, window: int = 18_000,
    watermark: str = "10 seconds", **options,
) -> DataFrame:
    """Rolling rank threshold and refractory flags, its window kept in chunks (T5)."""
    step = steps.rank_alarm(keys, ts, score, window, **options)
    return _transformed(stream.withWatermark(ts, watermark), keys, RingProcessor(step, ts, 3, window), schema, "None")


def stateful(
    stream: DataFrame, keys: Sequence[str], ts: str, step: Step, schema: T.StructType | str,
    watermark: str = "10 seconds", ttl_ms: int | None = None,
) -> DataFrame:
    """Apply a step per series; rows behind the watermark are dropped (T2-T6,
    T10, T11).  ``ttl_ms`` forgets silent series."""
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(*keys)
        .transformWithStateInPandas(
            statefulProcessor=SeriesProcessor(step, ts, ttl_ms),
            outputStructType=schema,
            outputMode="append",
            timeMode="ProcessingTime" if ttl_ms else "None",
        )
    )


def tumbling_mean(
    stream: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value", step: str = "1 second",
    watermark: str = "10 seconds",
) -> DataFrame:
    """Mean per fixed window and key."""
    win = F.window(ts, step)
    out = stream.withWatermark(ts, watermark).groupBy(win, *keys).agg(F.avg(value).alias(value))
    return out.select(*keys, F.col("window.start").alias(ts), value)


def alert_episodes(
    alerts: DataFrame, keys: Sequence[str], ts: str = "ts", gap_s: float = 2.0, watermark: str = "10 seconds"
) -> DataFrame:
    """Alerts merged while at most ``gap_s`` apart (T7); a session ends one gap
    after its last alert."""
    win = F.session_window(ts, f"{int(gap_s * 1_000_000)} microseconds")
    out = alerts.withWatermark(ts, watermark).groupBy(*keys, win).agg(F.count(F.lit(1)).alias("n_points"))
    end = F.timestamp_micros(F.unix_micros("session_window.end") - F.lit(int(gap_s * 1_000_000)))
    return out.select(*keys, F.col("session_window.start").alias("start_ts"), end.alias("end_ts"), "n_points")


def unique_points(stream: DataFrame, keys: Sequence[str], ts: str = "ts", watermark: str = "10 seconds") -> DataFrame:
    """First of each duplicate point."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([*keys, ts])


def fresh_risk(latest: DataFrame, max_age_s: float, now: Column | None = None, ts: str = "updated_ts") -> DataFrame:
    """Latest flags that are young enough; an old flag means no signal."""
    now = F.current_timestamp() if now is None else now
    age = (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(1_000_000.0)
    return latest.withColumn("risk", F.when(age <= max_age_s, F.col("risk")).otherwise(0))


def append_batches(path: str, keys: Sequence[str] = ("server",), ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer, one directory per batch so that a replayed
    batch replaces itself (K4)."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write


def publish_latest(
    path: str, keys: Sequence[str] = ("server",), ts: str = "ts", risk: str = "risk", compact_every: int = 50
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of the newest risk per server (K5).

    One folder a batch, so that a replayed batch replaces itself. Every
    ``compact_every`` batches all folders become one, with a row per server, and
    then go; a reader takes the newest row of all folders there are, so it sees
    the same before, between and after.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(risk, ts).alias("risk"), F.max(ts).alias("updated_ts"))
        newest.write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        if (epoch + 1) % compact_every == 0:
            _compact(batch.sparkSession, path, keys, epoch)

    return write


def _compact(spark: SparkSession, path: str, keys: Sequence[str], epoch: int) -> None:
    """One row per key of all folders, written beside them under a name that no reader takes, then put in their place."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(fs_path(path)) if s.getPath().getName().startswith("batch=")]
    made = f"{path}/_compact-{epoch}"
    read_latest(spark, path, keys).write.mode("overwrite").parquet(made)
    fs.rename(fs_path(made), fs_path(f"{path}/batch={epoch}.all"))
    for p in old:
        fs.delete(p, True)


def read_latest(spark: SparkSession, path: str, keys: Sequence[str] = ("server",)) -> DataFrame:
    """Newest published risk per server (K5)."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path).groupBy(*keys).agg(
        F.max_by("risk", "updated_ts").alias("risk"), F.max("updated_ts").alias("updated_ts")
    )


def score_batches(predict: Callable[[DataFrame], DataFrame], path: str, latest: str | None = None) -> Callable[[DataFrame, int], None]:
    """Score each micro-batch of features with a model and publish it."""
    store = append_batches(path)
    flag = publish_latest(latest, risk="spike_risk") if latest else None

    def write(batch: DataFrame, epoch: int) -> None:
        scored = predict(batch).persist()
        store(scored, epoch)
        if flag:
            flag(scored, epoch)
        scored.unpersist()

    return write
