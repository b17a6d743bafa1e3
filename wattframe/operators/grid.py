"""Reshaping telemetry and putting it on uniform time grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.plans.asof import asof
from wattframe.plans.timeline import (
    Timeline,
    by_time,
    first_seen,
    following,
    last_seen,
    number_rows,
    previous,
    reach,
    series_max,
)
from wattframe.series import MICROS, Series

#: Grid points that one row may expand to at a time.
PIECE = 100_000

# Store measurement -> canonical signal name.
BASE_SIGNALS = {
    "cpu_power": "power_watts",
    "cpu_freq": "freq_mhz",
    "cpu_temp": "temp_celsius",
    "cpu_usage": "usage_percent",
    "pdu_power": "pdu_watts",
}

# Fixed values: "measurement.field" -> canonical upstream signal name.
UPSTREAM_SIGNALS = {
    "run_queue.nr_running": "nr_running",
    "system.procs_running": "procs_running",
    "system.load1": "load1",
    "system.load5": "load5",
    "system.load15": "load15",
    "system.ctxt_per_s": "ctxt_per_s",
    "mem.used": "mem_used",
    "mem.available": "mem_available",
    "mem.cached": "mem_cached",
    "mem.swap_used": "mem_swap_used",
    "disk_io.read_bps": "disk_read_bps",
    "disk_io.write_bps": "disk_write_bps",
    "net_io.rx_bps": "net_rx_bps",
    "net_io.tx_bps": "net_tx_bps",
}


def round_time(ts: Column, step_s: float) -> Column:
    """Round a timestamp to a step, halves to the even multiple."""
    step = int(round(step_s * MICROS))
    us = F.unix_micros(ts.cast("timestamp"))
    q = F.floor(us / F.lit(step)).cast("long")
    twice = 2 * (us - q * step)
    up = (twice > step) | ((twice == step) & (q % 2 != 0))
    return F.timestamp_micros((q + F.when(up, 1).otherwise(0)) * F.lit(step))


def floor_time(ts: Column, step_s: float) -> Column:
    """Start of the fixed interval holding a timestamp."""
    step = int(round(step_s * MICROS))
    q = F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(step)).cast("long")
    return F.timestamp_micros(q * F.lit(step))


def pivot_signals(
    long: DataFrame, keys: Sequence[str], names: Mapping[str, str], name: str = "measurement",
    value: str = "value",
) -> DataFrame:
    """Long to wide, mean on collision.

    ``names`` maps stored names to canonical columns; the explicit list keeps
    the pivot a single partial + final aggregate with no discovery pass.
    """
    return long.groupBy(*keys).agg(
        *[F.avg(F.when(F.col(name) == src, F.col(value))).alias(dst) for src, dst in names.items()]
    )


def pivot_fields(
    long: DataFrame, keys: Sequence[str], names: Mapping[str, str] = UPSTREAM_SIGNALS
) -> DataFrame:
    """Pivot on ``measurement.field`` with canonical names."""
    tagged = long.withColumn("_wf_name", F.concat_ws(".", "measurement", "field"))
    wide = pivot_signals(tagged.filter(F.col("_wf_name").isin(*names)), keys, names, "_wf_name")
    return wide


def rename_signals(df: DataFrame, names: Mapping[str, str] = BASE_SIGNALS) -> DataFrame:
    """Canonical column names, absent ones skipped."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def mean_by(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean across cores or devices sharing the keys."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def downsample(
    df: DataFrame, keys: Sequence[str], step_s: float, value: str = "value", ts: str = "ts",
    stamp: str = "start",
) -> DataFrame:
    """Fixed-interval mean without empty intervals.

    ``stamp`` is the interval end the row carries: ``start`` or ``stop`` (the
    convention of common time-series stores).
    """
    at = floor_time(F.col(ts), step_s)
    if stamp == "stop":
        at = F.timestamp_micros(F.unix_micros(at) + int(round(step_s * MICROS)))
    rest = [k for k in keys if k != ts]
    return df.groupBy(*rest, at.alias(ts)).agg(F.avg(value).alias(value))


def reindex(df: DataFrame, series: Series, step_s: float) -> DataFrame:
    """Complete uniform grid between each key's first and last row.

    Ticks are generated bucket by bucket, never as one array per series.
    """
    step = int(round(step_s * MICROS))
    per = max(int(series.width * MICROS) // step, 1) * step
    us = F.unix_micros(F.col(series.ts))
    ends = df.groupBy(*series.key).agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"))
    slabs = ends.withColumn(
        "_slab", F.explode(F.expr(f"sequence(_lo, _hi, {per}L)"))
    ).repartition(*series.keys(), F.col("_slab"))
    last = F.least(F.col("_hi"), F.col("_slab") + F.lit(per - step))
    ticks = slabs.withColumn("_last", last).select(
        *series.key, F.explode(F.expr(f"sequence(_slab, _last, {step}L)")).alias("_us")
    )
    ticks = ticks.select(*series.key, F.timestamp_micros("_us").alias(series.ts))
    return ticks.join(df, [*series.key, series.ts], "left")


def fill_gaps(df: DataFrame, series: Series, cols: Sequence[str], step_s: float, limit: int) -> DataFrame:
    """Forward-fill at most ``limit`` ticks of a gridded series."""
    span = limit * step_s
    return by_time(
        df,
        series,
        lambda w: {
            c: F.last(c, ignorenulls=True).over(w.rangeBetween(-reach(df, series, span), 0))
            for c in cols
        },
        before=span,
    )


def fill_forward(df: DataFrame, series: Series, cols: Sequence[str]) -> DataFrame:
    """Forward-fill without limit."""
    return Timeline(df, series).scan(**{c: last_seen(F.col(c)) for c in cols}).done()


def align(
    base: DataFrame, signal: DataFrame, series: Series, cols: Sequence[str], tolerance_s: float
) -> DataFrame:
    """Carry a slower signal onto the base rows, at most ``tolerance_s`` old."""
    return asof(base, signal, series, columns={c: c for c in cols}, tolerance=tolerance_s)


def join_upstream(base: DataFrame, up: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on time; columns already in ``base`` win."""
    overlap = [c for c in up.columns if c in base.columns and c not in keys]
    return base.join(up.drop(*overlap), list(keys), "left")


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with every listed column present."""
    return df.na.drop(subset=list(cols))


def drop_nonincreasing(df: DataFrame, by_seq: Series, t: str) -> DataFrame:
    """Keep rows whose time exceeds the previous raw row's; ``by_seq`` orders
    rows as they were written (R13)."""
    seen = Timeline(df, by_seq).scan(_wf_prev=previous(F.col(t))).done()
    keep = F.col("_wf_prev").isNull() | (F.col(t) > F.col("_wf_prev"))
    return seen.filter(keep).drop("_wf_prev")


def unique_time(df: DataFrame, keys: Sequence[str], t: str, seq: str) -> DataFrame:
    """First row per time in written order (R14), a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in (*keys, t)]
    row = F.min_by(F.struct(*rest), F.col(seq)).alias("_wf_row")
    return df.groupBy(*keys, t).agg(row).select(*keys, t, "_wf_row.*")


def keep_last(df: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """Latest version of each key (S13 dedupe), map-side combined."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.col(newest)).alias("_wf_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_wf_row.*")


def clean_trace(
    df: DataFrame, keys: Sequence[str], t: str = "time_s", p: str = "power_W", seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """Ingest cleaning (S3): finite rows, clamp at zero, unique time, rebase.

    Returns the clean rows (with ``was_negative``) and the keys left with fewer
    than two rows.
    """
    finite = [
        F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf"))) for c in (t, p)
    ]
    ok = df.filter(finite[0] & finite[1]).withColumns(
        {"was_negative": F.col(p) < 0, p: F.greatest(F.col(p), F.lit(0.0))}
    )
    one = unique_time(ok, keys, t, seq)
    ends = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(t).alias("_t0"))
    kept = one.join(ends, list(keys)).filter("_n >= 2").withColumn(t, F.col(t) - F.col("_t0"))
    every = df.select(*keys).distinct().join(ends, list(keys), "left")
    short = every.select(*keys, F.coalesce("_n", F.lit(0)).alias("rows")).filter("rows < 2")
    return kept.drop("_n", "_t0"), short


def segments(df: DataFrame, series: Series, t: str, v: str) -> DataFrame:
    """Each row with the next row's time and value and the series' first and last time."""
    seen = Timeline(df, series).scan(
        t_next=following(F.col(t)), v_next=following(F.col(v)), t_first=first_seen(F.col(t)), t_last=series_max(F.col(t))
    )
    return seen.done()


def resample(
    df: DataFrame, series: Series, v: str, dt: float | str | None, ticks: int | None = None,
    offset: float = 0.0, half_open: bool = False,
) -> DataFrame:
    """Linear interpolation on ``t0 + k*dt`` up to ``tN + dt/2``.

    ``dt`` may name a per-row column.  Each segment between two samples emits
    its own grid points, so the work is local and skew-free; a segment of very
    many points is first cut into pieces of ``PIECE`` points, so that no row
    holds more.  With ``ticks`` exactly that many points are emitted (R17), by
    default over the series' own span; a series without a span has none.
    ``offset`` starts the grid later, ``half_open`` stops it before ``tN`` (F5).
    """
    t = series.ts
    seg = segments(df, series, t, v)
    if dt is None:
        seg = seg.withColumn("_wf_dt", (F.col("t_last") - F.col("t_first")) / F.lit(float(ticks - 1))).filter("_wf_dt > 0")
    else:
        seg = seg.withColumn("_wf_dt", F.col(dt) if isinstance(dt, str) else F.lit(float(dt)))
    if offset:
        seg = seg.withColumn("t_first", F.col("t_first") + offset)
    d = F.col("_wf_dt")
    last = F.col("t_next").isNull()
    lo = F.ceil((F.col(t) - F.col("t_first")) / d).cast("long")
    hi = F.ceil((F.col("t_next") - F.col("t_first")) / d).cast("long")
    if ticks is None:
        end = F.ceil((F.col(t) + d / 2 - F.col("t_first")) / d).cast("long")
    else:  # the last sample owns exactly the last tick
        end = F.lit(ticks).cast("long")
        lo, hi = F.least(lo, end - 1), F.least(hi, end - 1)
    hi = F.when(last, F.lit(None) if half_open else end).otherwise(hi)
    if offset:
        lo = F.greatest(lo, F.lit(0))
    grid = seg.withColumns({"_wf_lo": lo, "_wf_hi": hi}).filter("_wf_hi > _wf_lo")
    grid = grid.withColumn("_wf_lo", F.explode(F.sequence("_wf_lo", F.col("_wf_hi") - 1, F.lit(PIECE))))
    upto = F.least(F.col("_wf_hi"), F.col("_wf_lo") + PIECE) - 1
    grid = grid.withColumn("tick", F.explode(F.sequence(F.col("_wf_lo"), upto)))
    at = F.col("t_first") + F.col("tick") * d
    slope = (F.col("v_next") - F.col(v)) / (F.col("t_next") - F.col(t))
    value = F.when(
        F.col("t_next").isNull() | (at <= F.col(t)), F.col(v)
    ).otherwise(F.col(v) + (at - F.col(t)) * slope)
    return grid.select(*series.key, "tick", at.alias(t), value.alias(v))


def resample_ticks(df: DataFrame, series: Series, v: str, ticks: int) -> DataFrame:
    """Resample to ``ticks`` points over each series' own span (R17), which the one pass also finds."""
    return resample(df, series, v, None, ticks)


def interpolate_at(
    points: DataFrame, trace: DataFrame, series: Series, v: str, at: str, name: str
) -> DataFrame:
    """Trace value at arbitrary points, clamped at both ends."""
    t = series.ts
    cols = {t: "_wf_t0", v: "_wf_v0"}
    back = asof(points, trace, series, columns=cols, left_at=at)
    both = asof(
        back, trace, series, columns={t: "_wf_t1", v: "_wf_v1"}, left_at=at, forward=True
    )
    span = F.col("_wf_t1") - F.col("_wf_t0")
    inside = F.when(span == 0, F.col("_wf_v0")).otherwise(
        F.col("_wf_v0")
        + (F.col(at) - F.col("_wf_t0")) * F.try_divide(F.col("_wf_v1") - F.col("_wf_v0"), span)
    )
    out = both.withColumn(name, F.coalesce(inside, F.col("_wf_v0"), F.col("_wf_v1")))
    return out.drop("_wf_t0", "_wf_v0", "_wf_t1", "_wf_v1")


def rebase(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Time from the first row of each key."""
    start = df.groupBy(*keys).agg(F.min(t).alias("_wf_t0"))
    return df.join(start, list(keys)).withColumn(t, F.col(t) - F.col("_wf_t0")).drop("_wf_t0")


def decimate(df: DataFrame, series: Series, k: int) -> DataFrame:
    """Every ``k``-th row from the first."""
    return number_rows(df, series, "_wf_n").filter((F.col("_wf_n") - 1) % k == 0).drop("_wf_n")


def business_hours(df: DataFrame, ts: str, zone: str, start: int = 8, end: int = 16) -> DataFrame:
    """Monday to Friday, ``start <= local hour < end``."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)
    return df.filter((F.weekday(local) < 5) & (F.hour(local) >= start) & (F.hour(local) < end))


def drop_warmup(
    df: DataFrame, keys: Sequence[str], t: str, warmup_s: float, min_rows: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Rows from ``t0 + warmup`` on, and the keys left too short to score."""
    start = df.groupBy(*keys).agg(F.min(t).alias("_wf_t0"), F.max(t).alias("_wf_tn"))
    kept = df.join(start, list(keys)).filter(F.col(t) >= F.col("_wf_t0") + warmup_s)
    sizes = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_wf_kept"))
    if warmup_s <= 0:
        min_rows = 0
    graded = start.join(sizes, list(keys), "left").select(
        *keys, F.coalesce("_wf_kept", F.lit(0)).alias("rows_left")
    )
    good = graded.filter(F.col("rows_left") >= min_rows).select(*keys)
    rows = kept.join(good, list(keys), "left_semi").drop("_wf_t0", "_wf_tn")
    return rows, graded.filter(F.col("rows_left") < min_rows)


def latest_rows(df: DataFrame, series: Series, n: int) -> DataFrame:
    """Newest ``n`` rows per series (R22); the rank filter also runs map-side."""
    w = Window.partitionBy(*series.key).orderBy(*[c.desc() for c in series.order()])
    return df.withColumn("_wf_r", F.row_number().over(w)).filter(F.col("_wf_r") <= n).drop("_wf_r")


def melt(df: DataFrame, ids: Sequence[str], metrics: Mapping[str, str]) -> DataFrame:
    """Metric columns (or nested fields) to ``metric, value`` rows."""
    flat = df.select(*ids, *[F.col(src).cast("double").alias(dst) for dst, src in metrics.items()])
    return flat.unpivot(list(ids), list(metrics), "metric", "value")


def shift_time(df: DataFrame, offsets: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Subtract a per-key reference offset (R27); keys without one stay."""
    out = df.join(offsets.withColumnRenamed("offset", "_wf_off"), list(keys), "left")
    return out.withColumn(t, F.col(t) - F.coalesce("_wf_off", F.lit(0.0))).drop("_wf_off")


def memory_columns(df: DataFrame) -> DataFrame:
    """kB to bytes plus used and swap-used."""
    available = F.coalesce(F.col("mem_available_kb"), F.col("mem_free_kb"))
    return df.withColumns(
        {
            "mem_available": available * 1024,
            "mem_used": (F.col("mem_total_kb") - available) * 1024,
            "mem_cached": F.col("cached_kb") * 1024,
            "mem_swap_used": (F.col("swap_total_kb") - F.col("swap_free_kb")) * 1024,
        }
    )


def kilowatts_to_watts(kw: Column) -> Column:
    return kw * 1000.0


def first_number(*alternatives: Column) -> Column:
    """First alternative that reads as a number."""
    return F.coalesce(*[a.try_cast("double") for a in alternatives])


def explode_readings(df: DataFrame, array: str, ids: Sequence[str], field: str, name: str) -> DataFrame:
    """One row per array member with a numeric reading."""
    rows = df.select(*ids, F.posexplode(array).alias("member", "_wf_item"))
    out = rows.select(*ids, "member", F.col(f"_wf_item.{field}").try_cast("double").alias(name))
    return out.filter(F.col(name).isNotNull())


# Whole-disk names kept, interfaces and prefixes skipped.
DISK_PATTERN = r"^(sd[a-z]+|nvme\d+n\d+|vd[a-z]+|hd[a-z]+)$"
SKIPPED_INTERFACES = ("lo",)


def keep_devices(df: DataFrame, device: str, pattern: str = DISK_PATTERN) -> DataFrame:
    """Include filter on device names."""
    return df.filter(F.col(device).rlike(pattern))


def skip_interfaces(df: DataFrame, name: str, skipped: Sequence[str] = SKIPPED_INTERFACES) -> DataFrame:
    """Exclude filter on interface names."""
    return df.filter(~F.col(name).isin(*skipped))


def utc_offset_hours(event_utc: Column, local_hms: Sequence[Column]) -> Column:
    """Whole hours to add to a local clock stamp to get UTC, modulo 24."""
    hh, mm, ss = local_hms
    local_s = hh * 3600 + mm * 60 + ss
    utc_s = F.hour(event_utc) * 3600 + F.minute(event_utc) * 60 + F.second(event_utc)
    return F.pmod(F.bround((utc_s - local_s) / 3600.0).cast("long"), F.lit(24))


def anchor_utc(event_utc: Column, local_hms: Sequence[Column], offset_h: Column, t_rel: Column) -> Column:
    """UTC of relative time zero: the stamp on the day that lies within twelve
    hours of the reference event, minus the stamp's relative time (R28)."""
    hh, mm, ss = local_hms
    stamp = F.unix_micros(F.date_trunc("day", event_utc)) + (
        (hh + offset_h) * 3600 + mm * 60 + ss
    ).cast("long") * MICROS
    half, day = 12 * 3600 * MICROS, 24 * 3600 * MICROS
    ref = F.unix_micros(event_utc)
    late = F.greatest(F.ceil((stamp - ref - half) / F.lit(day)), F.lit(0)).cast("long")
    early = F.greatest(F.ceil((ref - stamp - half) / F.lit(day)), F.lit(0)).cast("long")
    placed = stamp - late * day + early * day
    return F.timestamp_micros(placed - F.round(t_rel * MICROS).cast("long"))
