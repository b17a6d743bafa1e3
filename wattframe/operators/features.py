"""Causal window features and event labels."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.plans.blocks import Ranks, lockstep, relay, rolling_rows, rolling_time
from wattframe.plans.decay import Decay, decayed_sums
from wattframe.plans.folds import fold, spans
from wattframe.plans.quantiles import attach
from wattframe.plans.timeline import (
    BLOCK,
    POS,
    Running,
    Timeline,
    by_rows,
    by_time,
    first_seen,
    last_before,
    last_seen,
    number_rows,
    previous,
    reach,
    running_count,
)
from wattframe.series import Series

LAGS = (0, 1, 2, 3)
SLOPE_ROWS = 3
LOOKBACK_ROWS = 30
CROSS_PERCENT = (10.0, 20.0, 40.0)
HAWKES_TAU_S = 35.0
SPIKE_W = 97.0
SPIKE_K = 3.0
SPAN = 30
HORIZON_ROWS = 5

# Upstream signals that get a level and a delta feature.
UPSTREAM = (
    "nr_running", "procs_running", "load1", "load5", "load15", "ctxt_per_s", "mem_used",
    "mem_available", "mem_cached", "mem_swap_used", "disk_read_bps", "disk_write_bps",
    "net_rx_bps", "net_tx_bps", "freq_mhz", "temp_celsius", "pdu_watts",
)


def delta(c: str | Column, k: int, w: WindowSpec) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col - F.lag(col, k).over(w)


def flag(condition: Column) -> Column:
    """1.0 / 0.0, unknown counts as 0.0."""
    return F.when(condition, 1.0).otherwise(0.0)


def full_frame(stat: Column, counted: str, frame: WindowSpec, rows: int) -> Column:
    """A rolling statistic only where the frame holds ``rows`` known values."""
    return F.when(F.count(counted).over(frame) == rows, stat)


def lag_features(w: WindowSpec, lags: Sequence[int] = LAGS) -> dict[str, Column]:
    """W1"""
    return {
        f"{short}_lag{k}": F.lag(c, k).over(w)
        for k in lags
        for short, c in (("power", "power_watts"), ("usage", "usage_percent"))
    }


def usage_deltas(w: WindowSpec, k: int = SLOPE_ROWS) -> dict[str, Column]:
    """W2"""
    d1, dk = delta("usage_percent", 1, w), delta("usage_percent", k, w)
    return {"usage_d1": d1, f"usage_d{k}": dk, f"usage_slope{k}": dk / k, "usage_abs_d1": F.abs(d1)}


def cross_flags(w: WindowSpec, percents: Sequence[float] = CROSS_PERCENT) -> dict[str, Column]:
    """W3"""
    u, prev = F.col("usage_percent"), F.lag("usage_percent").over(w)
    out = {}
    for p in percents:
        out[f"usage_cross_up_{int(p)}"] = flag((u >= p) & (prev < p))
        out[f"usage_cross_down_{int(p)}"] = flag((u <= p) & (prev > p))
    return out


def procs_features(w: WindowSpec, k: int = SLOPE_ROWS) -> dict[str, Column]:
    """W5"""
    return {"procs_slope": delta("procs_running", k, w) / k}


def rolling_shape(
    w: WindowSpec, c: str, rows: int, guard: float = 0.0
) -> tuple[Column, Column]:
    """Rolling CV and peak-to-mean over a full window."""
    frame = w.rowsBetween(-(rows - 1), 0)
    mean = F.avg(c).over(frame) + guard
    cv = F.try_divide(F.stddev_samp(c).over(frame), mean)
    peak = F.try_divide(F.max(c).over(frame), mean)
    return full_frame(cv, c, frame, rows), full_frame(peak, c, frame, rows)


def rolling_std(w: WindowSpec, c: str, rows: int) -> Column:
    """Full-window rolling sample deviation; over first differences it is jerk."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return full_frame(F.stddev_samp(c).over(frame), c, frame, rows)


def physics(ghz: Column, usage: Column) -> dict[str, Column]:
    """Dynamic-power terms of frequency and utilisation."""
    return {
        "freq_sq_x_usage": ghz * ghz * usage,
        "freq_cubed": ghz * ghz * ghz,
        "freq_x_usage": ghz * usage,
    }


def with_hawkes(
    df: DataFrame, series: Series, sig: str, name: str, tau_s: float = HAWKES_TAU_S, dt: float = 1.0
) -> DataFrame:
    """Self-exciting intensity of positive increments, one step per row."""
    seen = Timeline(df, series).scan(_wf_b=previous(F.col(sig)), _wf_h=running_count()).done()
    mark = F.coalesce(F.greatest(F.col(sig) - F.col("_wf_b"), F.lit(0.0)), F.lit(0.0))
    out = decayed_sums(seen, series, at=F.col("_wf_h"), **{name: Decay(mark, tau_s / dt)})
    return out.drop("_wf_b", "_wf_h")


def ewma_sums(col: Column, centre: Column, span: int, prefix: str) -> dict[str, Decay]:
    """Decayed sums behind :func:`ewma_columns`."""
    tau = -1.0 / np.log(1.0 - 2.0 / (span + 1.0))
    x, known = col.cast("double") - centre, flag(col.isNotNull())
    return {
        f"_wf_{prefix}_w": Decay(known, tau),
        f"_wf_{prefix}_ww": Decay(known, tau / 2),
        f"_wf_{prefix}_wx": Decay(x, tau),
        f"_wf_{prefix}_wxx": Decay(x * x, tau),
    }


def ewma_spread(col: Column, centre: Column, span: int, prefix: str) -> dict[str, Decay]:
    """Decayed sum of squared deviations, given the sums of :func:`ewma_sums`.

    Each value adds its squared distance to the mean before it, so values that
    differ little from each other but much from ``centre`` lose no digits.
    """
    w, wx = F.col(f"_wf_{prefix}_w"), F.col(f"_wf_{prefix}_wx")
    x, before = col.cast("double") - centre, w - 1.0
    off = x - F.try_divide(wx - x, before)
    step = F.when(col.isNotNull() & (before > 1e-9), before / w * off * off).otherwise(0.0)
    return {f"_wf_{prefix}_ss": Decay(step, -1.0 / np.log(1.0 - 2.0 / (span + 1.0)))}


#: Deviation, as a part of the mean, that is rounding noise.
FLAT = 1e-12


def ewma_columns(df: DataFrame, col: str, centre: Column, prefix: str) -> DataFrame:
    """Mean, bias-corrected deviation and z-score from the decayed sums."""
    w, ww, wx, wxx = (F.col(f"_wf_{prefix}_{s}") for s in ("w", "ww", "wx", "wxx"))
    mean = F.try_divide(wx, w)
    ss = f"_wf_{prefix}_ss"
    var = F.try_divide(F.col(ss), w) if ss in df.columns else F.greatest(F.try_divide(wxx, w) - mean * mean, F.lit(0.0))
    # equal values differ by rounding where they were worked out: no deviation, so no score
    var = F.when(F.sqrt(var) <= FLAT * F.abs(mean + centre), 0.0).otherwise(var)
    # one value: weights cancel up to rounding
    unbias = F.when(w * w - ww > 1e-9 * w * w, w * w / (w * w - ww))
    out = df.withColumns({f"{prefix}_mean": mean + centre, f"{prefix}_std": F.sqrt(var * unbias)})
    z = F.try_divide(F.col(col) - F.col(f"{prefix}_mean"), F.col(f"{prefix}_std"))
    drop = [f"_wf_{prefix}_{s}" for s in ("w", "ww", "wx", "wxx")]
    return out.withColumn(f"{prefix}_z", z).drop(*drop, ss)


def with_ewma(
    df: DataFrame, series: Series, col: str, span: int = SPAN, prefix: str = "ewma"
) -> DataFrame:
    """Causal EWMA mean, bias-corrected deviation and z-score.

    Adds ``{prefix}_mean``, ``{prefix}_std`` and ``{prefix}_z``; the first row
    has no deviation.  Values are centred on the first one of the series, so a
    flat series has deviation exactly 0.
    """
    x0 = F.col("_wf_x0")
    scans = {"_wf_x0": first_seen(F.col(col).cast("double")), "_wf_e": running_count()}
    src = Timeline(df, series).scan(**scans).done()
    sums = decayed_sums(src, series, at=F.col("_wf_e"), **ewma_sums(F.col(col), x0, span, prefix))
    return ewma_columns(sums, col, x0, prefix).drop("_wf_x0", "_wf_e")


def ewma_flags(df: DataFrame, series: Series, col: str, span: int = SPAN, k: float = SPIKE_K) -> DataFrame:
    """Rows outside the EWMA control band."""
    return with_ewma(df, series, col, span).filter(F.abs("ewma_z") > k)


def spike_condition(direction: str, d: Column, z: Column, watts: float, k: float) -> Column:
    """Signed spike rule on a step and an EWMA z-score."""
    if direction == "rise":
        hit = (d > watts) | (z > k)
    elif direction == "drop":
        hit = (d < -watts) | (z < -k)
    elif direction == "both":
        hit = (F.abs(d) > watts) | (F.abs(z) > k)
    else:
        raise ValueError(f"unknown spike direction: {direction}")
    return F.coalesce(hit, F.lit(False))


def spike_flags(
    df: DataFrame, d1: str, z: str, watts: float, k: float, directions: Sequence[str]
) -> DataFrame:
    flags = {}
    for direction in directions:
        rule = spike_condition(direction, F.col(d1), F.col(z), watts, k)
        flags[f"spike_{direction}"] = F.when(rule, 1).otherwise(0)
    return df.withColumns(flags)


def with_spikes(
    df: DataFrame, series: Series, power: str = "power_watts", watts: float = SPIKE_W,
    k: float = SPIKE_K, span: int = SPAN, directions: Sequence[str] = ("rise", "drop", "both"),
    row_number: str | None = None,
) -> DataFrame:
    """Adds ``d1``, the EWMA columns and one 0/1 flag per direction.

    One scan and one decay pass; ``row_number`` keeps the row numbers for a
    following row window.
    """
    rn, x0 = row_number or "_wf_rn", F.col("_wf_x0")
    seen = Timeline(df, series).scan(
        **{rn: running_count()}, _wf_p=previous(F.col(power)), _wf_x0=first_seen(F.col(power).cast("double"))
    )
    seen = seen.with_columns({"d1": F.col(power) - F.col("_wf_p")}).done()
    sums = decayed_sums(seen, series, at=F.col(rn), **ewma_sums(F.col(power), x0, span, "ewma"))
    out = spike_flags(ewma_columns(sums, power, x0, "ewma"), "d1", "ewma_z", watts, k, directions)
    return out.drop("_wf_p", "_wf_x0", *([] if row_number else [rn]))


def horizon_label(w: WindowSpec, event: str, rows: int = HORIZON_ROWS) -> Column:
    """1 when an event falls in the next ``rows`` rows, strictly after."""
    return F.coalesce(F.max(event).over(w.rowsBetween(1, rows)), F.lit(0)).cast("int")


def with_label(
    df: DataFrame, series: Series, horizon: int = HORIZON_ROWS, direction: str = "both",
    watts: float = SPIKE_W, k: float = SPIKE_K, span: int = SPAN, power: str = "power_watts",
) -> DataFrame:
    """Forward-horizon spike label."""
    spikes = with_spikes(df, series, power, watts, k, span, (direction,), row_number="rn")
    stage = lambda w: {"label": horizon_label(w, f"spike_{direction}", horizon)}
    return by_rows(spikes, series, stage, after=horizon, row_number="rn").drop("rn")


def hf_features(w: WindowSpec, signals: Sequence[str]) -> dict[str, Column]:
    """Upstream-only high-rate features."""
    out = {f"nr_lag{k}": F.lag("nr_running", k).over(w) for k in (0, 1, 2, 5, 10)}
    out["nr_d10"] = delta("nr_running", 10, w)
    out["nr_d30"] = delta("nr_running", 30, w)
    out.update({f"{s}_d30": delta(s, 30, w) for s in signals})
    return out


def filled(df: DataFrame, series: Series, cols: Sequence[str], **more: Running) -> DataFrame:
    """Forward-filled copies (``{c}_f``) and a row number, in one scan."""
    present = [c for c in cols if c in df.columns]
    scans = {f"{c}_f": last_seen(F.col(c).cast("double")) for c in present}
    return Timeline(df, series).scan(rn=running_count(), **scans, **more).done()


def feature_frame(
    df: DataFrame, series: Series, lane_a: bool = False, kf: bool = False, upstream: bool = False,
    lookback: int = LOOKBACK_ROWS, slope: int = SLOPE_ROWS, label: dict | None = None,
) -> tuple[DataFrame, list[str]]:
    """Causal feature matrix.

    One scan carries row numbers, filled signals and first values; one decay
    pass gives the Hawkes intensity (and the EWMA of the label); one row-window
    pass gives every lag, delta and rolling feature.  Features of absent signals
    are skipped.  Returns the frame and the feature columns, rows unfiltered.
    ``label`` (horizon, direction, watts, k, span) also adds ``label``, or
    ``label_<h>`` for each of several horizons; its ``also`` maps names of more
    labels to (direction, watts, k), each of a direction of its own.
    """
    ups = [s for s in UPSTREAM if s in df.columns] if upstream else []
    fill = [*dict.fromkeys([*ups, *(["temp_celsius"] if "temp_celsius" in df.columns else [])])]
    if "freq_mhz" in ups:
        fill.append("usage_percent")
    scans = {"rn": running_count()}
    scans.update({f"{c}_f": last_seen(F.col(c).cast("double")) for c in fill})
    decays: dict[str, Decay] = {}
    x0 = F.col("_wf_x0")
    if "nr_running" in ups:
        scans["_wf_nr_b"] = last_before(F.col("nr_running").cast("double"))
        rise = F.greatest(F.col("nr_running_f") - F.col("_wf_nr_b"), F.lit(0.0))
        decays["nr_running_hawkes"] = Decay(F.coalesce(rise, F.lit(0.0)), HAWKES_TAU_S)
    if label:
        scans["_wf_p"] = previous(F.col("power_watts"))
        scans["_wf_x0"] = first_seen(F.col("power_watts").cast("double"))
        decays.update(ewma_sums(F.col("power_watts"), x0, label["span"], "ewma"))
    src = Timeline(df, series).scan(**scans).done()
    if "freq_mhz" in ups:
        src = src.withColumns(physics(F.col("freq_mhz_f") / 1000.0, F.col("usage_percent_f")))
    if decays:
        src = decayed_sums(src, series, at=F.col("rn"), **decays)
    if label:
        src = ewma_columns(src, "power_watts", x0, "ewma")
        src = src.withColumn("d1", F.col("power_watts") - F.col("_wf_p"))
        way = label["direction"]
        src = spike_flags(src, "d1", "ewma_z", label["watts"], label["k"], (way,))
        for other, watts, k in label.get("also", {}).values():
            src = spike_flags(src, "d1", "ewma_z", watts, k, (other,))
    horizons = () if not label else (label["horizon"],) if isinstance(label["horizon"], int) else tuple(label["horizon"])

    def first(w: WindowSpec) -> dict[str, Column]:
        out = {**lag_features(w), **usage_deltas(w, slope), **cross_flags(w)}
        if "temp_celsius" in df.columns:
            out["temp_celsius_slope"] = delta("temp_celsius_f", lookback, w) / float(lookback)
        if lane_a:
            out.update(procs_features(w, slope))
        for s in ups:
            out[f"{s}_d{slope}"] = delta(f"{s}_f", slope, w)
        if "freq_mhz" in ups:
            for n in ("freq_sq_x_usage", "freq_cubed", "freq_x_usage"):
                out[f"{n}_slope30"] = delta(n, lookback, w) / float(lookback)
        if "nr_running" in ups:
            out["_wf_nr_d1"] = F.col("nr_running_f") - F.col("_wf_nr_b")
            cv, peak = rolling_shape(w, "nr_running_f", lookback, 1e-6)
            out["nr_running_cv"], out["nr_running_peak_to_mean"] = cv, peak
        names.extend(n for n in out if not n.startswith("_wf") and n not in names)
        if label:
            for h in horizons:
                out["label" if horizons == (label["horizon"],) else f"label_{h}"] = horizon_label(w, f"spike_{label['direction']}", h)
            for name, (other, _, _) in label.get("also", {}).items():
                out[name] = horizon_label(w, f"spike_{other}", max(horizons))
        return out

    def second(w: WindowSpec) -> dict[str, Column]:
        return {"nr_running_jerk": rolling_std(w, "_wf_nr_d1", lookback)}

    names: list[str] = []
    stages = [first, second] if "nr_running" in ups else [first]
    out = by_rows(
        src, series, *stages, before=lookback, after=max(horizons, default=0), row_number="rn"
    )
    if "nr_running" in ups:
        names += ["nr_running_jerk", "nr_running_hawkes"]
    if lane_a:
        names.append("procs_running")
    if "freq_mhz" in ups:
        names += ["freq_sq_x_usage", "freq_cubed", "freq_x_usage"]
    out = out.withColumns({s: F.col(f"{s}_f") for s in ups})
    names += [s for s in ups if s not in names]
    if kf:
        at = [*series.key, series.ts, *series.tie]
        states = kalman(df, series, "power_watts", adapt=True).select(
            *at, F.col("level").alias("kf_level"), F.col("slope").alias("kf_slope")
        )
        out = out.join(states, at, "left")
        names += ["kf_level", "kf_slope"]
    drop = [f"{c}_f" for c in fill] + ["_wf_nr_d1", "_wf_nr_b", "_wf_p", "_wf_x0", "rn"]
    return out.drop(*drop), names


def build_xy(
    df: DataFrame, series: Series, horizon: int | Sequence[int] = HORIZON_ROWS, direction: str = "both",
    watts: float = SPIKE_W, k: float = SPIKE_K, span: int = SPAN, also: dict[str, tuple[str, float, float]] | None = None,
    **features,
) -> tuple[DataFrame, list[str]]:
    """Feature matrix with label, or several labels, complete rows only."""
    label = {"horizon": horizon, "direction": direction, "watts": watts, "k": k, "span": span, "also": also or {}}
    x, names = feature_frame(df, series, label=label, **features)
    return x.na.drop(subset=names), names


def candidate_features(df: DataFrame, series: Series, lookback: int = LOOKBACK_ROWS) -> tuple[DataFrame, list[str]]:
    """Precursor candidates for screening."""
    channels = [
        c
        for c in ("freq_mhz", "temp_celsius", "pdu_watts", "procs_running", "usage_percent")
        if c in df.columns
    ]
    src = filled(df, series, channels, _wf_x0=first_seen(F.col("power_watts").cast("double")))
    slopes = [(f"{c}_f", c) for c in channels]
    if "freq_mhz" in channels:
        ghz, usage = F.col("freq_mhz_f") / 1000.0, F.col("usage_percent_f")
        src = src.withColumns(physics(ghz, usage))
        means = src.groupBy(*series.key).agg(
            F.avg("power_watts").alias("_wf_mp"), F.avg("freq_sq_x_usage").alias("_wf_mq")
        )
        ratio = F.col("_wf_mp") / F.greatest(F.col("_wf_mq"), F.lit(1e-9))
        src = attach(src, means, series.key).withColumn(
            "power_resid", F.col("power_watts") - ratio * F.col("freq_sq_x_usage")
        )
        slopes += [(n, n) for n in ("freq_sq_x_usage", "freq_cubed", "freq_x_usage", "power_resid")]

    def stage(w: WindowSpec) -> dict[str, Column]:
        cv, peak = rolling_shape(w, "power_watts", lookback)
        out = {"rolling_cv": cv, "rolling_peak_to_mean": peak}
        out["usage_slope_per_s"] = delta("usage_percent", lookback, w) / lookback
        out.update({f"{name}_slope": delta(c, lookback, w) / lookback for c, name in slopes})
        return out

    x0 = F.col("_wf_x0")
    src = decayed_sums(src, series, at=F.col("rn"), **ewma_sums(F.col("power_watts"), x0, SPAN, "ewma"))
    src = ewma_columns(src, "power_watts", x0, "ewma")
    out = by_rows(src, series, stage, before=lookback, row_number="rn")
    out = out.withColumns({c: F.col(f"{c}_f") for c in channels})
    names = ["rolling_cv", "rolling_peak_to_mean", "ewma_z", "usage_slope_per_s"]
    for _, name in slopes:
        names += [name, f"{name}_slope"]
    drop = [f"{c}_f" for c in channels] + ["rn", "_wf_x0", "_wf_mp", "_wf_mq", "ewma_mean", "ewma_std"]
    return out.drop(*drop), names


# Upstream signal -> (feature name, divide by lookback).
UPSTREAM_CHANGE = {
    "nr_running": ("nr_running_slope", True),
    "ctxt_per_s": ("ctxt_per_s_slope", True),
    "mem_cached": ("mem_cached_delta", False),
    "mem_available": ("mem_available_delta", False),
    "mem_used": ("mem_used_delta", False),
    "mem_swap_used": ("mem_swap_slope", True),
    "temp_celsius": ("temp_celsius_slope", True),
    "procs_running": ("procs_running_slope", True),
    "disk_read_bps": ("disk_read_slope", True),
    "disk_write_bps": ("disk_write_slope", True),
    "net_rx_bps": ("net_rx_slope", True),
    "net_tx_bps": ("net_tx_slope", True),
}


def upstream_candidates(df: DataFrame, series: Series, lookback: int = LOOKBACK_ROWS) -> tuple[DataFrame, list[str]]:
    """Upstream-only screening features."""
    have = {s: v for s, v in UPSTREAM_CHANGE.items() if s in df.columns}
    src = filled(df, series, list(have))

    def first(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for s, (name, per_row) in have.items():
            change = delta(f"{s}_f", lookback, w)
            out[name] = change / lookback if per_row else change
        if "nr_running" in have:
            out["_wf_d1"] = delta("nr_running_f", 1, w)
            out["nr_running_cv"], out["nr_running_peak_to_mean"] = rolling_shape(
                w, "nr_running_f", lookback, 1e-6
            )
        return out

    def second(w: WindowSpec) -> dict[str, Column]:
        return {"nr_running_jerk": rolling_std(w, "_wf_d1", lookback)}

    names = [v[0] for v in have.values()]
    stages = [first]
    if "nr_running" in have:
        stages.append(second)
        names += ["nr_running_cv", "nr_running_peak_to_mean", "nr_running_jerk"]
    out = by_rows(src, series, *stages, before=2 * lookback, row_number="rn")
    return out.drop("rn", "_wf_d1", *[f"{s}_f" for s in have]), names


def segment_features(
    df: DataFrame, series: Series, max_gap_s: float = 0.25, min_rows: int = 100, span: int = 300,
    jerk_rows: int = 50, tau_s: float = HAWKES_TAU_S, dt: float = 0.1, power: str = "power_W",
    runq: str = "nr_running",
) -> DataFrame:
    """EWMA-z of power, jerk and Hawkes intensity inside contiguous segments."""
    from wattframe.operators.events import with_segments

    inner = series.with_key(*series.key, "segment")
    seg = with_segments(df, series, max_gap_s)
    sizes = seg.groupBy(*inner.key).agg(F.count(F.lit(1)).alias("segment_rows"))
    src = Timeline(seg, inner).scan(
        rn=running_count(), _wf_b=previous(F.col(runq)), _wf_x0=first_seen(F.col(power).cast("double"))
    )
    src = src.with_columns({"_wf_d1": F.col(runq) - F.col("_wf_b")}).done()
    mark = F.coalesce(F.greatest(F.col("_wf_d1"), F.lit(0.0)), F.lit(0.0))
    src = decayed_sums(src, inner, at=F.col("rn"), hawkes=Decay(mark, tau_s / dt))
    jerk = lambda w: {"jerk": rolling_std(w, "_wf_d1", jerk_rows)}
    src = by_rows(src, inner, jerk, before=jerk_rows, row_number="rn")
    zero = F.lit(0.0)
    parts = ((power, F.col("_wf_x0"), "p"), ("jerk", zero, "j"), ("hawkes", zero, "h"))
    sums = {}
    for col, centre, prefix in parts:
        sums.update(ewma_sums(F.col(col), centre, span, prefix))
    out = decayed_sums(src, inner, at=F.col("rn"), **sums)
    spreads = {}
    for col, centre, prefix in parts:
        spreads.update(ewma_spread(F.col(col), centre, span, prefix))
    out = decayed_sums(out, inner, at=F.col("rn"), **spreads)
    for col, centre, prefix in parts:
        out = ewma_columns(out, col, centre, prefix)
    out = out.join(sizes.filter(F.col("segment_rows") >= min_rows), list(inner.key))
    drop = ["_wf_d1", "_wf_b", "_wf_x0", "rn", *[f"{p}_{s}" for p in "pjh" for s in ("mean", "std")]]
    return out.drop(*drop)


def max_ramp(df: DataFrame, series: Series, power: str, rows: int) -> DataFrame:
    """Largest rise and fall rate over ``rows`` samples per series."""
    t = series.position(df) / F.lit(float(series.scale(df)))
    src = df.withColumn("_wf_sec", t)

    def stage(w: WindowSpec) -> dict[str, Column]:
        dp = F.lead(power, rows).over(w) - F.col(power)
        dt = F.lead("_wf_sec", rows).over(w) - F.col("_wf_sec")
        return {"_wf_ramp": F.try_divide(dp, dt)}

    out = by_rows(src, series, stage, after=rows)
    return out.groupBy(*series.key).agg(
        F.max("_wf_ramp").alias("max_up"), F.min("_wf_ramp").alias("max_down")
    )


def ramp_rate(df: DataFrame, series: Series, power: str, window_s: float = 5.0) -> DataFrame:
    """Largest mean absolute change over a left-open time window."""
    seen = Timeline(df, series).scan(_wf_p=previous(F.col(power))).done()
    seen = seen.withColumn("_wf_d", F.abs(F.col(power) - F.col("_wf_p")))
    back = reach(df, series, window_s)
    edge = back - 1 if series.is_timestamp(df) else back

    def stage(w: WindowSpec) -> dict[str, Column]:
        return {"_wf_sum": F.sum("_wf_d").over(w.rangeBetween(-edge, 0))}

    out = by_time(seen, series, stage, before=window_s)
    return out.groupBy(*series.key).agg((F.max("_wf_sum") / window_s).alias("ramp_rate"))


def local_seconds(df: DataFrame, series: Series, window_s: float) -> Column:
    """Seconds from the block start, inside a :func:`by_time` stage; keeps
    regressions on time away from large absolute values."""
    scale = series.scale(df)
    width = max(series.width, window_s) * scale
    return (F.col(POS) - F.col(BLOCK) * F.lit(width)).cast("double") / scale


def slope_feature(
    df: DataFrame, series: Series, power: str, window_s: float = 0.5, min_rows: int = 3,
    min_span: float = 0.6, name: str = "deriv_w_s",
) -> DataFrame:
    """Least-squares slope over a short window, 0 until it is meaningful."""

    def stage(w: WindowSpec) -> dict[str, Column]:
        sec = local_seconds(df, series, window_s)
        frame = w.rangeBetween(-reach(df, series, window_s), 0)
        ready = (F.count(power).over(frame) >= min_rows) & (
            sec - F.min(sec).over(frame) >= min_span * window_s
        )
        slope = F.regr_slope(F.col(power), sec).over(frame)
        return {name: F.when(ready, F.coalesce(slope, F.lit(0.0))).otherwise(0.0)}

    return by_time(df, series, stage, before=window_s)


def sorted_window(c: str, frame: WindowSpec) -> Column:
    return F.array_sort(F.collect_list(c).over(frame))


def _known(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The known values of an array, and how many of them stand before each place."""
    ok = ~np.isnan(values)
    return values[ok], np.concatenate([[0], np.cumsum(ok)])


def idle_baseline(
    df: DataFrame, series: Series, power: str, window_s: float = 60.0, min_rows: int = 20,
    fallback: float = 225.0, clamp: float = 285.0, name: str = "baseline_w",
) -> DataFrame:
    """Rolling low decile, clamped to a known ceiling.

    Each block answers all its windows from one rank index, so a row costs the
    logarithm of the block, not its window.
    """
    back = reach(df, series, window_s)

    def fn(r: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        pos = r[POS]
        values, seen = _known(r[power].astype(float))
        start = seen[np.searchsorted(pos, pos - back, side="left")]
        stop = seen[np.searchsorted(pos, pos, side="right")]
        decile = Ranks(values).kth(start, stop, (stop - start) // 10)
        return {name: np.where(stop - start < min_rows, fallback, np.fmin(decile, clamp))}

    return rolling_time(df, series, window_s, fn, [power], {name: T.DoubleType()})


def despike(df: DataFrame, series: Series, power: str, keep: int = 5, name: str = "despiked_w") -> DataFrame:
    """Upper median of the last distinct refreshes, carried to every row."""
    seen = Timeline(df, series).scan(_wf_p=previous(F.col(power))).done()
    fresh = F.col("_wf_p").isNull() | (F.col(power) != F.col("_wf_p"))
    marked = seen.withColumn("_wf_fresh", fresh).drop("_wf_p")

    def stage(w: WindowSpec) -> dict[str, Column]:
        win = sorted_window(power, w.rowsBetween(-(keep - 1), 0))
        return {name: F.element_at(win, (F.floor(F.size(win) / 2) + 1).cast("int"))}

    changed = by_rows(marked.filter("_wf_fresh"), series, stage, before=keep - 1)
    still = marked.filter("NOT _wf_fresh").withColumn(name, F.lit(None).cast("double"))
    both = Timeline(changed.unionByName(still), series)
    return both.scan(**{name: last_seen(F.col(name))}).done().drop("_wf_fresh")


def rolling_fit(
    df: DataFrame, series: Series, power: str, util: str, window_s: float = 1.5, min_rows: int = 30,
    min_variance: float = 0.005,
) -> DataFrame:
    """Power as a linear function of utilisation over a short window."""

    def stage(w: WindowSpec) -> dict[str, Column]:
        frame = w.rangeBetween(-reach(df, series, window_s), 0)
        valid = (F.count(power).over(frame) >= min_rows) & (
            F.var_pop(util).over(frame) >= min_variance
        )
        return {
            "fit_alpha": F.when(valid, F.regr_slope(F.col(power), F.col(util)).over(frame)),
            "fit_idle": F.when(valid, F.regr_intercept(F.col(power), F.col(util)).over(frame)),
        }

    return by_time(df, series, stage, before=window_s)


def stale_blend(
    fitted: DataFrame, series: Series, power: str, util: str, stale_s: float, name: str = "estimated_w"
) -> DataFrame:
    """Blend from the last reading to the model as the reading ages."""
    seen = Timeline(fitted, series).scan(_wf_p=previous(F.col(power)))
    pos = series.position(fitted)
    changed = F.col("_wf_p").isNull() | (F.col(power) != F.col("_wf_p"))
    seen = seen.scan(_wf_at=last_seen(F.when(changed, pos)))
    age = (pos - F.col("_wf_at")) / F.lit(float(series.scale(fitted)))
    share = F.least(F.lit(1.0), (age - stale_s) / stale_s)
    model = F.greatest(F.lit(0.0), F.col("fit_idle") + F.col("fit_alpha") * F.col(util))
    blended = F.col(power) * (1.0 - share) + model * share
    est = F.when(model.isNull() | (age <= stale_s), F.col(power)).otherwise(blended)
    est = F.when(F.col("fit_alpha").isNull(), F.col(power)).otherwise(est)
    return seen.with_columns({name: est}).done().drop("_wf_p", "_wf_at")


def cliff_arm(
    df: DataFrame, series: Series, power: str, util: str, window_s: float, rate_w_s: float,
    drop_w: float, deadband_w: float, busy_mean: float,
) -> DataFrame:
    """Sliding cliff trigger: ``rate`` or ``delta``, with deadband and busy veto."""

    def stage(w: WindowSpec) -> dict[str, Column]:
        frame = w.rangeBetween(-reach(df, series, window_s), 0)
        sec = local_seconds(df, series, window_s)
        dt = sec - F.min(sec).over(frame)
        dw = F.col(power) - F.first(power).over(frame)
        drop = F.max(power).over(frame) - F.col(power)
        rate = F.try_divide(dw, dt)
        armed = (dt > 0) & (drop > deadband_w) & (F.avg(util).over(frame) < busy_mean)
        reason = F.when(rate <= rate_w_s, "rate").when(drop > drop_w, "delta")
        return {"drop_w": drop, "rate_w_s": rate, "trigger": F.when(armed, reason)}

    return by_time(df, series, stage, before=window_s)


def edge_score(w: WindowSpec, sig: str = "nr_running", a: int = 30, b: int = 50) -> Column:
    """Causal rise over two lags, null until the longer one exists."""
    cur = F.col(sig)
    rise = F.greatest(cur - F.lag(cur, a).over(w), cur - F.lag(cur, b).over(w), F.lit(0.0))
    return F.when(F.lag(F.lit(1), b).over(w).isNotNull(), rise)


def rank_threshold(
    df: DataFrame, series: Series, score: str, rows: int, q: float, floor: float, warm: int,
    every: int = 1, name: str = "threshold",
) -> DataFrame:
    """Quantile of the previous ``rows`` scores, current excluded.

    ``every`` refreshes the threshold on each n-th row and holds it between. A
    block answers the windows of its rows from one rank index; the rows before
    the block that its first windows reach are at hand.
    """

    def fn(r: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        values, seen = _known(r[score].astype(float))
        rn = r["rn"].astype(np.int64)
        at = np.maximum(np.arange(len(rn)) - (rn - 1) % every, 0)
        start, stop = seen[np.maximum(at - rows, 0)], seen[at]
        cut = Ranks(values).quantile(start, stop, q)
        return {name: np.where(stop - start >= warm, np.fmax(cut, floor), floor)}

    numbered = number_rows(df, series, "rn")
    return rolling_rows(numbered, series, rows + every - 1, fn, [score], {name: T.DoubleType()}).drop("rn")


def capped_threshold(
    df: DataFrame, series: Series, score: str, base: float, window_s: float = 3600.0,
    refresh_s: float = 300.0, min_samples: int = 60, alarm_rate: float = 0.1,
    max_rise: float = 0.02, max_fall: float = 0.005, name: str = "threshold",
    slice_width: float | None = None, model: str | None = None,
) -> DataFrame:
    """Threshold that follows a rolling quantile in capped steps.

    State between slices: threshold, last refresh, model mark, then the window.
    """
    scale = series.scale(df)
    cols = [*series.key, series.ts, *series.tie]
    pos = (series.position(df) / F.lit(scale)).cast("double")
    mark = F.xxhash64(F.col(model)).cast("double") if model else F.lit(0.0)
    rows = df.select(*cols, pos.alias("_wf_s"), F.col(score).alias("_wf_y"), mark.alias("_wf_m"))
    stepper = CappedThreshold(base, window_s, refresh_s, min_samples, alarm_rate, max_rise, max_fall)

    def step(state, pdf: pd.DataFrame):
        out, state = stepper.run(
            state, pdf["_wf_s"].to_numpy(), pdf["_wf_y"].to_numpy(float), pdf["_wf_m"].to_numpy(float)
        )
        return pdf[cols].assign(**{name: out}), state

    schema = T.StructType([*[df.schema[c] for c in cols], T.StructField(name, T.DoubleType())])
    return fold(rows, series, step, schema, slice_width)


class CappedThreshold:
    """Per-row step of :func:`capped_threshold`, shared with streaming."""

    def __init__(self, base, window_s, refresh_s, min_samples, alarm_rate, max_rise, max_fall):
        self.base, self.window_s, self.refresh_s = base, window_s, refresh_s
        self.min_samples, self.q = min_samples, 1.0 - alarm_rate
        self.max_rise, self.max_fall = max_rise, max_fall

    def run(self, state, at, scores, marks):
        thr, last, model = (state[0], state[1], state[2]) if state else (self.base, np.nan, np.nan)
        kept = np.asarray(state[3:] if state else [], dtype=float).reshape(-1, 2)
        t = np.concatenate([kept[:, 0], at])
        y = np.concatenate([kept[:, 1], scores])
        begin, out = 0, np.empty(len(at))
        for i in range(len(kept), len(t)):
            if not marks[i - len(kept)] == model:
                begin, thr, last, model = i, self.base, np.nan, marks[i - len(kept)]
            while t[begin] < t[i] - self.window_s:
                begin += 1
            due = np.isnan(last) or t[i] - last >= self.refresh_s
            if i + 1 - begin >= self.min_samples and due:
                win = y[begin : i + 1]
                win = win[np.isfinite(win)]
                if len(win) >= self.min_samples:
                    target = max(self.base, float(np.quantile(win, self.q)))
                    move = max(min(target - thr, self.max_rise), -self.max_fall)
                    thr, last = max(self.base, thr + move), t[i]
            out[i - len(kept)] = thr
        tail = np.column_stack([t[begin:], y[begin:]]).ravel().tolist()
        return out, [thr, last, model, *tail]


def span_of(cols: Sequence[str]) -> Column:
    return F.greatest(*cols) - F.least(*cols)


#: Columns that tell idle rows.
IDLE_COLUMNS = ("usage_lag0", *[f"power_lag{k}" for k in LAGS])


def idle_mask(usage_max: float = 5.0, power_span: float = 15.0) -> Column:
    """Idle rows from lag features only."""
    lags = [f"power_lag{k}" for k in LAGS]
    return F.coalesce((F.col("usage_lag0") < usage_max) & (span_of(lags) < power_span), F.lit(False))


def usage_idle_gate(usage_max: float = 8.0, span_max: float = 3.0) -> Column:
    """Flat low usage over the lag window, nulls skipped."""
    lags = [f"usage_lag{k}" for k in LAGS]
    return F.coalesce((F.greatest(*lags) <= usage_max) & (span_of(lags) <= span_max), F.lit(False))


def signed_state(watts: float = SPIKE_W) -> dict[str, Column]:
    """Power delta, rise/drop flags and direction from lags."""
    d = F.col("power_lag0") - F.col("power_lag1")
    rise = F.when(d > watts, 1).otherwise(0)
    drop = F.when(d < -watts, 1).otherwise(0)
    return {"power_delta": d, "rise_now": rise, "drop_now": drop, "direction": rise - drop}


def peak_hold(df: DataFrame, series: Series, power: str, window_s: float = 0.5, name: str = "peak_w") -> DataFrame:
    """Rolling maximum."""
    return by_time(
        df,
        series,
        lambda w: {name: F.max(power).over(w.rangeBetween(-reach(df, series, window_s), 0))},
        before=window_s,
    )


# Noise-adaptation limits of the filter.
KALMAN_ALPHA, KALMAN_GATE = 0.02, 9.0
KALMAN_R = (1.0, 1e4)
KALMAN_Q = (1e-4, 1e3)


def kalman_rows(z: np.ndarray, state: list[float] | None, q: float, r: float, dt: float, adapt: bool):
    """Level/slope filter over one array; state carries across calls.

    The 2x2 covariance is kept as three numbers, so a step is scalar arithmetic.
    """
    if state is None:
        lvl, slp, p00, p01, p11 = z[0], 0.0, 1e3, 0.0, 1e3
        noise, c, nis = r, r, 1.0
    else:
        lvl, slp, p00, p01, p11, q, noise, c, nis = state
    q00, q01, q11 = dt**3 / 3, dt**2 / 2, dt
    out = np.empty((len(z), 4))
    for i, v in enumerate(z):
        m0, m1 = lvl + dt * slp, slp
        a00 = p00 + 2 * dt * p01 + dt * dt * p11 + q * q00
        a01 = p01 + dt * p11 + q * q01
        a11 = p11 + q * q11
        innov, s = v - m0, a00 + noise
        k0, k1 = a00 / s, a01 / s
        lvl, slp = m0 + k0 * innov, m1 + k1 * innov
        p00, p01, p11 = (1 - k0) * a00, (1 - k0) * a01, a11 - k1 * a01
        if adapt:
            i2 = min(innov * innov, KALMAN_GATE * s)
            c += KALMAN_ALPHA * (i2 - c)
            noise = min(max(c - a00, KALMAN_R[0]), KALMAN_R[1])
            nis += KALMAN_ALPHA * (i2 / s - nis)
            q = min(max(q * nis**KALMAN_ALPHA, KALMAN_Q[0]), KALMAN_Q[1])
        out[i] = lvl + dt * slp, lvl, slp, innov
    return out, [lvl, slp, p00, p01, p11, q, noise, c, nis]


class Gains:
    """Gains of the filter with fixed noise. They follow from the row number alone and soon stand still."""

    def __init__(self, q: float, r: float, dt: float):
        self.q, self.r, self.dt = q, r, dt
        self.p, self.settled = (1e3, 0.0, 1e3), False
        self.k: list[tuple[float, float]] = []

    def at(self, first: int, n: int) -> np.ndarray:
        """Gains of rows ``first .. first + n - 1`` of a series, counted from 0."""
        dt, q = self.dt, self.q
        while len(self.k) < first + n and not self.settled:
            p00, p01, p11 = self.p
            a00 = p00 + 2 * dt * p01 + dt * dt * p11 + q * dt**3 / 3
            a01 = p01 + dt * p11 + q * dt**2 / 2
            a11 = p11 + q * dt
            s = a00 + self.r
            k0, k1 = a00 / s, a01 / s
            new = ((1 - k0) * a00, (1 - k0) * a01, a11 - k1 * a01)
            self.settled = all(abs(x - y) <= 1e-15 * abs(y) for x, y in zip(new, self.p, strict=True))
            self.p = new
            self.k.append((k0, k1))
        out = self.k[first : first + n]
        return np.array(out + [self.k[-1]] * (n - len(out)))


class AffineFilter:
    """Fixed-gain filters of several settings as a relay: a block maps each one's (level, slope) by a 2x2 matrix and a shift.

    All blocks at hand take their next row together, as arrays of block by
    setting. A long block is a relay of its own: pieces of ``PIECE`` rows.
    """

    PIECE = 512

    def __init__(self, settings: Sequence[tuple[float, float]], dt: float):
        self.gains, self.dt = [Gains(q, r, dt) for q, r in settings], dt
        self.size = len(self.gains)

    def _gains(self, rows: int) -> np.ndarray:
        """Both gains of the first rows of a series by setting, up to where all stand still."""
        for g in self.gains:
            g.at(0, rows)
        top = max(len(g.k) for g in self.gains)
        return np.stack([np.array(g.k)[np.minimum(np.arange(top), len(g.k) - 1)] for g in self.gains], axis=1)

    def _pieces(self, starts: np.ndarray, n: int) -> np.ndarray:
        ends = np.append(starts[1:], n)
        return np.concatenate([np.arange(a, b, self.PIECE) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])

    def _maps(self, z: np.ndarray, number: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Six numbers of each piece and setting."""
        order, first, live = lockstep(starts, len(z))
        k = self._gains(int(number.max()) + 1)
        m = np.zeros((6, len(starts), self.size))
        m[0] = m[3] = (number[first] > 0)[:, None]  # the first value is the state
        m[4] = np.where(number[first] > 0, 0.0, z[first])[:, None]
        dt = self.dt
        for i, c in enumerate(live.tolist()):
            at = first[:c] + i
            v, (k0, k1) = z[at, None], np.moveaxis(k[np.minimum(number[at], len(k) - 1)], 2, 0)
            m00, m01, m10, m11, c0, c1 = (x[:c] for x in m)
            a00, a01, ahead = m00 + dt * m10, m01 + dt * m11, c0 + dt * c1
            new = (1 - k0) * a00, (1 - k0) * a01, m10 - k1 * a00, m11 - k1 * a01, ahead + k0 * (v - ahead), c1 + k1 * (v - ahead)
            for x, y in zip(m, new, strict=True):
                x[:c] = y
        out = np.empty((len(starts), self.size, 6))
        out[order] = np.moveaxis(m, 0, 2)
        return out

    def _states(self, m: np.ndarray, starts: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The state before each map, in groups that begin with ``state``."""
        order, first, live = lockstep(starts, len(m))
        a, b = np.moveaxis(state[order], 2, 0).copy()
        out = np.empty((len(m), self.size, 2))
        for i, c in enumerate(live.tolist()):
            at = first[:c] + i
            x, p, q = m[at], a[:c].copy(), b[:c].copy()
            out[at, :, 0], out[at, :, 1] = p, q
            a[:c] = x[..., 0] * p + x[..., 1] * q + x[..., 4]
            b[:c] = x[..., 2] * p + x[..., 3] * q + x[..., 5]
        return out

    def publish(self, z: np.ndarray, number: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers of each block; ``number`` is a row's place in its series from 0."""
        pieces = self._pieces(starts, len(z))
        m = self._maps(z, number, pieces)
        if len(pieces) == len(starts):
            return m.reshape(len(starts), -1)
        order, first, live = lockstep(np.searchsorted(pieces, starts), len(pieces))
        all_m = m[first]
        for i, c in list(enumerate(live.tolist()))[1:]:
            x, (p00, p01, p10, p11, c0, c1) = m[first[:c] + i], np.moveaxis(all_m[:c], 2, 0)
            x00, x01, x10, x11, y0, y1 = np.moveaxis(x, 2, 0)
            all_m[:c] = np.stack(
                [x00 * p00 + x01 * p10, x00 * p01 + x01 * p11, x10 * p00 + x11 * p10, x10 * p01 + x11 * p11,
                 x00 * c0 + x01 * c1 + y0, x10 * c0 + x11 * c1 + y1], axis=2,
            )
        out = np.empty_like(all_m)
        out[order] = all_m
        return out.reshape(len(starts), -1)

    def follow(self, said: Sequence[np.ndarray], starts: np.ndarray) -> list[np.ndarray | None]:
        m = np.stack([np.asarray(x, float) for x in said]).reshape(len(said), self.size, 6)
        out: list = list(self._states(m, starts, np.zeros((len(starts), self.size, 2))).reshape(len(said), -1))
        for i in starts.tolist():
            out[i] = None
        return out

    def run(
        self, states: Sequence[Sequence[float] | None], z: np.ndarray, number: np.ndarray, starts: np.ndarray, only_next: bool = False
    ) -> np.ndarray:
        """Prediction, level, slope and innovation of each row and setting, or the prediction alone."""
        zero = np.zeros(self.size)
        begin = np.stack(
            [np.stack([zero + z[s], zero], axis=1) if x is None else np.asarray(x, float).reshape(-1, 2) for x, s in zip(states, starts.tolist(), strict=True)]
        )
        pieces = self._pieces(starts, len(z))
        if len(pieces) > len(starts):
            begin = self._states(self._maps(z, number, pieces), np.searchsorted(pieces, starts), begin)
        order, first, live = lockstep(pieces, len(z))
        k = self._gains(int(number.max()) + 1)
        lvl, slp = np.moveaxis(begin[order], 2, 0).copy()
        out, dt = np.empty((len(z), self.size, 1 if only_next else 4)), self.dt
        for i, c in enumerate(live.tolist()):
            at = first[:c] + i
            k0, k1 = np.moveaxis(k[np.minimum(number[at], len(k) - 1)], 2, 0)
            m0 = lvl[:c] + dt * slp[:c]
            innov = z[at, None] - m0
            lvl[:c] = m0 + k0 * innov
            slp[:c] += k1 * innov
            ahead = lvl[:c] + dt * slp[:c]
            for j, x in enumerate((ahead,) if only_next else (ahead, lvl[:c], slp[:c], innov)):
                out[at, :, j] = x
        return out


def kalman(
    df: DataFrame, series: Series, col: str, q: float = 0.1, r: float = 5.0, dt: float = 1.0,
    adapt: bool = False, slice_width: float | None = None,
) -> DataFrame:
    """Level, slope, next-value prediction and innovation per row.

    Nulls are skipped and stay null in a later left join. With fixed noise the
    filter is an affine map of its state, so all buckets of a series run at once
    (:func:`~wattframe.plans.blocks.relay`). The adaptive filter has no such
    form; it runs slice by slice, by default one bucket width at a time.
    """
    cols = [*series.key, series.ts, *series.tie]
    names = ["pred_next", "level", "slope", "innov"]
    rows = df.filter(F.col(col).isNotNull()).select(*cols, F.col(col).cast("double").alias("_wf_z"))
    schema = T.StructType(
        [*[df.schema[c] for c in cols], T.StructField("_wf_z", T.DoubleType())]
        + [T.StructField(n, T.DoubleType()) for n in names]
    )

    def told(pdf: pd.DataFrame, out: np.ndarray) -> pd.DataFrame:
        return pdf[[*cols, "_wf_z"]].assign(**{n: out[:, i] for i, n in enumerate(names)})

    def step(state, pdf: pd.DataFrame):
        out, state = kalman_rows(pdf["_wf_z"].to_numpy(), state, q, r, dt, adapt)
        return told(pdf, out), state

    if adapt:
        made = fold(rows, series, step, schema, slice_width or series.width)
    else:
        filter = AffineFilter([(q, r)], dt)

        def publish(pdf: pd.DataFrame, starts: np.ndarray) -> list[np.ndarray]:
            return list(filter.publish(pdf["_wf_z"].to_numpy(), pdf["_wf_n"].to_numpy() - 1, starts))

        def apply(states, pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            return told(pdf, filter.run(states, pdf["_wf_z"].to_numpy(), pdf["_wf_n"].to_numpy() - 1, starts)[:, 0])

        made = relay(number_rows(rows, series, "_wf_n"), series, publish, filter.follow, apply, schema)
    return made.withColumnRenamed("_wf_z", col)


class SlewMap:
    """What a run of targets does to any starting value of a slew-limited series.

    The map is continuous, rises with slope 1 or stands still, and has slope 1
    outside its corners ``(xs, ys)``. A target makes the stretch of values that
    reach it one flat piece, so corners merge about as fast as they arise.
    """

    def __init__(self, up: float, down: float):
        self.up, self.down = up, down
        self.xs: list[float] = []
        self.ys: list[float] = []

    def add(self, v: float) -> None:
        xs, ys, low, high = self.xs, self.ys, v - self.up, v + self.down
        i, j = bisect_right(ys, low), bisect_left(ys, high)
        a = low if not xs else (xs[0] + low - ys[0] if i == 0 else xs[i - 1] + low - ys[i - 1])
        b = high if not xs else (xs[-1] + high - ys[-1] if j == len(ys) else xs[j] + high - ys[j])
        self.xs = [*xs[:i], a, b, *xs[j:]]
        self.ys = [*[y + self.up for y in ys[:i]], v, v, *[y - self.down for y in ys[j:]]]

    @staticmethod
    def value(xs: np.ndarray, ys: np.ndarray, x: float) -> float:
        k = int(np.searchsorted(xs, x, side="right"))
        if k == 0:
            return float(ys[0] + x - xs[0])
        if k == len(xs):
            return float(ys[-1] + x - xs[-1])
        return float(min(ys[k - 1] + x - xs[k - 1], ys[k]))


def slew_limit(df: DataFrame, series: Series, target: str, up: float, down: float, name: str = "limited") -> DataFrame:
    """Follow a target by at most ``up`` / ``down`` per row.

    All buckets of a series run at once: each publishes its :class:`SlewMap`.
    """
    cols = [*series.key, series.ts, *series.tie]
    rows = df.filter(F.col(target).isNotNull()).select(*cols, F.col(target).cast("double").alias("_wf_z"))

    def publish(pdf: pd.DataFrame, starts: np.ndarray) -> list[list[float]]:
        z, out = pdf["_wf_z"].tolist(), []
        for a, b in spans(starts, len(z)):
            m = SlewMap(up, down)
            for v in z[a:b]:
                m.add(v)
            out.append([z[a], *m.xs, *m.ys])
        return out

    def follow(said: Sequence[np.ndarray], starts: np.ndarray) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for a, b in spans(starts, len(said)):
            y = None
            for x in said[a:b]:
                out.append(None if y is None else [y])
                n = len(x) // 2
                y = SlewMap.value(x[1 : n + 1], x[n + 1 :], x[0] if y is None else y)
        return out

    def apply(states, pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        z, out = pdf["_wf_z"].tolist(), []
        for state, (a, b) in zip(states, spans(starts, len(z)), strict=True):
            y = z[a] if state is None else float(state[0])
            for v in z[a:b]:
                y = min(y + up, v) if v > y else max(y - down, v)
                out.append(y)
        return pdf[cols].assign(**{name: out})

    schema = T.StructType([*[df.schema[c] for c in cols], T.StructField(name, T.DoubleType())])
    return relay(rows, series, publish, follow, apply, schema)


def trivial_score(df: DataFrame, series: Series, power: str = "power_watts", name: str = "trivial") -> DataFrame:
    """Reactive score |dP|."""
    seen = Timeline(df, series).scan(_wf_p=previous(F.col(power)))
    return seen.with_columns({name: F.abs(F.col(power) - F.col("_wf_p"))}).done().drop("_wf_p")


def one_step_errors(df: DataFrame, series: Series, z: str, pred: str) -> DataFrame:
    """RMSE and MAE of a next-value prediction per series."""
    seen = Timeline(df, series).scan(_wf_pred=previous(F.col(pred))).done()
    e = F.col("_wf_pred") - F.col(z)
    return seen.groupBy(*series.key).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")
    )


def persistence_errors(df: DataFrame, series: Series, z: str) -> DataFrame:
    """Errors of predicting the last value."""
    return one_step_errors(df.withColumn("_wf_last", F.col(z)), series, z, "_wf_last")


def noise_reduction(df: DataFrame, series: Series, z: str, level: str, rows: int = 600) -> DataFrame:
    """Noise of raw and filtered differences on the calmest window."""
    seen = Timeline(df, series).scan(
        rn=running_count(), _wf_z=previous(F.col(z)), _wf_l=previous(F.col(level))
    )
    d = seen.with_columns(
        {"_wf_dz": F.col(z) - F.col("_wf_z"), "_wf_dl": F.col(level) - F.col("_wf_l")}
    ).done()

    def stage(w: WindowSpec) -> dict[str, Column]:
        # differences s .. s+rows-1 are those of rows s+1 .. s+rows
        frame = w.rowsBetween(1, rows)
        full = F.count("_wf_dz").over(frame) == rows
        return {"_wf_calm": F.when(full, F.avg(F.abs("_wf_dz")).over(frame))}

    calm = by_rows(d, series, stage, after=rows, row_number="rn")
    start = calm.groupBy(*series.key).agg(
        F.coalesce(
            F.min_by("rn", F.when(F.col("_wf_calm").isNotNull(), F.struct("_wf_calm", "rn"))), F.lit(1)
        ).alias("_wf_s")
    )
    inside = d.join(start, list(series.key)).filter(
        (F.col("rn") > F.col("_wf_s")) & (F.col("rn") < F.col("_wf_s") + rows)
    )
    out = inside.groupBy(*series.key).agg(
        F.stddev_pop("_wf_dz").alias("raw_std"), F.stddev_pop("_wf_dl").alias("filtered_std")
    )
    return out.withColumn("ratio", F.try_divide(F.col("filtered_std"), F.col("raw_std")))


def transient_error(
    df: DataFrame, series: Series, z: str, pred: str, events: int = 50, half: int = 3
) -> DataFrame:
    """Mean one-step error around the sharpest steps, overlaps counted twice."""
    from wattframe.plans.quantiles import descending_rank

    seen = Timeline(df, series).scan(
        rn=running_count(), _wf_z=previous(F.col(z)), _wf_p=previous(F.col(pred))
    ).done()
    step = seen.withColumns(
        {"_wf_d": F.abs(F.col(z) - F.col("_wf_z")), "_wf_e": F.abs(F.col("_wf_p") - F.col(z))}
    )
    ranked = descending_rank(
        step.filter("_wf_d IS NOT NULL").select(*series.key, "rn", "_wf_d"),
        series.key, "_wf_d", [F.col("rn").desc()], "_wf_rank"
    ).filter(F.col("_wf_rank") <= events)
    # step i sits between rows i and i+1 (1-based rn-1 and rn); errors i-half .. i+half-1
    near = ranked.select(
        *series.key, F.explode(F.sequence(F.col("rn") - half, F.col("rn") + half - 1)).alias("rn")
    )
    errors = step.filter("_wf_e IS NOT NULL").select(*series.key, "rn", "_wf_e")
    return near.join(errors, [*series.key, "rn"]).groupBy(*series.key).agg(
        F.avg("_wf_e").alias("transient_error")
    )


def noise_gate(w: WindowSpec, c: str, rows: int = 40) -> Column:
    """Rolling population variance, null until half full."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(c).over(frame) >= rows // 2, F.var_pop(c).over(frame))


def quiescent(
    df: DataFrame, series: Series, power: str, baseline: str, guard_w: float = 40.0,
    settle_s: float = 0.35, name: str = "resolved",
) -> DataFrame:
    """Back at the baseline for long enough that a drop is already over."""
    pos = series.position(df)
    high = F.col(power) > F.col(baseline) + guard_w
    seen = Timeline(df, series).scan(_wf_high=last_seen(F.when(high, pos)))
    quiet = F.coalesce(
        (pos - F.col("_wf_high")) / F.lit(float(series.scale(df))) >= settle_s, F.lit(True)
    )
    return seen.with_columns({name: F.coalesce(~high & quiet, F.lit(False))}).done().drop("_wf_high")
