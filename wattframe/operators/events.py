"""Event detection and sequence operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.plans.folds import map_groups, refractory, spans
from wattframe.plans.quantiles import attach, descending_rank, order_statistics, quantiles
from wattframe.plans.tables import cut, placed
from wattframe.plans.timeline import (
    Timeline,
    by_rows,
    following,
    last_seen,
    number_rows,
    previous,
    running_count,
    running_sum,
)
from wattframe.series import Series

ROWS = 1_000_000.0  # bucket width when the axis is a row number


def row_axis(series: Series, rn: str = "rn") -> Series:
    """The same series ordered by row number."""
    return Series(series.key, rn, (), ROWS)


def find_onsets(
    df: DataFrame, series: Series, z: str, busy: float = 190.0, dip_max: float = 160.0,
    min_step: float = 40.0, gap_rows: int = 10,
) -> DataFrame:
    """Sharp rises out of a low state.

    One row per onset: ``rn`` is the 1-based number of the last low row,
    ``onset_ts`` the time of the first high row, plus ``z`` and ``z_next``.
    The first two rows of a series never qualify, and onsets are more than
    ``gap_rows`` rows apart.
    """
    seen = Timeline(df, series).scan(
        rn=running_count(), z_next=following(F.col(z)), onset_ts=following(F.col(series.ts))
    )
    ok = (
        (F.col("rn") >= 3)
        & (F.col(z) < dip_max)
        & (F.col("z_next") >= busy - 20)
        & (F.col("z_next") - F.col(z) > min_step)
    )
    found = seen.done().filter(ok).select(
        *series.key, series.ts, "rn", F.col(z).alias("z"), "z_next", "onset_ts"
    )
    return refractory(found, row_axis(series), gap_rows)


INF = float("inf")


def true_transitions(
    df: DataFrame, series: Series, power: str, direction: str = "rise", min_step: float = 97.0,
    gap_rows: int = 1,
) -> DataFrame:
    """Raw single-row steps on the non-null rows, stamped after the step."""
    if direction not in ("rise", "drop"):
        raise ValueError(f"unknown transition direction: {direction}")
    sign = 1.0 if direction == "rise" else -1.0
    known = df.filter(F.col(power).isNotNull()).withColumn("_wf_z", F.col(power) * sign)
    on = find_onsets(known, series, "_wf_z", -INF, INF, min_step, gap_rows)
    return on.select(*series.key, F.col("onset_ts").alias(series.ts))


def argmax(take: str, value: str, tie: str) -> Column:
    """Aggregate: ``take`` of the row with the largest ``value``, the one of the
    lowest ``tie`` among equals; rows without either are left out (O3)."""
    known = F.col(value).isNotNull() & F.col(take).isNotNull()
    return F.max_by(take, F.when(known, F.struct(value, -F.col(tie))))


def hf_onsets(df: DataFrame, series: Series, power: str, min_step: float = 25.0, gap_rows: int = 50) -> DataFrame:
    """Onsets on the 100 ms grid, level gates open."""
    return find_onsets(df, series, power, -INF, INF, min_step, gap_rows)


def landings(numbered: DataFrame, series: Series, step: str, min_step: float = 25.0, gap_rows: int = 50) -> DataFrame:
    """First high rows of the same onsets, from rows that carry ``rn`` and their rise over the row before."""
    high = numbered.filter((F.col("rn") >= 4) & (F.col(step) > min_step)).select(*series.key, "rn")
    return refractory(high, row_axis(series), gap_rows)


def hf_label(df: DataFrame, series: Series, power: str, horizon: int = 50, min_step: float = 25.0, gap_rows: int = 50) -> DataFrame:
    """1 when an onset lands within the next ``horizon`` rows."""
    on = hf_onsets(df, series, power, min_step, gap_rows)
    landed = on.select(*series.key, (F.col("rn") + 1).alias("rn"), F.lit(1).alias("_wf_on"))
    rows = number_rows(df, series, "rn").join(landed, [*series.key, "rn"], "left")

    def stage(w: WindowSpec) -> dict[str, Column]:
        return {"label": F.coalesce(F.max("_wf_on").over(w.rowsBetween(1, horizon)), F.lit(0))}

    return by_rows(rows, series, stage, after=horizon, row_number="rn").drop("rn", "_wf_on")


def around(onsets: DataFrame, rows: DataFrame, key: Sequence[str], lo: int, hi: int) -> DataFrame:
    """Rows at offsets ``lo..hi`` from each onset: an equi-join on row number,
    so the work is onsets x window, never onsets x rows."""
    wanted = onsets.withColumnRenamed("rn", "onset_rn").withColumn(
        "offset", F.explode(F.sequence(F.lit(lo), F.lit(hi)))
    )
    wanted = wanted.withColumn("rn", F.col("onset_rn") + F.col("offset"))
    return wanted.join(rows, [*key, "rn"])


def pre_jump_trend(onsets: DataFrame, numbered: DataFrame, series: Series, z: str, n: int = 8) -> DataFrame:
    """Slope and residual deviation of the ``n`` rows before each onset."""
    rows = numbered.select(*series.key, "rn", F.col(z).alias("_wf_z"))
    near = around(onsets.select(*series.key, "rn"), rows, series.key, -n, -1)
    x, y = F.col("offset").cast("double"), F.col("_wf_z")
    fit = near.groupBy(*series.key, F.col("onset_rn").alias("rn")).agg(
        F.count("_wf_z").alias("_n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"),
        F.regr_sxx(y, x).alias("_sxx"),
    )
    resid = F.sqrt(F.greatest(F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"), F.lit(0.0)) / n)
    out = fit.filter(F.col("_n") == n).withColumn("resid_std", resid)
    return out.withColumn("rising", F.col("slope") > F.col("resid_std") / 2).drop("_n", "_syy", "_sxy", "_sxx")


def step_lag(
    onsets: DataFrame, numbered: DataFrame, series: Series, sig: str, pre: int = 50,
    base_end: int = 10, k: float = 3.0, floor: float = 1.0,
) -> DataFrame:
    """Rows between a signal's first move off its baseline and the onset (E5).

    Negative means the signal moved first.  Null when the window is cut off,
    the baseline has gaps or nothing moved.
    """
    rows = numbered.select(*series.key, "rn", F.col(sig).cast("double").alias("_wf_y"))
    near = around(onsets.select(*series.key, "rn"), rows, series.key, -pre, 10)
    base = F.when(F.col("offset") < -base_end, F.col("_wf_y"))
    stats = near.groupBy(*series.key, F.col("onset_rn").alias("rn")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(base).alias("_nb"),
        F.percentile(base, F.lit(0.5)).alias("_med"),
        F.stddev_pop(base).alias("_sd"),
        F.collect_list(F.struct("offset", F.col("_wf_y").alias("y"))).alias("_win"),
    )
    thr = F.col("_med") + F.greatest(F.col("_sd") * k, F.lit(floor))
    moved = stats.withColumn("_thr", thr).withColumn(
        "_first",
        F.array_min(F.transform(F.filter("_win", lambda s: s["y"] > F.col("_thr")), lambda s: s["offset"])),
    )
    whole = (F.col("_n") == pre + 11) & (F.col("_nb") == pre - base_end)
    out = moved.withColumn("lag", F.when(whole, F.col("_first") - 1))
    return out.select(*series.key, "rn", "lag")


def lead_report(lags: DataFrame, key: Sequence[str]) -> DataFrame:
    """Counts of leading, coincident and lagging onsets per signal."""
    by = [*key, "signal"]
    counts = lags.filter("lag IS NOT NULL").groupBy(*by).agg(
        F.count(F.lit(1)).alias("moved"),
        F.count_if(F.col("lag") < 0).alias("led"),
        F.count_if(F.col("lag") == 0).alias("coincident"),
        F.count_if(F.col("lag") > 0).alias("lagged"),
    )
    return counts.join(quantiles(lags, by, "lag", {"median_lag": 0.5}), by)


def onset_gaps(onsets: DataFrame, series: Series) -> DataFrame:
    """Median, p10 and p90 of the time between onsets."""
    seen = Timeline(onsets, series).scan(_wf_t=previous(series.position(onsets))).done()
    gap = (series.position(onsets) - F.col("_wf_t")) / F.lit(float(series.scale(onsets)))
    gaps = seen.withColumn("gap_s", gap)
    return quantiles(gaps, series.key, "gap_s", {"gap_p10": 0.1, "gap_median": 0.5, "gap_p90": 0.9})


def overshoot(
    onsets: DataFrame, numbered: DataFrame, series: Series, z: str, dt: float = 0.1,
    post_s: float = 3.5,
) -> DataFrame:
    """Turbo overshoot after each onset against the settled level."""
    n_post, settled, early = int(post_s / dt), int(2.0 / dt), int(2.5 / dt)
    rows = numbered.select(*series.key, "rn", F.col(z).alias("_wf_z"))
    p75 = quantiles(rows, series.key, "_wf_z", {"_p75": 0.75})
    plateau = (
        attach(rows, p75, series.key)
        .filter(F.col("_wf_z") > F.col("_p75"))
        .groupBy(*series.key)
        .agg(F.stddev_pop("_wf_z").alias("_busy"))
    )
    near = around(onsets.select(*series.key, "rn"), rows, series.key, 1, n_post)
    seg = near.groupBy(*series.key, F.col("onset_rn").alias("rn")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile(F.when(F.col("offset") > settled, F.col("_wf_z")), F.lit(0.5)).alias("pl1"),
        F.collect_list(F.struct("offset", F.col("_wf_z").alias("y"))).alias("_seg"),
    )
    seg = seg.filter(F.col("_n") >= int(3.0 / dt)).join(plateau, list(series.key))
    seg = seg.withColumn("_hi", F.col("pl1") + 2 * F.col("_busy"))
    above = F.filter("_seg", lambda s: s["y"] > F.col("_hi"))
    seg = seg.withColumns(
        {
            "_band": F.array_sort(F.transform(above, lambda s: s["y"])),
            "_last": F.array_max(
                F.transform(F.filter(above, lambda s: s["offset"] <= early), lambda s: s["offset"])
            ),
        }
    )
    n = F.size("_band")
    lo = F.try_element_at("_band", F.floor((n + 1) / 2).cast("int"))
    hi = F.try_element_at("_band", (F.floor(n / 2) + 1).cast("int"))
    pl2 = F.when(n > 0, (lo + hi) / 2).otherwise(F.col("pl1"))
    out = seg.withColumn("pl2", pl2).withColumns(
        {
            "overshoot_w": F.col("pl2") - F.col("pl1"),
            "overshoot_pct": F.try_divide(F.col("pl2") - F.col("pl1"), F.col("pl1")) * 100,
            "window_s": F.coalesce(F.col("_last") * dt, F.lit(0.0)),
        }
    )
    return out.select(*series.key, "rn", "pl1", "pl2", "overshoot_w", "overshoot_pct", "window_s")


def with_islands(df: DataFrame, series: Series, starts: Column, name: str) -> DataFrame:
    """Running count of ``starts``; ``starts`` may use ``_wf_prev_pos``."""
    tl = Timeline(df, series).scan(_wf_prev_pos=previous(series.position(df)))
    tl = tl.scan(**{name: running_sum(F.when(starts, 1).otherwise(0))})
    return tl.done().drop("_wf_prev_pos")


def with_segments(df: DataFrame, series: Series, max_gap_s: float, name: str = "segment") -> DataFrame:
    """Contiguous segments by time gap, numbered from 0."""
    gap = series.position(df) - F.col("_wf_prev_pos") > F.lit(max_gap_s * series.scale(df))
    return with_islands(df, series, gap, name)


def longest_segment(df: DataFrame, series: Series, max_gap_s: float) -> DataFrame:
    """Segment with the most rows per series."""
    seg = with_segments(df, series, max_gap_s).groupBy(*series.key, "segment").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(series.ts).alias("start_ts"),
        F.max(series.ts).alias("end_ts"),
    )
    best = F.max_by(F.struct("segment", "rows", "start_ts", "end_ts"), F.struct("rows", -F.col("segment")))
    return seg.groupBy(*series.key).agg(best.alias("b")).select(*series.key, "b.*")


def busy_runs(
    df: DataFrame, series: Series, usage: str = "usage_percent", threshold: float = 15.0,
    min_run_s: float = 10.0,
) -> DataFrame:
    """Runs above a usage threshold, long enough from first to last busy row."""
    busy = F.coalesce(F.col(usage) > threshold, F.lit(False))
    tl = Timeline(df, series).with_columns({"_wf_busy": busy}).scan(_wf_b=previous(F.col("_wf_busy")))
    begins = F.col("_wf_busy") & ~F.coalesce(F.col("_wf_b"), F.lit(False))
    tl = tl.scan(run=running_sum(F.when(begins, 1).otherwise(0)))
    pos = series.position(df)
    runs = tl.done().filter("_wf_busy").groupBy(*series.key, "run").agg(
        F.min(series.ts).alias("start_ts"),
        F.max(series.ts).alias("end_ts"),
        F.count(F.lit(1)).alias("rows"),
        (F.max(pos) - F.min(pos)).alias("_span"),
    )
    return runs.filter(F.col("_span") >= F.lit(min_run_s * series.scale(df))).drop("_span", "run")


def longest_run(runs: DataFrame, series: Series, ts_cols: tuple[str, str] = ("start_ts", "end_ts")) -> DataFrame:
    """Longest busy run per series, the first on ties."""
    a, b = ts_cols
    span = F.col(b).cast("double") - F.col(a).cast("double")
    best = F.max_by(F.struct(a, b), F.struct(span, -F.col(a).cast("double")))
    return runs.groupBy(*series.key).agg(best.alias("b")).select(*series.key, "b.*")


def episodes(alerts: DataFrame, series: Series, gap_s: float = 2.0) -> DataFrame:
    """Alerts merged while they are at most ``gap_s`` apart."""
    seg = with_segments(alerts, series, gap_s, "episode")
    return seg.groupBy(*series.key, "episode").agg(
        F.min(series.ts).alias("start_ts"),
        F.max(series.ts).alias("end_ts"),
        F.count(F.lit(1)).alias("n_points"),
    )


def flag_episodes(flagged: DataFrame, series: Series, gap_rows: int = 50, rn: str = "rn") -> DataFrame:
    """Start row of each flag episode, split where flags are more than
    ``gap_rows`` rows apart (E12)."""
    axis = row_axis(series, rn)
    tl = Timeline(flagged, axis).scan(_wf_r=previous(F.col(rn))).done()
    first = F.col("_wf_r").isNull() | (F.col(rn) - F.col("_wf_r") > gap_rows)
    return tl.filter(first).drop("_wf_r")


def plateau_window(df: DataFrame, series: Series, power: str, frac: float = 0.99) -> DataFrame:
    """First and last crossing of ``frac`` of the upper-half median.

    Series with fewer than two crossings carry ``found = false``.
    """
    level = order_statistics(df, series.key, power, {"plateau": (0.75, "element")})
    rows = attach(df, level, series.key, "inner")
    hit = F.when(F.col(power) >= frac * F.col("plateau"), F.col(series.ts))
    out = rows.groupBy(*series.key).agg(
        F.first("plateau").alias("plateau"),
        F.min(hit).alias("t_start"),
        F.max(hit).alias("t_end"),
        F.count(hit).alias("hits"),
    )
    return out.withColumn("found", F.col("hits") >= 2)


def trim_to_window(df: DataFrame, windows: DataFrame, series: Series) -> DataFrame:
    """Rows inside each series' window, rebased and rounded to 1 ms."""
    t = series.ts
    ok = windows.filter("found").select(*series.key, "t_start", "t_end")
    kept = df.join(ok, list(series.key)).filter(F.col(t).between(F.col("t_start"), F.col("t_end")))
    zero = kept.groupBy(*series.key).agg(F.min(t).alias("_wf_z"))
    out = kept.join(zero, list(series.key)).withColumn(t, F.bround(F.col(t) - F.col("_wf_z"), 3))
    return out.drop("t_start", "t_end", "_wf_z")


def trim_ends(df: DataFrame, series: Series, head_s: float, tail_s: float) -> tuple[DataFrame, DataFrame]:
    """Cut fixed head and tail, rebase; also the keys left with < 2 rows."""
    t = series.ts
    ends = df.groupBy(*series.key).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    kept = df.join(ends, list(series.key)).filter(
        F.col(t).between(F.col("_lo") + head_s, F.col("_hi") - tail_s)
    )
    size = kept.groupBy(*series.key).agg(F.count(F.lit(1)).alias("_n"), F.min(t).alias("_z"))
    out = kept.join(size.filter("_n >= 2"), list(series.key)).withColumn(
        t, F.bround(F.col(t) - F.col("_z"), 3)
    )
    short = ends.join(size, list(series.key), "left").select(
        *series.key, F.coalesce("_n", F.lit(0)).alias("rows_left")
    )
    return out.drop("_lo", "_hi", "_n", "_z"), short.filter("rows_left < 2")


def usage_edges(
    df: DataFrame, series: Series, usage: str = "usage_percent", threshold: float = 10.0,
    min_slope_per_s: float = 25.0, name: str = "edge",
) -> DataFrame:
    """Signed usage edges +1 / -1 / 0."""
    seen = Timeline(df, series).scan(
        _wf_u=previous(F.col(usage)), _wf_t=previous(series.position(df))
    )
    u, p = F.col(usage), F.col("_wf_u")
    dt = (series.position(df) - F.col("_wf_t")) / F.lit(float(series.scale(df)))
    way = F.when(u >= p, 1).otherwise(-1)
    edge = (
        F.when(p.isNull() | u.isNull() | (dt <= 0), 0)
        .when(F.greatest(u, p) < threshold, 0)
        .when(F.least(u, p) < threshold, way)
        .when(F.abs(u - p) / dt >= min_slope_per_s, way)
        .otherwise(0)
    )
    return seen.with_columns({name: edge}).done().drop("_wf_u", "_wf_t")


def pulses(
    edged: DataFrame, series: Series, pulse_s: float = 1.0, cooldown_s: float = 5.0
) -> DataFrame:
    """Risk pulse and cooldown over signed edges.

    Adds ``fired`` (an edge outside cooldown), ``risk`` while the pulse lasts
    and ``direction`` of the live pulse.
    """
    key = [*series.key, series.ts, *series.tie]
    edges = edged.filter("edge != 0").select(*key, "edge")
    live = refractory(edges, series, cooldown_s, inclusive=True)
    marked = edged.join(live.select(*key, F.lit(True).alias("fired")), key, "left")
    marked = marked.withColumn("fired", F.coalesce("fired", F.lit(False)))
    pos = series.position(marked)
    last = last_seen(F.when(F.col("fired"), F.struct(pos.alias("p"), F.col("edge").alias("d"))))
    seen = Timeline(marked, series).scan(_wf_pulse=last)
    risk = F.coalesce(pos - F.col("_wf_pulse.p") < F.lit(pulse_s * series.scale(edged)), F.lit(False))
    out = seen.with_columns(
        {
            "risk": F.when(risk, 1).otherwise(0),
            "direction": F.when(risk, F.col("_wf_pulse.d")).otherwise(0),
        }
    )
    return out.done().drop("_wf_pulse")


def thinned_flags(flags: DataFrame, series: Series, gap_s: float = 5.0) -> DataFrame:
    """Flags at least ``gap_s`` after the last kept one."""
    return refractory(flags, series, gap_s, inclusive=True)


def cycle_seconds(busy_s: Column, dip_s: Column, stagger_s: Column, ranks: Column) -> Column:
    """One load cycle including both stagger legs."""
    return busy_s + dip_s + 2 * stagger_s * ranks


def burst_schedule(runs: DataFrame, series: Series) -> DataFrame:
    """Scripted onsets in ``[start_ts, end_ts)`` of each run row, which carries
    ``busy_s, dip_s, stagger_s, ranks`` (E19)."""
    period = cycle_seconds(F.col("busy_s"), F.col("dip_s"), F.col("stagger_s"), F.col("ranks"))
    us = F.round(period * 1_000_000).cast("long")
    span = F.unix_micros("end_ts") - F.unix_micros("start_ts")
    n = F.ceil(span / us).cast("long")
    k = runs.withColumns({"_wf_us": us, "_wf_n": n}).filter("_wf_n > 0")
    k = k.withColumn("cycle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_wf_n") - 1)))
    at = F.timestamp_micros(F.unix_micros("start_ts") + F.col("cycle") * F.col("_wf_us"))
    return k.select(*series.key, "cycle", at.alias(series.ts))


def phase_labels(df: DataFrame, runs: DataFrame, series: Series, name: str = "region") -> DataFrame:
    """idle / busy / dip / edge by position in the load cycle."""
    period = cycle_seconds(F.col("busy_s"), F.col("dip_s"), F.col("stagger_s"), F.col("ranks"))
    out = df.join(runs, list(series.key))
    us = F.unix_micros(series.ts) - F.unix_micros("start_ts")
    secs = us / F.lit(1_000_000.0)
    phase = F.pmod(secs, period)
    in_run = (us >= 0) & (F.col(series.ts) < F.col("end_ts"))
    region = (
        F.when(us < 0, "idle")
        .when(in_run & (phase < F.col("busy_s")), "busy")
        .when(in_run & (phase >= F.col("busy_s") + F.col("stagger_s") * F.col("ranks")), "dip")
        .otherwise("edge")
    )
    return out.withColumn(name, region).drop("start_ts", "end_ts", "busy_s", "dip_s", "stagger_s", "ranks")


def isolated(w: WindowSpec, event: str, rows: int = 10) -> Column:
    """Event with none in the ``rows`` rows before."""
    prior = F.coalesce(F.max(event).over(w.rowsBetween(-rows, -1)), F.lit(0))
    return F.when((F.col(event) == 1) & (prior == 0), 1).otherwise(0)


#: Candidates of the first phase per wanted discord.
PROBES = 4


def discords(
    df: DataFrame, series: Series, value: str, m: int, top: int = 5, block: int = 4096
) -> DataFrame:
    """Subsequences of length ``m`` furthest from their nearest z-normalised
    neighbour (E22).

    A neighbour inside the own block bounds a subsequence's distance from above.
    The few with the largest bounds are measured against the whole series; the
    ``top``-th of their distances is a floor that only subsequences with a
    larger bound can pass, and only those are measured, too. So each block meets
    itself and the survivors, not every other block.
    """
    block = max(block, m)
    zone = int(np.ceil(m / 4))
    key = list(series.key)
    rows = number_rows(df, series, "rn").select(*key, "rn", F.col(value).cast("double").alias("y"))
    sizes = rows.groupBy(*key).agg(F.max("rn").alias("_wf_n")).filter(F.col("_wf_n") >= m)
    rows = attach(rows, sizes, key, "inner")
    last = F.floor((F.col("_wf_n") - m) / block).cast("int")  # last block with a start
    own = F.floor((F.col("rn") - 1) / block).cast("int")
    prev = F.when(((F.col("rn") - 1) % block < m - 1) & (own > 0), own - 1)
    held = rows.withColumn("b", F.explode(F.array_compact(F.array(own, prev))))
    held = placed(held.withColumn("_wf_last", last).filter("b <= _wf_last"), [*key, "b"], ["rn"])
    schema = T.StructType(
        [*[df.schema[k] for k in key], T.StructField("rn", T.LongType()), T.StructField("distance", T.DoubleType())]
    )

    def bounds(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = []
        for a, b in spans(starts, len(pdf)):
            part = pdf.iloc[a:b]
            y, rn = part["y"].to_numpy(), part["rn"].to_numpy()
            d = _distances(y, y, m)
            rn = rn[: len(d)]
            d[np.abs(rn[:, None] - rn[None, :]) <= zone] = np.inf
            out.append(pd.DataFrame({**{k: part[k].iloc[0] for k in key}, "rn": rn, "distance": d.min(axis=1)}))
        return pd.concat(out, ignore_index=True)

    upper = cut(map_groups(held, [*key, "b"], ["rn"], bounds, schema))
    blocks = held.select(*key, "b").distinct()

    def measured(chosen: DataFrame) -> DataFrame:
        """Distance of the chosen subsequences to their nearest neighbour in the whole series."""
        points = chosen.select(*key, "rn", F.posexplode(F.sequence("rn", F.col("rn") + m - 1)).alias("at", "_wf_rn"))
        plain = rows.select(*key, F.col("rn").alias("_wf_rn"), "y")
        windows = points.join(plain, [*key, "_wf_rn"]).groupBy(*key, "rn").agg(F.sort_array(F.collect_list(F.struct("at", "y"))).alias("w"))
        asked = windows.select(*key, "rn", F.col("w.y").alias("w")).join(blocks, key)
        empty = F.lit(None).cast("array<double>")
        both = held.select(*key, "b", F.lit(0).alias("side"), "rn", "y", empty.alias("w")).unionByName(
            asked.select(*key, "b", F.lit(1).alias("side"), "rn", F.lit(None).cast("double").alias("y"), "w")
        )

        def meet(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            out = [pd.DataFrame({**{k: pdf[k].iloc[:0] for k in key}, "rn": pdf["rn"].iloc[:0], "distance": pdf["y"].iloc[:0]})]
            for a, b in spans(starts, len(pdf)):
                part = pdf.iloc[a:b]
                here, probes = part[part["side"] == 0], part[part["side"] == 1]
                rn = here["rn"].to_numpy()[: len(here) - m + 1]
                for c in range(0, len(probes), PROBES_AT_ONCE):
                    some = probes.iloc[c : c + PROBES_AT_ONCE]
                    d = _distances(np.concatenate(some["w"].tolist()), here["y"].to_numpy(), m, step=m)
                    at = some["rn"].to_numpy()
                    d[np.abs(at[:, None] - rn[None, :]) <= zone] = np.inf
                    least = _settled(d, np.stack(some["w"].to_numpy()), here["y"].to_numpy(), m)
                    out.append(pd.DataFrame({**{k: part[k].iloc[0] for k in key}, "rn": at, "distance": least}))
            return pd.concat(out, ignore_index=True)

        met = map_groups(both.repartition(*key, "b"), [*key, "b"], ["side", "rn"], meet, schema)
        return cut(met.groupBy(*key, "rn").agg(F.min("distance").alias("distance")).filter(F.col("distance") < float("inf")))

    probes = cut(descending_rank(upper, key, "distance", [F.col("rn")], "_wf_r").filter(F.col("_wf_r") <= PROBES * top).select(*key, "rn"))
    sure = measured(probes)
    kth = F.get(F.sort_array(F.collect_list("distance"), asc=False), F.lit(top - 1))
    floor = sure.groupBy(*key).agg(kth.alias("_wf_floor"))
    # Rounding of the two ways to the same distance must not lose an equal one.
    passing = attach(upper, floor, key).filter(F.col("_wf_floor").isNull() | (F.col("distance") >= F.col("_wf_floor") - 1e-6))
    rest = measured(passing.join(probes, [*key, "rn"], "left_anti").select(*key, "rn"))
    ranked = descending_rank(sure.unionByName(rest), key, "distance", [F.col("rn")], "rank")
    return ranked.filter(F.col("rank") <= top)


#: Probes that are measured against a block together: a matrix of this many rows.
PROBES_AT_ONCE = 1_024


def _distances(x: np.ndarray, y: np.ndarray, m: int, step: int = 1) -> np.ndarray:
    """z-normalised distances between the length-``m`` windows of two blocks, every ``step``-th of the first."""
    a = np.lib.stride_tricks.sliding_window_view(x, m)[::step]
    b = np.lib.stride_tricks.sliding_window_view(y, m)

    def unit(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centred = w - w.mean(axis=1, keepdims=True)
        norm = np.sqrt((centred**2).sum(axis=1))
        flat = norm < 1e-12
        return centred / np.where(flat, 1.0, norm)[:, None], flat

    ua, fa = unit(a)
    ub, fb = unit(b)
    d = np.sqrt(np.maximum(2.0 * m * (1.0 - ua @ ub.T), 0.0))
    d[fa[:, None] & fb[None, :]] = 0.0
    d[fa[:, None] ^ fb[None, :]] = np.sqrt(m)
    return d


def _unit(w: np.ndarray) -> np.ndarray:
    """Unit windows by the same steps for every window, so that equal windows stay equal to the last bit."""
    columns = w.T
    centred = columns - sum(columns) / len(columns)
    norm = np.sqrt(sum(c * c for c in centred))
    return (centred / np.where(norm < 1e-12, 1.0, norm)).T


def _settled(d: np.ndarray, x: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
    """Least of each row of distances between the windows ``x`` and those of ``y``, the nearest ones worked out again.

    A matrix product adds up in an order that depends on its shape. Products
    added up in one fixed order give two windows the same distance from either
    side, so mutual neighbours tie, as they do in SQL.
    """
    least = d.min(axis=1)
    row, col = np.nonzero((d <= least[:, None] + 1e-6) & np.isfinite(d))
    exact, a, b = d[row, col], x[row], np.lib.stride_tricks.sliding_window_view(y, m)[col]
    curved = (np.ptp(a, axis=1) > 0) & (np.ptp(b, axis=1) > 0)
    if curved.any():
        products = (_unit(a[curved]) * _unit(b[curved])).T
        exact[curved] = np.sqrt(np.maximum(2.0 * m * (1.0 - sum(products)), 0.0))
    out = np.full(len(d), np.inf)
    np.minimum.at(out, row, exact)
    return out
