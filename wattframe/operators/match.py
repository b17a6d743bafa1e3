"""Matching events, alerts, runs and lookups without pairing whole groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.plans.asof import asof
from wattframe.plans.tables import cut
from wattframe.series import MICROS, Series

#: Distinct looked-up values that are broadcast at most.
FEW = 500_000


def shifted(series: Series, df: DataFrame, col: str, seconds: float):
    """Column moved by seconds, in its own type."""
    if series.is_timestamp(df):
        return F.timestamp_micros(F.unix_micros(col) + F.lit(int(round(seconds * MICROS))))
    return F.col(col) + F.lit(seconds)


def _gap(series: Series, df: DataFrame, later: str, earlier: str):
    """Seconds between two columns."""
    if series.is_timestamp(df):
        return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(MICROS))
    return F.col(later) - F.col(earlier)


def first_alert(
    events: DataFrame, alerts: DataFrame, series: Series, lead_s: float, lag_s: float
) -> DataFrame:
    """First alert in ``[event - lead, event + lag]`` per event.

    The first alert from the window start on decides: either it is inside, or
    none is.  Adds ``alert_ts`` and ``latency_s`` (null when unmatched).
    """
    t = series.ts
    probe = events.withColumn("_wf_from", shifted(series, events, t, -lead_s))
    hit = asof(probe, alerts, series, columns={t: "alert_ts"}, left_at="_wf_from", forward=True)
    latency = _gap(series, events, "alert_ts", t)
    inside = latency <= lag_s
    out = hit.withColumn("latency_s", F.when(inside, latency))
    return out.withColumn("alert_ts", F.when(inside, F.col("alert_ts"))).drop("_wf_from")


def overlaps(
    eps: DataFrame, events: DataFrame, series: Series, lead_s: float, lag_s: float, name: str = "matched"
) -> DataFrame:
    """Whether an episode meets any event window (J2): the first event not
    before ``start - lag`` must not lie after ``end + lead``."""
    t = series.ts
    probe = eps.withColumn("_wf_from", shifted(series, events, "start_ts", -lag_s))
    hit = asof(probe, events, series, columns={t: "_wf_ev"}, left_at="_wf_from", forward=True)
    near = _gap(series, events, "_wf_ev", "end_ts") <= lead_s
    return hit.withColumn(name, F.coalesce(near, F.lit(False))).drop("_wf_from", "_wf_ev")


def next_event(
    flags: DataFrame, events: DataFrame, series: Series, horizon_s: float
) -> DataFrame:
    """Seconds to the next event strictly after each flag, null beyond the
    horizon (J3)."""
    t = series.ts
    hit = asof(flags, events, series, columns={t: "event_ts"}, forward=True, strict=True)
    lead = _gap(series, flags, "event_ts", t)
    return hit.withColumn("lead_s", F.when((lead > 0) & (lead <= horizon_s), lead))


def warned_before(events: DataFrame, flags: DataFrame, series: Series, horizon_s: float) -> DataFrame:
    """Lead of the earliest flag in ``[event - horizon, event)``."""
    t = series.ts
    probe = events.withColumn("_wf_from", shifted(series, events, t, -horizon_s))
    hit = asof(probe, flags, series, columns={t: "flag_ts"}, left_at="_wf_from", forward=True)
    lead = _gap(series, events, t, "flag_ts")
    out = hit.withColumn("lead_s", F.when(lead > 0, lead))
    return out.withColumn("flag_ts", F.when(lead > 0, F.col("flag_ts"))).drop("_wf_from")


def confirm(onsets: DataFrame, flags: DataFrame, series: Series, max_rows: int) -> DataFrame:
    """First flag within ``max_rows`` rows of each onset, by row number."""
    return first_alert(onsets, flags, series, 0, max_rows)


def near_any(points: DataFrame, others: DataFrame, series: Series, within: float, name: str = "matched") -> DataFrame:
    """Whether the nearest other point lies within ``within`` either way."""
    t = series.ts
    back = asof(points, others, series, columns={t: "_wf_b"})
    both = asof(back, others, series, columns={t: "_wf_a"}, forward=True)
    ok = (_gap(series, points, t, "_wf_b") <= within) | (_gap(series, points, "_wf_a", t) <= within)
    return both.withColumn(name, F.coalesce(ok, F.lit(False))).drop("_wf_a", "_wf_b")


def pair_baseline(
    df: DataFrame, ids: Sequence[str], arm: str, baseline: str, metrics: Sequence[str]
) -> DataFrame:
    """Each non-baseline row next to the baseline row of the same ids (J6);
    rows without a baseline are skipped."""
    base = df.filter(F.col(arm) == baseline).select(
        *ids, *[F.col(m).alias(f"{m}_base") for m in metrics]
    )
    return df.filter(F.col(arm) != baseline).join(base, list(ids))


def before_onset(df: DataFrame, onsets: DataFrame, series: Series, horizon_s: float, name: str = "label") -> DataFrame:
    """1 when the row lies in ``(onset - horizon, onset]`` of some onset."""
    t = series.ts
    hit = asof(df, onsets, series, columns={t: "_wf_on"}, forward=True)
    near = _gap(series, df, "_wf_on", t) < horizon_s
    return hit.withColumn(name, F.when(near, 1).otherwise(0)).drop("_wf_on")


def outside_runs(df: DataFrame, runs: DataFrame, series: Series) -> DataFrame:
    """Rows in no run (J8): the latest run start must have ended before."""
    starts = runs.select(*series.key, F.col("start_ts").alias(series.ts), "end_ts")
    hit = asof(df, starts, series, columns={"end_ts": "_wf_end"})
    return hit.filter(F.col("_wf_end").isNull() | (F.col(series.ts) > F.col("_wf_end"))).drop("_wf_end")


def align_scores(base: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left reindex of scores by key and time."""
    return base.join(scores, list(keys), "left")


def nearest_value(
    df: DataFrame, table: DataFrame, value: str, at: str, take: str, name: str, width: float = 100.0
) -> DataFrame:
    """Entry of a lookup table nearest to a value, the lower one on ties.

    Each distinct value is looked up once, so what a task holds does not grow
    with the rows that share a value; ``width`` is the range of values of one
    task.  Up to ``FEW`` distinct values are broadcast to the rows.
    """
    axis = Series(("_wf_one",), "_wf_k", (), width)
    left = cut(df.select(F.col(value).alias("_wf_q")).filter("_wf_q IS NOT NULL").distinct()).withColumn("_wf_one", F.lit(1))
    right = cut(table.select(F.lit(1).alias("_wf_one"), F.col(at).alias("_wf_k"), F.col(take).alias("_wf_v")))
    cols = {"_wf_k": "_wf_x0", "_wf_v": "_wf_y0"}
    low = asof(left, right, axis, columns=cols, left_at="_wf_q")
    both = asof(low, right, axis, columns={"_wf_k": "_wf_x1", "_wf_v": "_wf_y1"}, left_at="_wf_q", forward=True)
    closer_low = F.col("_wf_x1").isNull() | (
        F.col("_wf_q") - F.col("_wf_x0") <= F.col("_wf_x1") - F.col("_wf_q")
    )
    pick = F.when(F.col("_wf_x0").isNotNull() & closer_low, F.col("_wf_y0")).otherwise(F.col("_wf_y1"))
    found = both.select("_wf_q", pick.alias(name))
    if left.count() <= FEW:
        found = F.broadcast(found)
    return df.join(found, F.col(value) == F.col("_wf_q"), "left").drop("_wf_q")


def exact_value(df: DataFrame, table: DataFrame, value: str, at: str, take: str, name: str, default: float = -1.0) -> DataFrame:
    """Exact lookup with a default."""
    t = table.select(F.col(at).alias("_wf_at"), F.col(take).alias("_wf_y"))
    out = df.join(t, F.col(value) == F.col("_wf_at"), "left")
    return out.withColumn(name, F.coalesce("_wf_y", F.lit(default))).drop("_wf_at", "_wf_y")


def nearest_rule(board: DataFrame, is_frontier: Column) -> DataFrame:
    """Frontier rule with the closest detection rate to each other rule, and
    which of the two is more precise (J11).

    ``board`` has one row per rule of a fixed rule list, so the whole board is
    one array and the comparison stays inside a row.
    """
    entry = F.struct("rule", "det_rate", "precision", is_frontier.alias("frontier"))
    one = board.groupBy().agg(F.collect_list(entry).alias("_wf_all"))
    mine = one.withColumn("_wf_r", F.explode(F.filter("_wf_all", lambda r: ~r["frontier"])))
    gaps = F.transform(
        F.filter("_wf_all", lambda r: r["frontier"]),
        lambda r: F.struct(
            F.abs(r["det_rate"] - F.col("_wf_r.det_rate")).alias("gap"),
            r["det_rate"].alias("det_rate"), r["rule"].alias("rule"), r["precision"].alias("precision"),
        ),
    )
    near = mine.withColumn("_wf_near", F.array_min(gaps))
    return near.select(
        "_wf_r.rule", "_wf_r.det_rate", "_wf_r.precision",
        F.col("_wf_near.rule").alias("frontier_rule"),
        F.col("_wf_near.precision").alias("frontier_precision"),
        (F.col("_wf_r.precision") > F.col("_wf_near.precision")).alias("wins"),
    )


def lookup_by_name(
    df: DataFrame, table: DataFrame, name: str, value: str, suffix: str = "_worst$"
) -> DataFrame:
    """Metadata by exact name, then by name without suffix; null when absent or
    not a number (J12)."""
    t = table.select(F.col(name).alias("_wf_n"), F.col(value).try_cast("double").alias("_wf_v"))
    stripped = F.regexp_replace(name, suffix, "")
    exact = df.join(t, F.col(name) == F.col("_wf_n"), "left").withColumnRenamed("_wf_v", "_wf_v1").drop("_wf_n")
    both = exact.join(t, stripped == F.col("_wf_n"), "left").drop("_wf_n")
    return both.withColumn(value, F.coalesce("_wf_v1", "_wf_v")).drop("_wf_v1", "_wf_v")
