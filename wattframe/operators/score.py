"""Detector scoring at row and event level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wattframe.operators.events import episodes, true_transitions, usage_edges
from wattframe.operators.match import first_alert, overlaps, shifted
from wattframe.plans.quantiles import ALL, descending_rank, median, order_statistics, quantiles
from wattframe.plans.tables import cut
from wattframe.plans.timeline import BLOCK, POS, Timeline, by_rows, by_time, last_before, running_max, running_sum
from wattframe.series import MICROS, Series


def finite(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.isNotNull() & ~F.isnan(col.cast("double")) & (F.abs(col) < float("inf"))


def pr_auc(df: DataFrame, keys: Sequence[str], label: str, score: str, width: float = 1 / 1024) -> DataFrame:
    """Average precision per key (G28), null without positives.

    Rows are first combined per distinct score, so equal scores count as one
    threshold (a tie has no order of its own).  ``width`` is the score range of
    one bucket of the running sums.
    """
    by = list(keys) or [ALL]
    src = df if keys else df.withColumn(ALL, F.lit(1))
    levels = src.groupBy(*by, F.col(score).cast("double").alias("_wf_s")).agg(
        F.sum(F.col(label).cast("double")).alias("_wf_tp"), F.count(label).alias("_wf_n")
    )
    axis = Series(tuple(by), "_wf_s", (), width)
    run = Timeline(levels, axis).scan(
        reverse=True, tp=running_sum(F.col("_wf_tp")), n=running_sum(F.col("_wf_n"))
    )
    gain = F.col("_wf_tp") * F.try_divide(F.col("tp"), F.col("n").cast("double"))
    out = run.done().groupBy(*by).agg(
        F.try_divide(F.sum(gain), F.sum("_wf_tp")).alias("pr_auc"),
        F.sum("_wf_tp").alias("positives"),
        F.sum("_wf_n").alias("rows"),
    )
    return out if keys else out.drop(ALL)


def flag_score(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Precision, recall and counts of ``score > 0``."""
    ok = df.filter(finite(score) & finite(label))
    y, f = F.col(label) > 0, F.col(score) > 0
    out = ok.groupBy(*keys).agg(
        F.count_if(y).alias("n_spikes"),
        F.count_if(f).alias("n_flags"),
        F.count_if(y & f).alias("n_tp"),
    )
    return out.withColumns(
        {
            "precision": F.try_divide(F.col("n_tp").cast("double"), F.col("n_flags")),
            "recall": F.try_divide(F.col("n_tp").cast("double"), F.col("n_spikes")),
        }
    )


def equal_budget(
    df: DataFrame, keys: Sequence[str], label: str, score: str, ts: str
) -> DataFrame:
    """Flag exactly as many top scores as there are positives."""
    by = list(keys) or [ALL]
    src = df if keys else df.withColumn(ALL, F.lit(1))
    ranked = descending_rank(src, by, score, [F.col(ts)], "_wf_rank")
    n = src.groupBy(*by).agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("_wf_k"))
    out = ranked.join(n if keys else F.broadcast(n), by)
    out = out.withColumn("flag", F.col("_wf_rank") <= F.col("_wf_k")).drop("_wf_rank", "_wf_k")
    return out if keys else out.drop(ALL)


def _seconds(series: Series, df: DataFrame, hi: str, lo: str) -> Column:
    if series.is_timestamp(df):
        return (F.unix_micros(hi) - F.unix_micros(lo)) / F.lit(float(MICROS))
    return F.col(hi) - F.col(lo)


def event_score(
    events: DataFrame, alerts: DataFrame, series: Series, lead_s: float = 5.0, lag_s: float = 5.0,
    gap_s: float = 2.0, bounds: DataFrame | None = None, element_median: bool = False,
) -> DataFrame:
    """Event-level detector score per series.

    ``bounds`` (key, ``start_ts``, ``end_ts``), both ends inclusive, limits
    events and alerts and sets the duration; otherwise the duration is the span
    of the alerts, or of the events.  ``element_median`` takes the upper middle
    latency instead of interpolating (G33).
    """
    series = Series(series.key, series.ts, (), series.width)
    key, t = list(series.key), series.ts
    # Both inputs are read once, into one table of points.
    both = cut(events.select(*key, t, F.lit(True).alias("_ev")).unionByName(alerts.select(*key, t, F.lit(False).alias("_ev"))))
    ev, al = both.filter("_ev").drop("_ev"), both.filter("NOT _ev").drop("_ev")
    if bounds is not None:
        b = bounds.select(*key, "start_ts", "end_ts")
        inside = F.col(t).between(F.col("start_ts"), F.col("end_ts"))
        ev = ev.join(b, key).filter(inside).select(*key, t)
        al = al.join(b, key).filter(inside).select(*key, t)
    matched = cut(first_alert(ev, al, series, lead_s, lag_s))
    eps = overlaps(episodes(al, series, gap_s), ev, series, lead_s, lag_s)
    per_event = matched.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count("latency_s").alias("n_events_detected"),
        F.avg((F.col("latency_s") < 0).cast("double")).alias("event_pre_onset_frac"),
        F.min(t).alias("_ev0"),
        F.max(t).alias("_ev1"),
    )
    if element_median:
        lat = order_statistics(matched, key, "latency_s", {"event_latency_median_s": (0.5, "element")})
    else:
        lat = quantiles(
            matched, key, "latency_s",
            {"event_latency_p25_s": 0.25, "event_latency_median_s": 0.5, "event_latency_p75_s": 0.75},
        )
    per_episode = eps.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_alert_episodes"),
        F.count_if("matched").alias("_matched"),
        F.sum("n_points").alias("n_alert_points"),
        F.min("start_ts").alias("_al0"),
        F.max("end_ts").alias("_al1"),
    )
    every = (bounds.select(*key) if bounds is not None else both.select(*key)).distinct()
    out = every.join(per_event, key, "left").join(lat, key, "left").join(per_episode, key, "left")
    if bounds is not None:
        out = out.join(b, key, "left")
        hours = F.greatest(_seconds(series, events, "end_ts", "start_ts") / 3600.0, F.lit(1e-9))
    else:
        hours = F.when(
            F.col("n_alert_points") > 1,
            F.greatest(_seconds(series, events, "_al1", "_al0") / 3600.0, F.lit(1e-9)),
        ).when(
            F.col("n_events") > 1,
            F.greatest(_seconds(series, events, "_ev1", "_ev0") / 3600.0, F.lit(1e-9)),
        )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_events", "n_events_detected", "n_alert_episodes", "_matched")}
    out = out.withColumns(zero).withColumn("event_eval_hours", hours)
    false = F.col("n_alert_episodes") - F.col("_matched")
    out = out.withColumns(
        {
            "event_recall": F.try_divide(F.col("n_events_detected").cast("double"), F.col("n_events")),
            "alert_event_precision": F.try_divide(F.col("_matched").cast("double"), F.col("n_alert_episodes")),
            "n_false_alert_episodes": false,
            "false_alert_episodes_per_h": F.try_divide(false.cast("double"), F.col("event_eval_hours")),
        }
    )
    quart = [] if element_median else ["event_latency_p25_s", "event_latency_p75_s"]
    return out.select(
        *key, "n_events", "n_events_detected", "event_recall", "event_latency_median_s", *quart,
        "event_pre_onset_frac", "n_alert_episodes", "alert_event_precision",
        "n_false_alert_episodes", "false_alert_episodes_per_h", "event_eval_hours",
    )


def pooled_event_scores(
    events: DataFrame, alerts: DataFrame, series: Series, bounds: DataFrame, by: str, lead_s: float, lag_s: float,
    gap_s: float, hit: str | None = None,
) -> dict[str, dict]:
    """Event scores of several detectors over all series (G31), by the detector's name in ``by``.

    ``events`` and ``alerts`` are stacked over the detectors, and alerts lie
    inside ``bounds``. Detectors are scored in one pass: events, the starts of
    their windows and alerts are stacked, and each looks for its neighbours in
    running frames of the time block. ``lead_time_median_s`` is the median time
    from alerts with a true ``hit`` to the next event, at most ``lead_s`` away.
    """
    key, t = [by, *series.key], series.ts
    axis = Series(tuple(key), t, (), series.width)
    scale = series.scale(events)
    lead, lag, gap = (F.lit(int(round(s * scale)) if scale > 1 else s) for s in (lead_s, lag_s, gap_s))
    limits = bounds.select(*series.key, "start_ts", "end_ts")
    near = events.select(*key, t).join(limits, list(series.key))
    near = near.filter((F.col(t) >= F.col("start_ts")) & (F.col(t) <= shifted(series, events, "end_ts", lead_s)))
    near = near.withColumn("_wf_in", F.col(t) <= F.col("end_ts"))
    point = lambda df, kind, inside, good: df.select(*key, t, F.lit(kind).alias("_wf_kind"), inside.alias("_wf_in"), good.alias("_wf_hit"))
    no = F.lit(False)
    probes = near.filter("_wf_in").withColumn(t, shifted(series, events, t, -lead_s))
    points = point(near, "event", F.col("_wf_in"), no).unionByName(point(probes, "probe", no, no))
    points = points.unionByName(point(alerts, "alert", no, no if hit is None else F.col(hit)))
    kind, pos = F.col("_wf_kind"), F.col(POS)

    def look(w: WindowSpec) -> dict[str, Column]:
        ahead = Window.partitionBy(*key, BLOCK).orderBy(pos.desc())
        upto, before = (w.rangeBetween(Window.unboundedPreceding, x) for x in (0, -1))
        since, after = (ahead.rangeBetween(Window.unboundedPreceding, x) for x in (0, -1))
        step = w.rowsBetween(Window.unboundedPreceding, 0)
        alert, event, inside = (F.when(c, pos) for c in (kind == "alert", kind == "event", F.col("_wf_in")))
        out = {"_e0": F.max(inside).over(upto), "_e1": F.min(inside).over(since), "_next": F.min(event).over(after)}
        out |= {"_a0": F.max(alert).over(before), "_a1": F.min(alert).over(since)}
        return out | {"_first": F.count(alert).over(step) - F.count(alert).over(before) == 1}  # of alerts at one time

    def judge(w: WindowSpec) -> dict[str, Column]:
        late, soon = F.col("_a1") - pos - lead, F.col("_next") - pos
        joined = F.coalesce(pos - F.col("_a0") <= gap, no)
        touched = (pos - F.col("_e0") <= lag) | (F.col("_e1") - pos <= lead) | (joined & (F.col("_e0") >= F.col("_a0")))
        value = F.when((kind == "probe") & (late <= lag), late).when((kind == "alert") & F.col("_wf_hit") & (soon <= lead), soon)
        alone = (kind == "alert") & F.col("_first")
        return {"_s": value / F.lit(float(scale)), "_alone": alone, "_new": alone & ~joined, "_touched": alone & F.coalesce(touched, no)}

    reach_s = max(lead_s + lag_s, gap_s)
    seen = by_time(points.withColumn("_wf_in", F.coalesce("_wf_in", no)), axis, look, judge, before=reach_s, after=reach_s)
    seen = cut(seen.select(*key, t, "_wf_kind", "_s", "_alone", "_new", "_touched"))
    counts = seen.groupBy(by).agg(
        F.count_if(kind == "probe").alias("n_events"),
        F.count(F.when(kind == "probe", F.col("_s"))).alias("n_events_detected"),
        F.count_if("_new").alias("n_alert_episodes"),
    )
    medians = median(seen.filter("_wf_kind <> 'event'"), [by, "_wf_kind"], "_s").collect()
    # An episode is met when one of its alerts is: the first such alert has none before it since the start.
    at = series.position(seen)
    eps = Timeline(seen.filter("_alone"), axis).scan(
        _start=running_max(F.when(F.col("_new"), at)), _met=last_before(F.when(F.col("_touched"), at))
    )
    first = F.col("_touched") & (F.col("_met").isNull() | (F.col("_met") < F.col("_start")))
    met = {r[by]: r["n"] for r in eps.done().groupBy(by).agg(F.count_if(first).alias("n")).collect()}
    hours = F.greatest(_seconds(series, events, "end_ts", "start_ts") / 3600.0, F.lit(1e-9))
    span = limits.agg(F.sum(hours)).first()[0]
    out = {}
    for r in counts.collect():
        name, row = r[by], {c: r[c] for c in counts.columns if c != by}
        mid = {m["_wf_kind"]: m["median"] for m in medians if m[by] == name}
        row |= {"n_false_alert_episodes": row["n_alert_episodes"] - met.get(name, 0), "event_eval_hours": span}
        out[name] = row | {"event_latency_median_s": mid.get("probe"), "lead_time_median_s": mid.get("alert")}
    return out


def span_bounds(df: DataFrame, series: Series) -> DataFrame:
    """First and last row time per series as scoring bounds."""
    return df.groupBy(*series.key).agg(
        F.min(series.ts).alias("start_ts"), F.max(series.ts).alias("end_ts")
    )


def live_score(
    power: DataFrame, risk: DataFrame, series: Series, col: str = "power_watts", min_step: float = 97.0,
    lead_s: float = 5.0, lag_s: float = 5.0, gap_s: float = 2.0,
) -> DataFrame:
    """Score a published 0/1 risk series against raw power onsets."""
    onsets = true_transitions(power, series, col, "rise", min_step)
    alerts = risk.filter("risk > 0")
    return event_score(onsets, alerts, series, lead_s, lag_s, gap_s, span_bounds(power, series))


def duty(flags: DataFrame, keys: Sequence[str], flag: str = "flag") -> DataFrame:
    """Share of rows flagged."""
    return flags.groupBy(*keys).agg(F.avg(F.col(flag).cast("double")).alias("alert_duty"))


def usage_edge_score(
    df: DataFrame, series: Series, threshold: float = 10.0, min_slope_per_s: float = 25.0,
    min_step: float = 97.0, lead_s: float = 5.0, lag_s: float = 5.0, gap_s: float = 2.0,
) -> DataFrame:
    """Usage-edge alerts scored on telemetry, with duty."""
    rows = df.na.drop(subset=["usage_percent", "power_watts"])
    edged = usage_edges(rows, series, "usage_percent", threshold, min_slope_per_s)
    edged = edged.withColumn("flag", F.col("edge") != 0)
    onsets = true_transitions(rows, series, "power_watts", "rise", min_step)
    out = event_score(
        onsets, edged.filter("flag"), series, lead_s, lag_s, gap_s, span_bounds(rows, series)
    )
    points = edged.groupBy(*series.key).agg(
        F.avg(F.col("flag").cast("double")).alias("alert_duty"),
        F.count_if("flag").alias("n_alert_points"),
        F.count(F.lit(1)).alias("n_eval_points"),
    )
    return out.join(points.filter("n_eval_points >= 2"), list(series.key))


def false_alarms(df: DataFrame, keys: Sequence[str], region: str = "region", flag: str = "flag") -> DataFrame:
    """False-alarm rate over dip and idle rows, flag share of busy rows."""
    quiet, busy = F.col(region).isin("dip", "idle"), F.col(region) == "busy"
    f = F.coalesce(F.col(flag), F.lit(False))
    out = df.groupBy(*keys).agg(
        F.count_if(quiet).alias("quiet_rows"),
        F.count_if(quiet & f).alias("false_alarms"),
        F.avg(F.when(busy, f.cast("double"))).alias("busy_flag_frac"),
    )
    rate = F.try_divide(F.col("false_alarms").cast("double"), F.col("quiet_rows"))
    return out.withColumn("false_alarm_rate", rate)


def pool_folds(folds: DataFrame, model: str = "model") -> DataFrame:
    """Fold scores pooled per model (G37): finite means of ratios, recall,
    precision and duty from summed counts."""
    nn = lambda c: F.when(finite(c), F.col(c))
    s = lambda c: F.sum(c).cast("double")
    return folds.groupBy(model).agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg(nn("pr_auc")).alias("pr_auc"),
        F.avg(nn("event_latency_median_s")).alias("event_latency_median_s"),
        F.try_divide(s("n_events_detected"), s("n_events")).alias("event_recall"),
        F.try_divide(
            s("n_alert_episodes") - s("n_false_alert_episodes"), s("n_alert_episodes")
        ).alias("alert_event_precision"),
        F.try_divide(s("n_false_alert_episodes"), F.sum("event_eval_hours")).alias("false_alert_episodes_per_h"),
        F.try_divide(s("n_tp"), s("n_spikes")).alias("recall"),
        F.try_divide(s("n_tp"), s("n_flags")).alias("precision"),
        F.try_divide(s("n_flags"), s("n_rows")).alias("alert_duty"),
    )


def regime_contrast(
    scores: DataFrame, runs: DataFrame, series: Series, threshold: float, before_rows: int = 1800
) -> DataFrame:
    """Mean score and flagged share in the run and in the rows before it.

    ``runs`` has one ``start_ts, end_ts`` row per series.
    """
    from wattframe.operators.grid import latest_rows

    key, t = list(series.key), series.ts
    both = scores.join(runs.select(*key, "start_ts", "end_ts"), key)
    run = both.filter((F.col(t) >= F.col("start_ts")) & (F.col(t) < F.col("end_ts")))
    pre = latest_rows(both.filter(F.col(t) < F.col("start_ts")), series, before_rows)
    tagged = run.withColumn("regime", F.lit("run")).unionByName(pre.withColumn("regime", F.lit("before")))
    return tagged.groupBy(*key, "regime").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("score").alias("mean_score"),
        F.avg((F.col("score") > threshold).cast("double")).alias("flagged_frac"),
    )


def rule_grid(
    scored: DataFrame, onsets: DataFrame, series: Series, rules: dict[str, Column], max_rows: int,
    gap_rows: int, match_rows: int,
) -> DataFrame:
    """Detection, latency and episode precision of many flag rules.

    ``scored`` and ``onsets`` carry ``rn``, which ``scored`` has once per series.
    Rules are a handful of fixed expressions: rows that fire none are left out,
    the onsets are stacked on the others, and one window pass over row numbers
    scores all rules; latencies are whole rows, so only their counts are ranked.
    """
    fired = {f"_wf_f{i}": rule for i, rule in enumerate(rules.values())}
    flags = scored.select(*series.key, F.col("rn").cast("long").alias("rn"), F.lit(False).alias("_wf_on"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in fired.items()])
    flags = flags.filter(F.array_contains(F.array(*fired), True))
    starts = onsets.select(*series.key, F.col("rn").cast("long").alias("rn"), F.lit(True).alias("_wf_on"), *[F.lit(False).alias(n) for n in fired])

    def stage(w: WindowSpec) -> dict[str, Column]:
        soon, gap, near = w.rangeBetween(0, max_rows), w.rangeBetween(-gap_rows, -1), w.rangeBetween(-match_rows, match_rows)
        out = {"_wf_near": F.max("_wf_on").over(near)}
        for n in fired:
            out[f"{n}_lag"] = F.min(F.when(F.col(n), F.col("rn"))).over(soon) - F.col("rn")
            out[f"{n}_new"] = F.col(n) & ~F.coalesce(F.max(n).over(gap), F.lit(False))
        return out

    before, after = max(gap_rows, match_rows), max(max_rows, match_rows)
    seen = by_rows(flags.unionByName(starts), series, stage, before=before, after=after, row_number="rn")
    told = []
    for name, n in zip(rules, fired, strict=True):
        onset = F.struct(F.lit(name).alias("rule"), F.lit(True).alias("onset"), F.col(f"{n}_lag").alias("lag"), F.lit(None).cast("boolean").alias("hit"))
        episode = F.struct(F.lit(name).alias("rule"), F.lit(False).alias("onset"), F.lit(None).cast("long").alias("lag"), F.col("_wf_near").alias("hit"))
        told.append(F.when(F.col("_wf_on"), onset).when(F.col(f"{n}_new"), episode))
    cases = seen.select(F.explode(F.array_compact(F.array(*told))).alias("_wf_t")).select("_wf_t.*")
    tally = cases.groupBy("rule", "onset", "lag", "hit").agg(F.count(F.lit(1)).alias("n"))
    count = lambda c: F.sum(F.when(c, F.col("n")))
    lag = F.when(F.col("onset"), F.col("lag")).cast("double")
    out = tally.groupBy("rule").agg(
        count(F.col("onset")).alias("n_onsets"),
        F.coalesce(count(F.col("onset") & F.col("lag").isNotNull()), F.lit(0)).alias("detected"),
        F.percentile(lag, 0.5, F.col("n")).alias("median_lat"),
        F.percentile(lag, 0.9, F.col("n")).alias("p90_lat"),
        count(~F.col("onset")).alias("n_episodes"),
        count(~F.col("onset") & ~F.col("hit")).alias("false_ep"),
    ).filter("n_onsets IS NOT NULL")
    out = out.withColumn("false_ep", F.when(F.col("n_episodes").isNotNull(), F.coalesce("false_ep", F.lit(0))))
    good = F.col("n_episodes") - F.col("false_ep")
    return out.withColumns(
        {
            "det_rate": F.try_divide(F.col("detected").cast("double"), F.col("n_onsets")),
            "precision": F.try_divide(good.cast("double"), F.col("n_episodes")),
        }
    )
