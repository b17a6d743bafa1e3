"""Raw counters to power and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.operators.grid import floor_time
from wattframe.plans.folds import refractory
from wattframe.plans.timeline import Timeline, last_before, last_seen, previous, running_sum
from wattframe.series import MICROS, Series

MICROJOULE = 1e-6


def seconds_since(series: Series, df: DataFrame, earlier: Column) -> Column:
    """Seconds from an earlier position to the row."""
    return (series.position(df) - earlier) / F.lit(float(series.scale(df)))


def wrapped_delta(now: Column, before: Column, max_range: Column | None) -> Column:
    """Counter difference, corrected when the counter wrapped."""
    d = now - before
    return d if max_range is None else F.when(d < 0, d + max_range).otherwise(d)


def energy_deltas(df: DataFrame, series: Series, energy: str, max_range: str | None) -> DataFrame:
    """Adds ``delta`` and ``dt`` per socket row (C1); null on the first row."""
    return energy_timeline(df, series, energy, max_range).done()


def energy_timeline(df: DataFrame, series: Series, energy: str, max_range: str | None) -> Timeline:
    """:func:`energy_deltas` still distributed for further scans."""
    seen = Timeline(df, series).scan(
        _wf_e=previous(F.col(energy)), _wf_t=previous(series.position(df))
    )
    delta = wrapped_delta(F.col(energy), F.col("_wf_e"), F.col(max_range) if max_range else None)
    dt = seconds_since(series, df, F.col("_wf_t"))
    return seen.with_columns({"delta": delta, "dt": dt}).drop("_wf_e", "_wf_t")


def naive_power(df: DataFrame, series: Series, energy: str, max_range: str | None, server: Sequence[str]) -> DataFrame:
    """Summed socket energy over the poll interval."""
    d = energy_deltas(df, series, energy, max_range).filter(F.col("dt") > 0)
    watts = F.sum("delta") * MICROJOULE / F.max("dt")
    return d.groupBy(*server, series.ts).agg(watts.alias("watts"))


def stall_safe_power(df: DataFrame, series: Series, energy: str, max_range: str | None) -> DataFrame:
    """Watts on the rows where the counter advanced.

    Polls without an advance are dropped, so the next advance is divided by all
    the time since the one before it.  Other rows keep a null ``watts``.
    """
    d = energy_timeline(df, series, energy, max_range)
    marks = F.when(F.col("delta").isNull() | (F.col("delta") > 0), series.position(df))
    d = d.scan(_wf_from=last_before(marks))
    span = seconds_since(series, df, F.col("_wf_from"))
    watts = F.when((F.col("delta") > 0) & (span > 0), F.col("delta") * MICROJOULE / span)
    return d.with_columns({"watts": watts}).done().drop("_wf_from")


def windowed_power(
    df: DataFrame, series: Series, energy: str, max_range: str | None, min_window_s: float = 0.05
) -> DataFrame:
    """C3 that also waits for a minimum window before it emits (C4).

    An emission restarts the window, so emissions are the greedy thinning of the
    advances by the time polled since the last one, and a window's energy is the
    difference of two running sums.
    """
    d = energy_timeline(df, series, energy, max_range)
    known = F.col("delta").isNotNull()
    d = d.scan(_wf_uj=running_sum(F.when(known, F.col("delta"))), _wf_s=running_sum(F.when(known, F.col("dt"))))
    kept = [*series.key, series.ts, *series.tie]
    sums = d.done().select(
        *kept, "delta", F.coalesce("_wf_uj", F.lit(0.0)).alias("_wf_uj"), F.coalesce("_wf_s", F.lit(0.0)).alias("_wf_s")
    )
    polled = Series(series.key, "_wf_s", (series.ts, *series.tie), series.width)
    # The first poll opens the first window; it is kept by being first.
    candidates = sums.filter((F.col("delta") > 0) | (F.col("delta").isNull() & (F.col("_wf_s") == 0)))
    emitted = refractory(candidates, polled, min_window_s, inclusive=True)
    seen = Timeline(emitted, polled).scan(_wf_uj0=previous(F.col("_wf_uj")), _wf_s0=previous(F.col("_wf_s")))
    watts = (F.col("_wf_uj") - F.col("_wf_uj0")) * MICROJOULE / (F.col("_wf_s") - F.col("_wf_s0"))
    return seen.done().filter("_wf_s0 IS NOT NULL AND delta > 0").select(*kept, watts.alias("watts"))


def combined_power(
    polls: DataFrame, server: Series, socket: str, sockets: Sequence, watts: str = "watts"
) -> DataFrame:
    """Sum of the latest watts of every socket, once all have reported.

    ``polls`` keeps every poll (null watts where nothing advanced), because the
    total is published on each poll.
    """
    cols = {f"_wf_s{i}": s for i, s in enumerate(sockets)}
    wide = polls.groupBy(*server.key, server.ts).agg(
        *[F.max(F.when(F.col(socket) == s, F.col(watts))).alias(c) for c, s in cols.items()]
    )
    axis = Series(server.key, server.ts, (), server.width)
    latest = Timeline(wide, axis).scan(**{c: last_seen(F.col(c)) for c in cols}).done()
    total = sum((F.col(c) for c in list(cols)[1:]), F.col(next(iter(cols))))
    return latest.select(*server.key, server.ts, total.alias("watts")).filter("watts IS NOT NULL")


def edge_power(
    df: DataFrame, series: Series, energy: str, max_range: str, socket: str, sockets: Sequence,
    server: Series, interval_s: float,
) -> DataFrame:
    """Edge-aligned power per zone, averaged over fixed intervals.

    Intervals are aligned to the clock instead of restarting at each
    publication, which keeps the result independent of processing order.
    """
    d = energy_timeline(df, series, energy, max_range)
    changed = F.col("delta").isNull() | (F.col("delta") != 0)
    marks = F.when(changed, series.position(df))
    d = d.scan(_wf_from=last_before(marks)).done()
    span = seconds_since(series, df, F.col("_wf_from"))
    usable = (F.col("delta") > 0) & (span > 1e-6)  # still negative: wrapped, range unknown
    polls = d.withColumn("watts", F.when(usable, F.col("delta") * MICROJOULE / span))
    fresh = polls.groupBy(*server.key, server.ts).agg(
        F.max(F.col("watts").isNotNull()).alias("_wf_fresh")
    )
    total = combined_power(polls, server, socket, sockets)
    edges = total.join(fresh.filter("_wf_fresh"), [*server.key, server.ts], "left_semi")
    if server.is_timestamp(df):
        bucket = floor_time(F.col(server.ts), interval_s)
    else:
        bucket = F.floor(F.col(server.ts) / interval_s) * interval_s
    return edges.groupBy(*server.key, bucket.alias(server.ts)).agg(
        F.avg("watts").alias("watts"), F.count(F.lit(1)).alias("edges")
    )


def rates(df: DataFrame, series: Series, counters: Sequence[str]) -> DataFrame:
    """Per-second rates; a reset makes the rate null and drops the point."""
    seen = Timeline(df, series).scan(
        _wf_t=previous(series.position(df)), **{f"_wf_{c}": previous(F.col(c)) for c in counters}
    )
    dt = seconds_since(series, df, F.col("_wf_t"))
    out = {}
    for c in counters:
        d = F.col(c) - F.col(f"_wf_{c}")
        out[f"{c}_per_s"] = F.when((d >= 0) & (dt > 0), d / dt)
    done = seen.with_columns(out).done().drop("_wf_t", *[f"_wf_{c}" for c in counters])
    return done.na.drop(subset=list(out))


def cpu_usage(df: DataFrame, series: Series, idle: str, total: str, clamp: bool = False) -> DataFrame:
    """Busy percent from jiffies, 0 when the total did not advance.

    ``clamp`` returns a fraction limited to [0, 1].
    """
    seen = Timeline(df, series).scan(
        _wf_idle=previous(F.col(idle)), _wf_total=previous(F.col(total))
    )
    d_total = F.col(total) - F.col("_wf_total")
    busy = 1.0 - (F.col(idle) - F.col("_wf_idle")) / d_total
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), busy)) if clamp else 100.0 * busy
    usage = F.when(d_total > 0, share).when(d_total.isNotNull(), 0.0)
    return seen.with_columns({"usage": usage}).done().drop("_wf_idle", "_wf_total")


def power_and_derivative(power: DataFrame, series: Series, watts: str = "watts") -> DataFrame:
    """One-step derivative, 0 on the first sample."""
    seen = Timeline(power, series).scan(
        _wf_p=previous(F.col(watts)), _wf_t=previous(series.position(power))
    )
    dt = seconds_since(series, power, F.col("_wf_t"))
    deriv = F.coalesce(F.try_divide(F.col(watts) - F.col("_wf_p"), dt), F.lit(0.0))
    return seen.with_columns({"deriv_w_s": deriv}).done().drop("_wf_p", "_wf_t")
