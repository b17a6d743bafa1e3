"""Power-trace metrics and fleet load projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.operators.grid import drop_nonincreasing, resample
from wattframe.plans.decay import Decay, decayed_sums
from wattframe.plans.quantiles import attach
from wattframe.plans.timeline import Timeline, previous
from wattframe.series import Series

YEAR_S = 365.25 * 24 * 3600
RAMP_LIMIT_MW_S = 0.333
LOLE_TARGET = 0.1
UNDER_FREQ_HZ = -0.7
SAG_LIMIT_PU = 0.95
REGION_MW, SENSITIVITY = 10_000.0, 2.0
BASE_W = 300.0
PUE_IDLE, PUE_FULL, PUE_MEAN = 1.60, 1.15, 1.35
PF_MIN, PF_MAX = 0.85, 0.97
UPS_TAU_S = 15.0


def annualize(x: Column, seconds: Column) -> Column:
    return F.try_divide(x * YEAR_S, seconds)


def _steps(df: DataFrame, series: Series, v: str) -> DataFrame:
    """Adds the previous time and value."""
    return Timeline(df, series).scan(_wf_t=previous(F.col(series.ts)), _wf_v=previous(F.col(v))).done()


def energy(df: DataFrame, series: Series, power: str = "power_W") -> DataFrame:
    """Trapezoid energy, duration, mean, min and max per trace (G1)."""
    t = F.col(series.ts)
    area = (t - F.col("_wf_t")) * (F.col(power) + F.col("_wf_v")) / 2
    return _steps(df, series, power).groupBy(*series.key).agg(
        F.coalesce(F.sum(area), F.lit(0.0)).alias("energy_j"),
        (F.max(t) - F.min(t)).alias("duration_s"),
        F.avg(power).alias("mean_w"),
        F.min(power).alias("min_w"),
        F.max(power).alias("max_w"),
    )


def sanitize(df: DataFrame, series: Series, seq: str, v: str, dt: float = 0.1) -> DataFrame:
    """Increasing time in written order, then a uniform grid (R13 + R15)."""
    by_seq = Series(series.key, seq, (), 1_000_000)
    return resample(drop_nonincreasing(df, by_seq, series.ts), series, v, dt)


def risk_metrics(
    df: DataFrame, series: Series, power: str = "P_W", ramp_limit: float = RAMP_LIMIT_MW_S,
    warmup_s: float = 0.0,
) -> DataFrame:
    """Ramp-risk metrics of a gridded load.

    The warm-up is removed with :func:`wattframe.operators.grid.drop_warmup`
    first; ``warmup_s`` is only recorded.
    """
    dt = F.col(series.ts) - F.col("_wf_t")
    ramp = F.abs(F.try_divide((F.col(power) - F.col("_wf_v")) / 1e6, dt))
    excess = F.greatest(ramp - ramp_limit, F.lit(0.0))
    agg = _steps(df, series, power).groupBy(*series.key).agg(
        F.count_if(excess > 0).alias("n_exceedances_in_trace"),
        F.coalesce(F.sum(excess * dt), F.lit(0.0)).alias("_nrs"),
        (F.max(series.ts) - F.min(series.ts)).alias("_span"),
        F.max(power).alias("_max"),
        F.avg(power).alias("_mean"),
        F.stddev_pop(power).alias("_sd"),
    )
    rrei = annualize(F.col("n_exceedances_in_trace"), F.col("_span"))
    lole = rrei * (F.col("_max") / 1e6 / REGION_MW * SENSITIVITY) / 24.0
    return agg.select(
        *series.key,
        F.bround(rrei, 1).alias("rrei_exceedances_per_year"),
        F.bround(annualize(F.col("_nrs"), F.col("_span")), 3).alias("nrs_MW_per_year"),
        F.bround(lole, 4).alias("lole_proxy_days_per_year"),
        F.lit(LOLE_TARGET).alias("lole_target_days_per_year"),
        F.bround(lole / LOLE_TARGET, 4).alias("lole_ratio"),
        F.bround(F.try_divide(F.col("_sd"), F.col("_mean")), 4).alias("cv"),
        F.bround(F.try_divide(F.col("_max"), F.col("_mean")), 4).alias("peak_to_mean"),
        "n_exceedances_in_trace",
        F.lit(ramp_limit).alias("ramp_limit_MW_s"),
        F.bround("_span", 1).alias("trace_duration_s"),
        F.lit(warmup_s).alias("warmup_s"),
    )


def frequency_metrics(df: DataFrame, series: Series, dev: str = "delta_f_hz", limit: float = UNDER_FREQ_HZ) -> DataFrame:
    """Nadir, deviation, steepest change and yearly low-frequency samples."""
    dt = F.col(series.ts) - F.col("_wf_t")
    rocof = F.abs(F.try_divide(F.col(dev) - F.col("_wf_v"), dt))
    span = F.max(series.ts) - F.min(series.ts)
    return _steps(df, series, dev).groupBy(*series.key).agg(
        F.bround(60.0 + F.min(dev), 4).alias("freq_nadir_hz"),
        F.bround(F.min(dev), 4).alias("freq_nadir_deviation_hz"),
        F.bround(F.max(rocof), 5).alias("rocof_max_hz_per_s"),
        F.bround(annualize(F.count_if(F.col(dev) < limit), span), 1).alias("under_freq_events_per_year"),
        F.lit(60.0 + limit).alias("under_freq_limit_hz"),
    )


def voltage_metrics(df: DataFrame, series: Series, v: str = "v_pu", limit: float = SAG_LIMIT_PU) -> DataFrame:
    """Lowest and mean voltage, sag depth and yearly sag samples."""
    span = F.max(series.ts) - F.min(series.ts)
    return df.groupBy(*series.key).agg(
        F.bround(F.min(v), 5).alias("min_voltage_pu"),
        F.bround(1.0 - F.min(v), 5).alias("voltage_sag_depth_pu"),
        F.lit(limit).alias("voltage_sag_limit_pu"),
        F.bround(annualize(F.count_if(F.col(v) < limit), span), 1).alias("voltage_sag_events_per_yr"),
        F.bround(F.avg(v), 5).alias("mean_voltage_pu"),
    )


def power_block(df: DataFrame, series: Series, power: str = "P_W") -> DataFrame:
    """Peak and mean MW, energy in MJ."""
    e = energy(df, series, power)
    return e.select(
        *series.key,
        F.bround(F.col("max_w") / 1e6, 4).alias("peak_MW"),
        F.bround(F.col("mean_w") / 1e6, 4).alias("mean_MW"),
        F.bround(F.col("energy_j") / 1e6, 3).alias("trace_energy_MJ"),
    )


def efficiency(df: DataFrame, gflops: str, mean_w: str, servers: float = 10_000.0) -> DataFrame:
    """Fleet TFLOPS and Gflops per watt from facility mean power."""
    cpu_w = F.greatest(F.lit(1.0), F.col(mean_w) / PUE_MEAN / servers - BASE_W)
    return df.withColumns(
        {
            "hpl_gflops_server": F.bround(gflops, 4),
            "fleet_tflops_sustained": F.bround(F.col(gflops) * servers / 1000.0, 2),
            "gflops_per_watt_server": F.bround(F.col(gflops) / cpu_w, 6),
        }
    )


def metrics_document(
    power: DataFrame, risk: DataFrame, key: Sequence[str], frequency: DataFrame | None = None,
    voltage: DataFrame | None = None,
) -> DataFrame:
    """Nested per-trace document of the metric blocks (K2)."""

    def nest(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.struct(*[c for c in df.columns if c not in key]).alias(name))

    out = nest(power, "power").join(nest(risk, "risk"), list(key))
    for name, block in (("frequency", frequency), ("voltage", voltage)):
        if block is not None:
            out = out.join(nest(block, name), list(key), "left")
    return out


def fleet_load(
    df: DataFrame, series: Series, power: str = "power_W", servers: Sequence[int] = (10_000,),
    tau_s: float = UPS_TAU_S,
) -> tuple[DataFrame, DataFrame]:
    """Facility active and reactive power of whole fleets.

    ``N (p + 300)`` scaled by a load-dependent PUE, smoothed by the UPS time
    constant with the true step of each row.  Adds ``n_servers`` to the key,
    ``P_W`` and ``Q_var``.  Returns the load and the all-zero traces.
    """
    key = list(series.key)
    agg = F.col(power) + BASE_W
    peak = df.groupBy(*key).agg(F.max(agg).alias("_wf_peak"), F.max(power).alias("_wf_top"))
    rows = attach(df, peak.filter("_wf_peak > 0").drop("_wf_top"), key, "inner")
    frac = agg / F.col("_wf_peak")
    rows = rows.withColumns(
        {
            "it_fraction": frac,
            "_wf_raw": agg * (PUE_IDLE - (PUE_IDLE - PUE_FULL) * frac),
            "power_factor": PF_MIN + (PF_MAX - PF_MIN) * frac,
        }
    )
    seen = Timeline(rows, series).scan(_wf_t=previous(F.col(series.ts))).done()
    keep = F.exp(-(F.col(series.ts) - F.col("_wf_t")) / tau_s)
    first = F.col("_wf_t").isNull()
    mark = F.when(first, F.col("_wf_raw")).otherwise((1 - keep) * F.col("_wf_raw"))
    smooth = decayed_sums(seen, series, _wf_one=Decay(mark, tau_s))
    # the load is linear in the fleet size, so one filter pass serves all sizes
    each = smooth.withColumn("n_servers", F.explode(F.array(*[F.lit(int(n)) for n in servers])))
    out = each.withColumn("P_W", F.col("_wf_one") * F.col("n_servers"))
    out = out.withColumn("Q_var", F.col("P_W") * F.tan(F.acos("power_factor")))
    zero = peak.filter("_wf_peak <= 0").select(*key)
    return out.drop("_wf_peak", "_wf_raw", "_wf_t", "_wf_one"), zero


def cv_after(df: DataFrame, series: Series, power: str, skip_s: float, dt: float = 0.1) -> DataFrame:
    """CV on a half-open grid that starts after the warm-up."""
    grid = resample(df, series, power, dt, offset=skip_s, half_open=True)
    return grid.groupBy(*series.key).agg(
        F.try_divide(F.stddev_pop(power), F.avg(power)).alias("cv")
    )
