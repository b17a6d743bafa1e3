"""Statistics over runs, features and series."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.operators.features import max_ramp, ramp_rate
from wattframe.operators.grid import interpolate_at
from wattframe.operators.match import outside_runs
from wattframe.plans.folds import map_groups, spans
from wattframe.plans.quantiles import ALL, attach, descending_rank, median, quantiles
from wattframe.plans.tables import cut
from wattframe.plans.timeline import number_rows
from wattframe.series import Series


def idle_baseline_watts(df: DataFrame, runs: DataFrame, series: Series, power: str = "power_watts") -> DataFrame:
    """Median power outside every run (G21); a series with no such row is absent."""
    return median(outside_runs(df, runs, series), series.key, power, "idle_w")


def net_power(df: DataFrame, idle: DataFrame, series: Series, power: str = "power_watts") -> DataFrame:
    """Power above the idle baseline."""
    return attach(df, idle, series.key, "inner").withColumn("net_power_watts", F.col(power) - F.col("idle_w"))


def describe_run(df: DataFrame, series: Series, power: str = "power_watts", window_s: float = 5.0) -> DataFrame:
    """Count, moments, percentiles, ramp, CV and peak-to-mean per run."""
    key = list(series.key)
    aggs = [
        F.count(power).alias("count"), F.avg(power).alias("mean"), F.stddev_samp(power).alias("std"),
        F.min(power).alias("min"), F.max(power).alias("max"),
    ]
    if "net_power_watts" in df.columns:
        aggs.append(F.avg("net_power_watts").alias("net_mean"))
    base = df.groupBy(*key).agg(*aggs)
    q = quantiles(df, key, power, {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    out = base.join(q, key).join(ramp_rate(df, series, power, window_s), key)
    return out.withColumns(
        {
            "cv": F.try_divide(F.col("std"), F.col("mean")),
            "peak_to_mean": F.try_divide(F.col("max"), F.col("mean")),
        }
    )


def correlations(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pairwise-complete Pearson correlations as ``a, b, corr`` rows."""
    pairs = [(a, c) for i, a in enumerate(cols) for c in cols[i:]]
    agg = df.groupBy(*keys).agg(*[F.corr(a, c).alias(f"{a}|{c}") for a, c in pairs])
    rows = agg.unpivot(list(keys), [f"{a}|{c}" for a, c in pairs], "pair", "corr")
    part = F.split("pair", r"\|")
    return rows.select(*keys, part[0].alias("a"), part[1].alias("b"), "corr")


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    c, d, total, tiny = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), 1e-300), 0.0, 1e-300
    total = d
    for m in range(1, 500):
        for coef in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + coef * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + coef / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total / a


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if not (math.isfinite(t) and math.isfinite(df) and df > 0):
        return float("nan")
    return _beta_tail(df / 2.0, 0.5, df / (df + t * t))


def screen(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Two-group screen of each feature (G24): Welch t, p-value, Cohen's d.

    Null where a group has fewer than two values.  All group moments come from
    one aggregate over the rows; only the per-feature p-value is Python.
    """
    long = df.filter(F.col(label).isNotNull()).select(
        *keys, F.col(label).alias("_wf_y"), *[F.col(f).cast("double").alias(f) for f in features]
    )
    long = long.unpivot([*keys, "_wf_y"], list(features), "feature", "x")
    long = long.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    pre = F.when(F.col("_wf_y") > 0, F.col("x"))
    rest = F.when(F.col("_wf_y") == 0, F.col("x"))
    g = long.groupBy(*keys, "feature").agg(
        F.count(pre).alias("n_pre"), F.count(rest).alias("n_normal"),
        F.avg(pre).alias("mean_pre"), F.avg(rest).alias("mean_normal"),
        F.var_samp(pre).alias("_v1"), F.var_samp(rest).alias("_v0"),
    )
    enough = (F.col("n_pre") >= 2) & (F.col("n_normal") >= 2)
    a, c = F.col("_v1") / F.col("n_pre"), F.col("_v0") / F.col("n_normal")
    diff = F.col("mean_pre") - F.col("mean_normal")
    dof = F.try_divide(
        (a + c) * (a + c), a * a / (F.col("n_pre") - 1) + c * c / (F.col("n_normal") - 1)
    )
    g = g.withColumns(
        {
            "t": F.when(enough, F.try_divide(diff, F.sqrt(a + c))),
            "dof": F.when(enough, dof),
            "cohens_d": F.when(enough, F.try_divide(diff, F.sqrt((F.col("_v1") + F.col("_v0")) / 2))),
            "mean_pre": F.when(enough, F.col("mean_pre")),
            "mean_normal": F.when(enough, F.col("mean_normal")),
        }
    ).drop("_v1", "_v0")

    @F.pandas_udf(T.DoubleType())
    def p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(x, v) for x, v in zip(t, dof)])

    return g.withColumn("p_value", F.when(F.col("t").isNotNull(), p_value("t", "dof")))


def monomials(xs: Sequence[str], degree: int) -> dict[str, Column]:
    """All products of predictors up to a total degree."""
    out = {}
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(xs, d):
            term = F.col(combo[0]).cast("double")
            for c in combo[1:]:
                term = term * F.col(c)
            out["*".join(combo)] = term
    return out


def fit_linear(df: DataFrame, y: str, terms: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Least squares from one aggregate of covariances.

    One row per term and ``intercept``: coefficient, standardised coefficient,
    R2, adjusted R2, RMSE and n.  Only the small covariance matrix of a key is
    solved in Python.
    """
    by = list(keys) or [ALL]
    src = df if keys else df.withColumn(ALL, F.lit(1))
    names = list(terms)
    z = [f"_wf_z{i}" for i in range(len(names))] + ["_wf_y"]
    rows = src.select(*by, *[terms[n].alias(z[i]) for i, n in enumerate(names)], F.col(y).cast("double").alias("_wf_y"))
    rows = rows.na.drop(subset=z)
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in z]).alias("means"),
        F.array(*[F.covar_pop(z[i], z[j]) for i, j in pairs]).alias("cov"),
    )
    agg = agg.filter(F.col("n") > len(names) + 1)
    fields = "coef DOUBLE, std_coef DOUBLE, r2 DOUBLE, adj_r2 DOUBLE, rmse DOUBLE, n LONG"
    key_ddl = ", ".join(f"{k} {agg.schema[k].dataType.simpleString()}" for k in by)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                c = np.zeros((len(z), len(z)))
                for (i, j), v in zip(pairs, row["cov"]):
                    c[i, j] = c[j, i] = v
                sd = np.sqrt(np.diag(c))
                scale = np.where(sd > 0, sd, 1.0)
                corr = c / np.outer(scale, scale)
                beta_std, *_ = np.linalg.lstsq(corr[:-1, :-1], corr[:-1, -1], rcond=None)
                beta = beta_std * scale[-1] / scale[:-1]
                means = np.asarray(row["means"], dtype=float)
                r2 = float(beta_std @ corr[:-1, -1])
                n, p = int(row["n"]), len(names) + 1
                fit = [r2, 1 - (1 - r2) * (n - 1) / (n - p), math.sqrt(max(c[-1, -1] * (1 - r2), 0.0)), n]
                head = [row[k] for k in by]
                out.append([*head, "intercept", float(means[-1] - beta @ means[:-1]), 0.0, *fit])
                out += [[*head, t, float(b), float(s), *fit] for t, b, s in zip(names, beta, beta_std)]
            yield pd.DataFrame(out, columns=[*by, "term", "coef", "std_coef", "r2", "adj_r2", "rmse", "n"])

    out = agg.mapInPandas(solve, f"{key_ddl}, term STRING, {fields}")
    return out if keys else out.drop(ALL)


def fit_ols(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Multivariate least squares."""
    return fit_linear(df, y, {x: F.col(x).cast("double") for x in xs}, keys)


def fit_poly(df: DataFrame, y: str, x: str, degrees: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Univariate polynomial fits of several degrees."""
    parts = []
    for d in degrees:
        terms = {f"{x}^{k}": F.pow(F.col(x).cast("double"), F.lit(k)) for k in range(1, d + 1)}
        parts.append(fit_linear(df, y, terms, keys).withColumn("degree", F.lit(d)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit_poly_interactions(df: DataFrame, y: str, xs: Sequence[str], degree: int, keys: Sequence[str] = ()) -> DataFrame:
    """Multivariate polynomial with interactions."""
    return fit_linear(df, y, monomials(xs, degree), keys)


def density_histogram(df: DataFrame, value: str, keys: Sequence[str] = (), bins: int = 45) -> DataFrame:
    """Density histogram over each key's own range, last bin closed."""
    ends = df.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n")
    )
    ends = ends.withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins).filter("_w > 0")
    rows = attach(df.filter(F.col(value).isNotNull()), ends, keys, "inner")
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    out = rows.groupBy(*keys, b.alias("bin"), "_lo", "_w", "_n").agg(F.count(F.lit(1)).alias("count"))
    left = F.col("_lo") + F.col("bin") * F.col("_w")
    return out.select(
        *keys, "bin", left.alias("left"), (left + F.col("_w")).alias("right"), "count",
        (F.col("count") / (F.col("_n") * F.col("_w"))).alias("density"),
    )


#: Points of a series that is transformed in one group.
GROUP = 4_096


def spectrum(df: DataFrame, series: Series, value: str) -> DataFrame:
    """Power ``|FFT|^2`` of each de-meaned series (G41): ``k, n, period, power``.

    Series of at most ``GROUP`` values are transformed whole. A longer transform
    of length ``n = n1 * n2`` is done in two passes of about ``sqrt(n)`` groups
    (:func:`_two_pass`). A length without such factors, a
    prime above all, becomes a convolution with a chirp, which is done at a
    length that has them; so a long series always spreads.
    """
    key = list(series.key)
    clean = df.filter(F.col(value).isNotNull())
    rows = number_rows(clean, series, "_wf_r").select(*key, "_wf_r", F.col(value).cast("double").alias("_wf_x"))
    stats = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg("_wf_x").alias("_wf_m"))

    @F.pandas_udf(T.LongType())
    def factor(n: pd.Series) -> pd.Series:
        return n.map(lambda v: next(d for d in range(math.isqrt(int(v)), 0, -1) if v % d == 0))

    stats = cut(stats.withColumn("n1", factor("n")).withColumn("n2", (F.col("n") / F.col("n1")).cast("long")))
    whole = F.col("n") <= GROUP
    split = F.col("n2") <= 16 * F.col("n1")
    x = attach(rows, stats, key, "inner").withColumn("re", F.col("_wf_x") - F.col("_wf_m")).withColumn("j", F.col("_wf_r") - 1)
    out = _whole(x.filter(whole).select(*key, "n", "j", "re"), key)
    some = stats.agg(F.max(~whole & split), F.max(~whole & ~split)).first()
    if some[0]:
        plain = x.filter(~whole & split).select(*key, "n", "n1", "n2", "j", "re", F.lit(0.0).alias("im"))
        out = out.unionByName(_two_pass(plain, key, ["re"], ["im"], -1).select(*key, "n", "k", "re", "im"))
    if some[1]:
        out = out.unionByName(_chirp(x.filter(~whole & ~split), key))
    half = out.filter((F.col("k") > 0) & (F.col("k") <= F.floor(F.col("n") / 2)))
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return half.select(*key, "n", "k", power.alias("power"), (F.col("n") / F.col("k")).alias("period"))


def _whole(x: DataFrame, key: list[str]) -> DataFrame:
    """Transforms of series of at most ``GROUP`` values, those of one length in a batch as one array."""
    schema = T.StructType(
        [*[x.schema[c] for c in key], T.StructField("n", T.LongType()), T.StructField("k", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("re", "im")]
    )

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        re, keys, pieces = pdf["re"].to_numpy(), {c: pdf[c].to_numpy() for c in key}, []
        sizes = np.diff(np.append(starts, len(pdf)))
        for n in np.unique(sizes).tolist():
            at, k = starts[sizes == n], np.arange(n // 2 + 1)
            z = np.fft.fft(re[at[:, None] + np.arange(n)], axis=1)[:, : len(k)]
            made = {c: np.repeat(v[at], len(k)) for c, v in keys.items()}
            pieces.append(pd.DataFrame({**made, "n": n, "k": np.tile(k, len(at)), "re": z.real.ravel(), "im": z.imag.ravel()}))
        return pd.concat(pieces, ignore_index=True)

    return map_groups(x.repartition(*key), key, ["j"], run, schema)


def _two_pass(x: DataFrame, key: list[str], re: list[str], im: list[str], sign: int, more: Sequence[str] = ()) -> DataFrame:
    """Transforms of length ``n = n1 * n2`` of complex columns over ``j``, as columns over ``k``.

    First ``n2`` transforms of length ``n1`` and a twiddle, then ``n1`` of length
    ``n2``, each a group of its own. Missing places count as zero; each residue
    of ``j`` modulo ``n2`` needs one row. ``more`` are columns of the series.
    """
    numbers = [c for pair in zip(re, im, strict=True) for c in pair]
    fixed = [*key, *more, "n", "n1", "n2"]
    x = x.withColumns({"j2": F.col("j") % F.col("n2"), "j1": F.floor(F.col("j") / F.col("n2")).cast("long")})
    schema = lambda names: T.StructType(
        [*[x.schema[c] for c in fixed], *[T.StructField(c, T.LongType()) for c in names], *[T.StructField(c, T.DoubleType()) for c in numbers]]
    )
    step = np.fft.fft if sign < 0 else lambda v, axis: np.fft.ifft(v, axis=axis) * v.shape[axis]

    def passed(pdf: pd.DataFrame, starts: np.ndarray, place: str, group: str, length: str, out: str, turn: bool) -> pd.DataFrame:
        pieces = []
        for a, b in spans(starts, len(pdf)):
            part = pdf.iloc[a:b]
            size, g, n = int(part[length].iloc[0]), int(part[group].iloc[0]), int(part["n"].iloc[0])
            z = np.zeros((size, len(re)), complex)
            z[part[place].to_numpy()] = part[re].to_numpy() + 1j * part[im].to_numpy()
            z, k = step(z, axis=0), np.arange(size)
            if turn:
                z = z * np.exp(sign * 2j * np.pi * ((g * k) % n) / n)[:, None]
            made = {c: np.full(size, part[c].iloc[0]) for c in fixed}
            made |= {group: g, out: k} | {c: z[:, i].real for i, c in enumerate(re)} | {c: z[:, i].imag for i, c in enumerate(im)}
            pieces.append(pd.DataFrame(made))
        return pd.concat(pieces, ignore_index=True)

    first = map_groups(
        x.repartition(*key, "j2"), [*key, "j2"], ["j1"], lambda p, s: passed(p, s, "j1", "j2", "n1", "k1", True), schema(["j2", "k1"])
    )
    last = map_groups(
        first.repartition(*key, "k1"), [*key, "k1"], ["j2"], lambda p, s: passed(p, s, "j2", "k1", "n2", "k2", False), schema(["k1", "k2"])
    )
    return last.withColumn("k", F.col("k1") + F.col("n1") * F.col("k2")).drop("k1", "k2", "n1", "n2")


def _chirp(x: DataFrame, key: list[str]) -> DataFrame:
    """Transform of any length: the values times a chirp, convolved with the conjugate chirp.

    ``j k = (j^2 + k^2 - (k - j)^2) / 2`` turns the transform into a convolution,
    which takes three transforms of a length ``m >= 2 n - 1`` of balanced factors.
    """
    angle = F.lit(math.pi) * ((F.col("j") * F.col("j")) % (2 * F.col("n"))) / F.col("n")
    m1 = F.ceil(F.sqrt((2 * F.col("n") - 1).cast("double"))).cast("long")
    x = x.select(*key, F.col("n").alias("length"), m1.alias("n1"), "n", "j", "re", F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    x = x.withColumn("n2", F.ceil((2 * F.col("n") - 1) / F.col("n1")).cast("long")).withColumn("n", F.col("n1") * F.col("n2"))
    here = F.struct(F.col("j").alias("j"), (F.col("re") * F.col("c")).alias("ar"), (-F.col("re") * F.col("s")).alias("ai"))
    mirrored = F.when(F.col("j") > 0, F.struct((F.col("n") - F.col("j")).alias("j"), F.lit(0.0).alias("ar"), F.lit(0.0).alias("ai")))
    both = x.withColumn("at", F.explode(F.array_compact(F.array(here, mirrored))))
    both = both.select(*key, "length", "n", "n1", "n2", "at.*", F.col("c").alias("br"), F.col("s").alias("bi"))
    shape = both.groupBy(*key).agg(F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    z = attach(_two_pass(both, key, ["ar", "br"], ["ai", "bi"], -1, ["length"]), shape, key, "inner")
    re = F.col("ar") * F.col("br") - F.col("ai") * F.col("bi")
    im = F.col("ar") * F.col("bi") + F.col("ai") * F.col("br")
    z = z.select(*key, "length", "n", "n1", "n2", F.col("k").alias("j"), (re / F.col("n")).alias("re"), (im / F.col("n")).alias("im"))
    out = _two_pass(z, key, ["re"], ["im"], 1, ["length"]).filter(F.col("k") < F.col("length"))
    # The last factor of the chirp turns the result, but leaves its power.
    return out.select(*key, F.col("length").alias("n"), "k", "re", "im")


def top_periods(df: DataFrame, series: Series, value: str, top: int = 5, min_period: float = 2.0) -> DataFrame:
    """Strongest periods of at least ``min_period`` samples per series."""
    spec = spectrum(df, series, value).filter(F.col("period") >= min_period)
    ranked = descending_rank(spec, series.key, "power", [F.col("k").desc()], "rank")
    return ranked.filter(F.col("rank") <= top)


def calibration_table(
    df: DataFrame, keys: Sequence[str], setting: str, t: str, power: str, warmup_s: float, limit_w: float
) -> DataFrame:
    """Mean power per setting after its warm-up, up to the first setting above
    the limit (G48)."""
    by = [*keys, setting]
    start = df.groupBy(*by).agg(F.min(t).alias("_t0"))
    kept = df.join(start, by).filter(F.col(t) >= F.col("_t0") + warmup_s)
    table = kept.groupBy(*by).agg(F.avg(power).alias("mean_w"), F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(*keys).orderBy(setting).rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.max(F.col("mean_w") > limit_w).over(w), F.lit(False))
    return table.withColumn("_over", over).filter(~F.col("_over")).drop("_over")


def stepwise(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Difference to the first and to the previous row of a small table."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns(
        {
            "delta_first": F.col(value) - F.first(value).over(w),
            "step": F.col(value) - F.lag(value).over(w),
        }
    )


def replay_score(
    measured: DataFrame, demand: DataFrame, series: Series, rows: int, watts_per_core: float,
    tick_s: float, power: str = "power_W",
) -> DataFrame:
    """Ramps, duty, peak ballast, deficit and busy runnable area.

    ``measured`` has ``meas, engaged, ballast, runnable``; ``demand`` is the
    recorded trace.
    """
    key = list(series.key)
    at = measured.withColumn("_wf_when", F.col(series.ts))
    rows_at = interpolate_at(at, demand, series, power, "_wf_when", "_wf_demand")
    top = demand.groupBy(*key).agg((0.8 * F.max(power)).alias("_wf_busy"))
    rows_at = attach(rows_at, top, key)
    own = F.col("meas") - F.col("ballast") * watts_per_core
    agg = rows_at.groupBy(*key).agg(
        F.avg(F.col("engaged").cast("double")).alias("engage_duty"),
        F.max("ballast").alias("ballast_peak"),
        F.avg(F.greatest(F.col("_wf_demand") - own, F.lit(0.0))).alias("mean_deficit_w"),
        F.avg("meas").alias("mean_w"),
        F.coalesce(
            F.sum(F.when(F.col("_wf_demand") > F.col("_wf_busy"), F.col("runnable") * tick_s)), F.lit(0.0)
        ).alias("runnable_busy_cs"),
    )
    return agg.join(max_ramp(measured, series, "meas", rows), key)
