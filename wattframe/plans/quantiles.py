"""Exact quantiles and ranks without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.plans.tables import cut

ALL = "_wf_all"
ACCURACY = 10_000


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    targets: dict[str, tuple[float, str]],
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per key with order statistics of the non-null values.

    ``targets`` maps an output name to ``(q, how)``; ``how`` is ``linear``
    (interpolated at ``(n-1)q``) or ``element`` (0-based element
    ``floor(n*q)``).  A sketch brackets each target first; only values inside
    the narrow bracket (about ``8/accuracy`` of the rows) are ranked exactly,
    everything below it is only counted, map-side.
    """
    by = list(keys) or [ALL]
    found = _by_target(df, keys, value, targets, accuracy)
    out = found.groupBy(*by).agg(
        *[F.max(F.when(F.col("_wf_t") == name, F.col("_wf_r"))).alias(name) for name in targets]
    )
    return out if keys else out.drop(ALL)


def _by_target(
    df: DataFrame, keys: Sequence[str], value: str, targets: dict[str, tuple[float, str]], accuracy: int = ACCURACY
) -> DataFrame:
    """The same as a row for each key and target (``_wf_t``, ``_wf_r``)."""
    keyed = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    by = list(keys) or [ALL]
    if not keys:
        keyed = keyed.withColumn(ALL, F.lit(1))
    keyed = keyed.select(*by, F.col(value).cast("double").alias("_wf_x"))
    slack = 4.0 / accuracy
    cuts = [(max(q - slack, 0.0), min(q + slack, 1.0)) for q, _ in targets.values()]
    sketch = keyed.groupBy(*by).agg(
        F.count("_wf_x").alias("_wf_n"),
        F.min("_wf_x").alias("_wf_min"),
        F.max("_wf_x").alias("_wf_max"),
        F.percentile_approx("_wf_x", [c for lo_hi in cuts for c in lo_hi], accuracy).alias("_wf_cut"),
    )
    n = F.col("_wf_n")
    small = n <= accuracy  # few enough rows to rank all of them
    # One expression over a list of targets: a hundred written out do not fit into a generated method.
    wanted = [
        F.struct(F.lit(name).alias("t"), F.lit(float(q)).alias("q"), F.lit(how == "linear").alias("linear"), F.lit(2 * i + 1).alias("i"),
                 F.lit(cuts[i][0] <= 0.0).alias("low"), F.lit(cuts[i][1] >= 1.0).alias("high"))
        for i, (name, (q, how)) in enumerate(targets.items())
    ]

    def bracket_of(w: Column) -> Column:
        at = F.when(w["linear"], (n - 1) * w["q"]).otherwise(F.least(F.floor(n * w["q"]), n - 1).cast("double"))
        return F.struct(
            w["t"].alias("t"),
            F.when(small | w["low"], F.col("_wf_min")).otherwise(F.element_at("_wf_cut", w["i"])).alias("lo"),
            F.when(small | w["high"], F.col("_wf_max")).otherwise(F.element_at("_wf_cut", w["i"] + 1)).alias("hi"),
            F.floor(at).alias("k"),
            (at - F.floor(at)).alias("f"),
        )

    plan = F.transform(F.array(*wanted), bracket_of)
    bracket = sketch.select(*by, plan.alias("_wf_plan"))
    if not keys:
        bracket = F.broadcast(bracket)  # one row
    joined = keyed.join(bracket, by).select(*by, "_wf_x", F.explode("_wf_plan").alias("_wf_p"))
    p = F.col("_wf_p")
    inside = (F.col("_wf_x") >= p["lo"]) & (F.col("_wf_x") <= p["hi"])
    tally = (
        joined.filter(F.col("_wf_x") <= p["hi"])
        .groupBy(
            *by,
            p["t"].alias("_wf_t"),
            F.when(inside, F.col("_wf_x")).alias("_wf_v"),
            p["k"].alias("_wf_k"),
            p["f"].alias("_wf_f"),
        )
        .agg(F.count(F.lit(1)).alias("_wf_c"))
    )
    w = Window.partitionBy(*by, "_wf_t").orderBy(F.col("_wf_v").asc_nulls_first())
    cum = tally.withColumn("_wf_hi", F.sum("_wf_c").over(w))
    lo, hi, k = F.col("_wf_hi") - F.col("_wf_c"), F.col("_wf_hi"), F.col("_wf_k")
    here, after = (lo <= k) & (k < hi), (lo <= k + 1) & (k + 1 < hi)
    picked = cum.groupBy(*by, "_wf_t").agg(
        F.max(F.when(here, F.col("_wf_v"))).alias("_wf_a"),
        F.max(F.when(after, F.col("_wf_v"))).alias("_wf_b"),
        F.first("_wf_f").alias("_wf_f"),
    )
    at, nxt, part = F.col("_wf_a"), F.col("_wf_b"), F.col("_wf_f")
    missed = at.isNull() | ((part > 0) & nxt.isNull())  # the sketch's error bound rules it out
    value_at = (
        F.when(missed, F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
        .when(part == 0, at)
        .otherwise(at + (nxt - at) * part)
    )
    return picked.select(*by, "_wf_t", value_at.alias("_wf_r"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles, ``{output name: q}``."""
    return order_statistics(df, keys, value, {n: (q, "linear") for n, q in qs.items()})


def quantile_values(df: DataFrame, value: str, qs: Sequence[float]) -> list[float]:
    """Quantiles of all values on the driver, for a list of them too long to be columns; none without values."""
    found = _by_target(df, [], value, {f"{i}": (q, "linear") for i, q in enumerate(qs)}).select("_wf_t", "_wf_r").collect()
    return [r["_wf_r"] for r in sorted(found, key=lambda r: int(r["_wf_t"]))]


def median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5})


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-key statistics back to rows (a single row when there is no key)."""
    if keys:
        return df.join(stats, list(keys), how)
    one = F.broadcast(stats.withColumn(ALL, F.lit(1)))
    return df.withColumn(ALL, F.lit(1)).join(one, ALL).drop(ALL)


def descending_rank(
    df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[Column], name: str = "rank",
    spread: Column | None = None,
) -> DataFrame:
    """Exact 1-based rank by descending score, ties in ``tie`` order.

    Rows are dealt by sampled ranges of (key, score, tie) and sorted inside
    them. The tie is part of the range, so neither a key with most of the rows
    nor a score that most of them share makes a large task. Only a row per key
    and range is then summed up.
    """
    by = list(keys) or [ALL]
    base = (df if keys else df.withColumn(ALL, F.lit(1))).filter(F.col(score).isNotNull())
    order = [*by, F.col(score).desc(), *([] if spread is None else [spread]), *tie]
    ranges = base.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranges.withColumn("_wf_at", F.monotonically_increasing_id())).withColumn("_wf_part", F.shiftright("_wf_at", 33))
    sizes = placed.groupBy(*by, "_wf_part").agg(F.min("_wf_at").alias("_wf_first"), F.count(F.lit(1)).alias("_wf_size"))
    before = F.sum("_wf_size").over(Window.partitionBy(*by).orderBy("_wf_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select(*by, "_wf_part", (F.coalesce(before, F.lit(0)) - F.col("_wf_first") + 1).alias("_wf_shift"))
    out = placed.join(shift, [*by, "_wf_part"]).withColumn(name, F.col("_wf_at") + F.col("_wf_shift"))
    out = out.drop("_wf_at", "_wf_part", "_wf_shift")
    return out if keys else out.drop(ALL)

