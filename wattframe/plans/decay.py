"""Exponentially decaying sums as a blocked scan.

``s_t = exp(-(u_t - u_{t-1}) / tau) * s_{t-1} + v_t`` covers EWMA statistics,
self-exciting intensities and one-pole low-pass filters.  Positions are cut into
blocks 64 time constants long; inside a block the sum is a plain running sum of
``v * exp((u - start) / tau)``.  A block carries in what the last block with
values ends with; what came two blocks before that is scaled by less than
exp(-128), far below one unit in the last place.

A gap may be longer than any number fits: its decay is stopped after ``GAP``
blocks, or earlier for time constants that differ much.  What is carried is
then still far below one unit in the last place of any new value, while ratios
of sums (a weighted mean) keep their value however long nothing comes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.series import Series

FOLDS = 64.0  # e-folds per block
GAP = 4
BLOCK = "_wf_decay_block"


@dataclass(frozen=True)
class Decay:
    value: Column
    tau: float


def decayed_sums(df: DataFrame, series: Series, at: Column | None = None, **specs: Decay) -> DataFrame:
    """Add one decayed running sum per spec; ``at`` is the position in units of
    ``tau`` (default: seconds of the series' time column)."""
    slowest = max(sp.tau for sp in specs.values())
    if FOLDS * slowest / min(sp.tau for sp in specs.values()) > 600:
        raise ValueError("time constants too far apart for one pass")
    width = FOLDS * slowest
    if at is None:  # subtract in exact position units before going to double
        scale = series.scale(df)
        unit = int(round(width * scale)) if scale > 1 else width
        block = F.floor(series.position(df) / F.lit(unit)).cast("long")
        offset = (series.position(df) - block * F.lit(unit)).cast("double") / scale
    else:
        block = F.floor(at / F.lit(width)).cast("long")
        offset = (at - block * F.lit(width)).cast("double")
    placed = df.withColumns({"_wf_u": offset, BLOCK: block})
    scaled = {
        f"_wf_s_{n}": F.coalesce(sp.value, F.lit(0.0)) * F.exp(F.col("_wf_u") / sp.tau)
        for n, sp in specs.items()
    }
    placed = placed.withColumns(scaled).repartition(*series.keys(), F.col(BLOCK))
    blocks = Window.partitionBy(*series.key).orderBy(BLOCK)
    valued = F.lit(False)
    for sp in specs.values():
        valued = valued | F.coalesce(sp.value.cast("double") != 0.0, F.lit(False))
    ended = placed.withColumn("_wf_valued", valued).groupBy(*series.key, BLOCK).agg(
        F.max("_wf_valued").alias("_wf_valued"), *[F.sum(c).alias(c) for c in scaled]
    )
    at_end = {
        n: F.col(f"_wf_s_{n}")
        + sum(
            F.coalesce(F.sum(f"_wf_s_{n}").over(blocks.rangeBetween(-k, -k)), F.lit(0.0)) * F.exp(F.lit(-k * width / sp.tau))
            for k in (1, 2)
        )
        for n, sp in specs.items()
    }
    ended = ended.select(*series.key, BLOCK, "_wf_valued", *[c.alias(f"_wf_t_{n}") for n, c in at_end.items()])
    last = F.last(F.when(F.col("_wf_valued"), F.struct(BLOCK, *[f"_wf_t_{n}" for n in specs])), ignorenulls=True)
    ended = ended.withColumn("_wf_last", last.over(blocks.rowsBetween(Window.unboundedPreceding, -1)))
    steepest = width / min(sp.tau for sp in specs.values())
    most = max(1, min(GAP, int(690 / steepest)))
    gone = F.least(F.col(BLOCK) - F.col(f"_wf_last.{BLOCK}"), F.lit(most)).cast("double")
    carried = ended.select(
        *series.key,
        BLOCK,
        *[
            F.coalesce(F.col(f"_wf_last._wf_t_{n}") * F.exp(gone * F.lit(-width / sp.tau)), F.lit(0.0)).alias(f"_wf_k_{n}")
            for n, sp in specs.items()
        ],
    )
    upto = (
        Window.partitionBy(*series.key, BLOCK)
        .orderBy(*series.order())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = placed.join(carried, [*series.key, BLOCK]).withColumns(
        {
            n: (F.sum(f"_wf_s_{n}").over(upto) + F.col(f"_wf_k_{n}"))
            * F.exp(-F.col("_wf_u") / sp.tau)
            for n, sp in specs.items()
        }
    )
    return out.drop("_wf_u", BLOCK, *scaled, *[f"_wf_k_{n}" for n in specs])
