"""Fleet behaviour: power CDF vectors, their surface and their clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattframe.plans.folds import at_once
from wattframe.plans.quantiles import attach, quantiles


def normalise(df: DataFrame, keys: Sequence[str], value: str, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Scale to the key's own 2-98 % range, clipped; flat keys dropped."""
    q = quantiles(df, keys, value, {"_lo": lo, "_hi": hi}).filter(F.col("_hi") - F.col("_lo") >= 1e-9)
    rows = attach(df, q, keys, "inner")
    scaled = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return rows.withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).drop("_lo", "_hi")


def normalise_ticks(df: DataFrame, keys: Sequence[str], tick: str, value: str, ticks: int, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """:func:`normalise` for traces resampled to a fixed number of ticks.

    A trace is then one row of bounded size, so its quantiles, scaling and ticks
    need one aggregate; rows stay dealt by trace.
    """
    one = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(tick, F.col(value).cast("double").alias("v")))).alias("_wf_t"))
    whole = F.assert_true(F.size("_wf_t") == ticks, F.lit(f"a trace does not have {ticks} ticks"))
    values = F.array_sort(F.transform("_wf_t", lambda x: x["v"]))

    def at(q: float):
        k, part = divmod((ticks - 1) * q, 1.0)
        low, high = F.get("_wf_v", F.lit(int(k))), F.get("_wf_v", F.lit(min(int(k) + 1, ticks - 1)))
        return low + (high - low) * part

    ranged = one.filter(whole.isNull()).withColumn("_wf_v", values).withColumns({"_wf_lo": at(lo), "_wf_hi": at(hi)})
    ranged = ranged.filter(F.col("_wf_hi") - F.col("_wf_lo") >= 1e-9)
    scaled = (F.col("_wf_x.v") - F.col("_wf_lo")) / (F.col("_wf_hi") - F.col("_wf_lo"))
    rows = ranged.select(*keys, "_wf_lo", "_wf_hi", F.explode("_wf_t").alias("_wf_x"))
    return rows.select(*keys, F.col(f"_wf_x.{tick}").alias(tick), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)).alias(value))


def thresholds(n: int, lo: float = 0.02, hi: float = 1.0) -> list[float]:
    return [float(x) for x in np.linspace(lo, hi, n)]


def frame_ends(ticks: int, frames: int) -> list[int]:
    """Last tick (0-based) of each frame."""
    return [int(x) - 1 for x in np.linspace(ticks / frames, ticks, frames).astype(int)]


def cdf_vectors(
    df: DataFrame, node: Sequence[str], tick: str, value: str, ticks: int, frames: int, levels: Sequence[float]
) -> DataFrame:
    """Per node and frame, the share of elapsed ticks at or under each level,
    as one array ``y`` (G42).

    Every node must have each of the ticks ``0 .. ticks - 1`` once (see
    ``resample_ticks``); another number of ticks fails the query.  Ticks are
    counted once per frame interval (map-side) and the few frames are summed
    up, so the row x level product is never materialised.
    """
    ends = frame_ends(ticks, frames)
    # first frame whose end is not before the tick
    frame = F.raise_error(F.concat(F.lit("tick outside the trace: "), F.col(tick).cast("string"))).cast("int")
    for f in reversed(range(frames)):
        frame = F.when(F.col(tick) <= ends[f], F.lit(f)).otherwise(frame)
    tagged = df.withColumn("frame", frame)
    counts = [F.count_if(F.col(value) <= lv).alias(f"_c{i}") for i, lv in enumerate(levels)]
    per = tagged.groupBy(*node, "frame").agg(*counts, F.count(F.lit(1)).alias("_n"))
    widths = F.element_at(F.array(*[F.lit(e - p) for p, e in zip([-1, *ends], ends, strict=False)]), F.col("frame") + 1)
    whole = F.assert_true(F.col("_n") == widths, F.lit(f"a trace does not have {ticks} ticks"))
    per = per.filter(whole.isNull()).drop("_n")
    dense = per
    if len(set(ends)) < frames:  # fewer ticks than frames: some frames end where another does
        nodes = per.select(*node).distinct()
        dense = nodes.withColumn("frame", F.explode(F.array(*[F.lit(f) for f in range(frames)])))
        dense = dense.join(per, [*node, "frame"], "left")
    w = Window.partitionBy(*node).orderBy("frame")
    elapsed = F.element_at(F.array(*[F.lit(float(e + 1)) for e in ends]), F.col("frame") + 1)
    y = F.array(
        *[F.coalesce(F.sum(f"_c{i}").over(w), F.lit(0)) / elapsed for i in range(len(levels))]
    )
    return dense.select(*node, "frame", y.alias("y"))


def cdf_rows(vectors: DataFrame, node: Sequence[str]) -> DataFrame:
    """CDF vectors as ``frame, node, thr_idx, y`` rows."""
    return vectors.select(*node, "frame", F.posexplode("y").alias("thr_idx", "y"))


def surface(rows: DataFrame, bins: int = 80) -> DataFrame:
    """Node count per frame, level and y-bin."""
    b = F.least(F.floor(F.col("y") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy("frame", "thr_idx", b.alias("bin")).agg(F.count(F.lit(1)).alias("nodes"))


def smooth(
    cells: DataFrame, axes: dict[str, tuple[int, float]], value: str = "nodes", cut: float = 4.0
) -> DataFrame:
    """Gaussian smoothing along each axis with mirrored edges.

    ``axes`` maps axis column -> (length, sigma).  Each non-empty cell pushes
    its weight to its neighbours, one axis after the other; the grid size is
    fixed by the axes, not by the data.
    """
    out = cells.withColumn(value, F.col(value).cast("double"))
    names = list(axes)
    for axis, (length, sigma) in axes.items():
        radius = int(cut * sigma + 0.5)
        if sigma <= 0 or radius == 0:
            continue
        offsets = np.arange(-radius, radius + 1)
        kernel = np.exp(-0.5 * (offsets / sigma) ** 2)
        kernel /= kernel.sum()
        taps = F.array(
            *[F.struct(F.lit(int(k)).alias("k"), F.lit(float(v)).alias("w")) for k, v in zip(offsets, kernel)]
        )
        pushed = out.withColumn("_wf_tap", F.explode(taps))
        # outputs that read this cell: direct, or through copies mirrored at the edges
        period = 2 * length
        reach = radius // period + 1
        src, k = F.col(axis), F.col("_wf_tap.k")
        images = [src - k + period * m for m in range(-reach, reach + 1)]
        images += [-src - 1 - k + period * m for m in range(-reach, reach + 1)]
        pushed = pushed.withColumn("_wf_to", F.explode(F.array(*images)))
        pushed = pushed.filter((F.col("_wf_to") >= 0) & (F.col("_wf_to") < length))
        rest = [n for n in names if n != axis]
        out = pushed.groupBy(*rest, F.col("_wf_to").alias(axis)).agg(
            F.sum(F.col(value) * F.col("_wf_tap.w")).alias(value)
        )
    return out


def cluster(vectors: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """k-means cluster of each node's vector ``y``."""
    data = vectors.withColumn("features", array_to_vector("y"))
    model = KMeans(k=k, seed=seed, maxIter=40).fit(data)
    return model.transform(data).withColumnRenamed("prediction", "cluster").drop("features")


def elbow(vectors: DataFrame, ks: Sequence[int] = range(2, 9), seed: int = 7) -> DataFrame:
    """Within-cluster squared error for each k."""
    data = vectors.select(array_to_vector("y").alias("features")).persist()
    data.count()  # computed once, before the fits share it
    fits = [lambda k=k: float(KMeans(k=k, seed=seed, maxIter=40).fit(data).summary.trainingCost) for k in ks]
    costs = [(int(k), cost) for k, cost in zip(ks, at_once(fits), strict=True)]
    data.unpersist()
    return vectors.sparkSession.createDataFrame(costs, "k INT, cost DOUBLE")


def confusion(assigned: DataFrame, cluster_col: str, label: str) -> DataFrame:
    """Cluster x class counts with each cluster's majority class."""
    table = assigned.groupBy(cluster_col, label).agg(F.count(F.lit(1)).alias("nodes"))
    w = Window.partitionBy(cluster_col).orderBy(F.col("nodes").desc(), label)
    return table.withColumn("majority", F.row_number().over(w) == 1)


def recovery(table: DataFrame) -> DataFrame:
    """Share of nodes that sit in their cluster's majority class."""
    return table.agg(
        (F.sum(F.when(F.col("majority"), F.col("nodes"))) / F.sum("nodes")).alias("accuracy"),
        F.sum("nodes").alias("nodes"),
    )
