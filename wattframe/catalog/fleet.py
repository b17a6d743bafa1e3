"""Queries over fleet CDF vectors and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe import bindings as b
from wattframe.catalog import query
from wattframe.catalog.features import RN_SQL, S
from wattframe.operators import fleet as fl
from wattframe.operators import grid as g
from wattframe.operators.events import argmax
from wattframe.plans.timeline import number_rows
from wattframe.series import Series

TICKS, FRAMES, BINS = 48, 6, 20
LEVELS = fl.thresholds(10)
ENDS = fl.frame_ends(TICKS, FRAMES)

# Each trace is resampled to TICKS points over its own span of rows, then scaled to its own range.
NODE_SQL = f"""{RN_SQL}, span AS (SELECT server, count(*) AS m FROM n GROUP BY 1 HAVING count(*) > 1),
  px AS (SELECT server, unnest(generate_series(0, {TICKS - 1})) AS tick, m FROM span), pt AS (SELECT server, tick, 1.0 + tick * ((m - 1) / {TICKS - 1}.0) AS x FROM px),
  rs AS (SELECT pt.server, pt.tick, a.power_watts + (x - floor(x)) * (coalesce(z.power_watts, a.power_watts) - a.power_watts) AS w FROM pt
    JOIN n a ON a.server = pt.server AND a.rn = floor(x) LEFT JOIN n z ON z.server = pt.server AND z.rn = floor(x) + 1),
  q AS (SELECT server, quantile_cont(w, 0.02) AS lo, quantile_cont(w, 0.98) AS hi FROM rs GROUP BY 1),
  nd AS (SELECT server, tick, greatest(0.0, least(1.0, (w - lo) / (hi - lo))) AS p FROM rs JOIN q USING (server) WHERE hi - lo >= 1e-9),
  fr AS (SELECT * FROM (VALUES {", ".join(f"({i}, {e})" for i, e in enumerate(ENDS))}) AS t(frame, fend)), lv AS (SELECT * FROM (VALUES {", ".join(f"({i}, {x!r})" for i, x in enumerate(LEVELS))}) AS t(thr_idx, lvl)),
  cdf AS (SELECT server, frame, thr_idx, count(*) FILTER (tick <= fend AND round(p, 9) <= lvl) / CAST(any_value(fend) + 1 AS DOUBLE) AS y FROM nd CROSS JOIN fr CROSS JOIN lv GROUP BY 1, 2, 3),
  surf AS (SELECT frame, thr_idx, CAST(least(floor(y * {BINS}), {BINS - 1}) AS INT) AS bin, count(*) AS nodes FROM cdf GROUP BY 1, 2, 3)"""


def nodes(spark, d):
    """Every server's whole trace at TICKS points, scaled to its own range."""
    traces = number_rows(b.samples(spark, d), b.SAMPLES, "rn").select("server", F.col("rn").cast("double").alias("t"), "power_watts")
    even = g.resample_ticks(traces, Series(("server",), "t", (), 100_000.0), "power_watts", TICKS)
    return fl.normalise_ticks(even, ["server"], "tick", "power_watts", TICKS).withColumn("power_watts", F.round("power_watts", 9))


def vectors(spark, d):
    return fl.cdf_vectors(nodes(spark, d), ["server"], "tick", "power_watts", TICKS, FRAMES, LEVELS)


@query(
    "g47_normalised_power", "server, event_id, ~p",
    f"""WITH {RN_SQL}, q AS (SELECT server, quantile_cont(power_watts, 0.02) AS lo, quantile_cont(power_watts, 0.98) AS hi FROM n GROUP BY 1)
    SELECT server, event_id, greatest(0.0, least(1.0, (power_watts - lo) / (hi - lo))) AS p FROM n JOIN q USING (server) WHERE hi - lo >= 1e-9""",
)
def g47(spark, d):
    return fl.normalise(b.samples(spark, d), ["server"], "power_watts").withColumn("p", F.col("power_watts"))


@query("g42_power_cdf", "server, frame, thr_idx, ~y", f"WITH {NODE_SQL} SELECT * FROM cdf")
def g42(spark, d):
    return fl.cdf_rows(vectors(spark, d), ["server"])


@query("g43_cdf_surface", "frame, thr_idx, bin, nodes", f"WITH {NODE_SQL} SELECT * FROM surf")
def g43(spark, d):
    return fl.surface(fl.cdf_rows(vectors(spark, d), ["server"]), BINS)


def kernel_sql(sigma: float) -> str:
    r = int(4 * sigma + 0.5)
    return f"(SELECT k, exp(-0.5 * (k / {sigma}) ** 2) / (SELECT sum(exp(-0.5 * (i / {sigma}) ** 2)) FROM range({-r}, {r + 1}) t(i)) AS w FROM range({-r}, {r + 1}) t(k))"


def pass_sql(src: str, axis: str, n: int, sigma: float, out: str) -> str:
    """One smoothing pass that reads mirrored source cells."""
    rest = [a for a in ("frame", "thr_idx", "bin") if a != axis]
    keep = ", ".join(f"s.{a}" for a in rest)
    m = f"(((o.i + kk.k) % {2 * n}) + {2 * n}) % {2 * n}"
    return f"""{out} AS (SELECT {keep}, o.i AS {axis}, sum(s.nodes * kk.w) AS nodes FROM range(0, {n}) o(i) CROSS JOIN {kernel_sql(sigma)} kk
      JOIN {src} s ON s.{axis} = CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 1} - {m} END GROUP BY {keep}, o.i)"""


@query(
    "g44_smoothed_surface", "frame, thr_idx, bin, ~nodes",
    f"""WITH {NODE_SQL}, {pass_sql('surf', 'frame', FRAMES, 1.0, 'p1')}, {pass_sql('p1', 'thr_idx', len(LEVELS), 0.8, 'p2')}, {pass_sql('p2', 'bin', BINS, 1.5, 'p3')} SELECT * FROM p3""",
)
def g44(spark, d):
    cells = fl.surface(fl.cdf_rows(vectors(spark, d), ["server"]), BINS)
    return fl.smooth(cells, {"frame": (FRAMES, 1.0), "thr_idx": (len(LEVELS), 0.8), "bin": (BINS, 1.5)})


def last_frame(spark, d):
    return vectors(spark, d).filter(F.col("frame") == FRAMES - 1)


@query("g45_kmeans_clusters", "server, cluster")
def g45(spark, d):
    return fl.cluster(last_frame(spark, d), 4)


@query("g45_elbow", "k, ~cost")
def g45b(spark, d):
    return fl.elbow(last_frame(spark, d))


@query(
    "g46_confusion_table", "cluster, label, nodes, majority",
    f"""WITH {S}, a AS (SELECT server, CAST(server % 4 AS BIGINT) AS cluster, arg_max(kind, power_watts) AS label FROM samples GROUP BY 1), c AS (SELECT cluster, label, count(*) AS nodes FROM a GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY nodes DESC, label) = 1 AS majority FROM c""",
)
def g46(spark, d):
    a = b.samples(spark, d).groupBy("server").agg(argmax("kind", "power_watts", "event_id").alias("label"))
    return fl.confusion(a.withColumn("cluster", F.col("server") % 4), "cluster", "label")


@query(
    "g46_recovery", "~accuracy, nodes",
    f"""WITH {S}, a AS (SELECT server, server % 4 AS cluster, arg_max(kind, power_watts) AS label FROM samples GROUP BY 1), c AS (SELECT cluster, label, count(*) AS nodes FROM a GROUP BY 1, 2),
    m AS (SELECT cluster, max(nodes) AS top, sum(nodes) AS n FROM c GROUP BY 1) SELECT sum(top) / sum(n) AS accuracy, sum(n) AS nodes FROM m""",
)
def g46b(spark, d):
    a = b.samples(spark, d).groupBy("server").agg(argmax("kind", "power_watts", "event_id").alias("label"))
    return fl.recovery(fl.confusion(a.withColumn("cluster", F.col("server") % 4), "cluster", "label"))
