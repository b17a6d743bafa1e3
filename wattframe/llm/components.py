"""Connected components of a graph of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import keep


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every node's chosen neighbours are linked to its smallest neighbour (or itself)."""
    both = edges.select("u", "v") if not large else edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        # Here v < u always; the node itself goes to its smallest neighbour, too.
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node`` and its component's smallest node as ``label``, for every node of an edge (u, v).

    Loops, repeated and reversed edges change nothing; no edges give no rows;
    edges with a null end are left out. Each round is written to the shared
    folder, and only a count and a checksum reach the driver. A hub is reduced
    to one row per task before the shuffle.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    for _ in range(rounds):
        now = keep(_stars(_stars(now, large=True), large=False))
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
