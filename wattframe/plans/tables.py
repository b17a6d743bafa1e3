"""Intermediate rows in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

ADAPTIVE = "spark.sql.adaptive.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, a folder that driver and executors share.

    Where it is unset, a temporary folder serves in local mode; on a cluster
    that would be another disk for each executor, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.wattframe.scratch", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="wattframe-checkpoint-")
        spark.conf.set("spark.wattframe.scratch", named)
    return named


def _cut(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` that keeps how its rows are distributed and sorted.

    Adaptive plans do not tell their partitioning, so they are off while this
    plan is made. The files go when the DataFrame does, if the session cleans
    checkpoints (:func:`wattframe.plans.session.session` says so).
    """
    spark = df.sparkSession
    adaptive = spark.conf.get(ADAPTIVE)
    spark.conf.set(ADAPTIVE, "false")
    try:
        return cut(df)
    finally:
        spark.conf.set(ADAPTIVE, adaptive)


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, for a plan that uses them more than once."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows dealt by the keys and sorted by keys and order, once; later windows and groups by the keys need neither."""
    return _cut(df.repartition(*keys).sortWithinPartitions(*keys, *order))


def recut(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The same for rows that are already dealt by the keys: no exchange."""
    return _cut(df.sortWithinPartitions(*keys, *order))
