"""Model directories with a registry table of versions."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wattframe.operators.ml import Detector

REGISTRY = "version STRING, created TIMESTAMP, path STRING, features ARRAY<STRING>, threshold DOUBLE, heads STRING, meta STRING"


def publish(spark: SparkSession, detector: Detector, root: str, version: str) -> None:
    """Write the model first, then its registry row, so readers never see half
    a model."""
    path = f"{root}/models/{version}"
    detector.model.write().overwrite().save(path)
    heads = {}
    for name, head in detector.heads.items():
        if head.get("status") == "trained":
            head["detector"].model.write().overwrite().save(f"{path}_{name}")
            heads[name] = head["detector"].threshold
    row = [(version, None, path, detector.features, detector.threshold, json.dumps(heads), json.dumps(detector.meta))]
    df = spark.createDataFrame(row, REGISTRY).withColumn("created", F.current_timestamp())
    df.write.mode("append").parquet(f"{root}/registry")


def load_latest(spark: SparkSession, root: str) -> tuple[Detector | None, str]:
    """Newest published model, or ``(None, "none")``."""
    try:
        row = spark.read.parquet(f"{root}/registry").orderBy(F.col("created").desc()).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # anything but: no registry yet
            raise
        row = None
    if row is None:
        return None, "none"
    heads = {
        name: {"status": "trained", "detector": Detector(PipelineModel.load(f"{row['path']}_{name}"), row["features"], thr)}
        for name, thr in json.loads(row["heads"]).items()
    }
    model = PipelineModel.load(row["path"])
    return Detector(model, list(row["features"]), row["threshold"], json.loads(row["meta"]), heads), row["version"]
