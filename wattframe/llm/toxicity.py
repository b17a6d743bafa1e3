"""Toxicity: logistic regression learned by FTRL-proximal over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm.common import ODD, keep, mix64, word_hashes

BITS = 20
PUNCTUATION = b".,;:!?\"'()[]{}"
#: Labelled rows that are learned from at most (those first by a hash of their id), and rows per learner.
MOST_ROWS = 20_000
SHARD_ROWS = 5_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 8.0, 1.0
FOLDS = 5


def features(text: str | None) -> np.ndarray:
    """Coordinates of a text's words, word pairs and pairs with one or two words between; coordinate 0 is the bias."""
    w = word_hashes(text or "", PUNCTUATION)
    grams = [w * ODD[0]]
    for gap in (1, 2, 3):
        grams.append(w[:-gap] * ODD[2 * gap] + w[gap:] * ODD[2 * gap + 1])
    return (mix64(np.concatenate(grams)) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Per-coordinate rates and L1: a coordinate stays zero until its gradients add up to more than ``L1``."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights learned from ``labels`` (doc_id, label) of ``docs``: at most ``2**BITS`` numbers.

    A bounded sample is used: the ``MOST_ROWS`` labels first by a hash of their
    id, chosen before texts are joined. They are dealt to one learner per
    ``SHARD_ROWS`` and the learners' weights are averaged. Null labels and
    labels without a document are left out; without any, every weight is zero.
    """
    few = labels.where("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    few = keep(few.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(MOST_ROWS))
    shards = max(1, -(-few.count() // SHARD_ROWS))
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select(F.xxhash64("doc_id", "text").alias("k"), "text", "label")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((k, t or "", y) for b in batches for k, t, y in zip(*[b.column(c).to_pylist() for c in ("k", "text", "label")], strict=True))
        data = [(np.union1d(features(t), [0]), y) for _, t, y in got]
        model = Ftrl()
        for _ in range(EPOCHS):
            for at, y in data:
                model.learn(at, y)
        if data:
            w = model.weights(slice(None))
            at = np.flatnonzero(w)
            yield pa.record_batch([pa.array(at), pa.array(w[at])], ["at", "w"])

    learned = rows.repartition(shards, "k").mapInArrow(learn, "at long, w double")
    got = learned.groupBy("at").agg((F.sum("w") / shards).alias("w")).toArrow()
    return got.column("at").to_numpy(), got.column("w").to_numpy()


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row; a null text counts as empty and gets the bias alone.

    Whole texts are scored where they are scanned, without a shuffle. Ids, null
    or repeated, are passed through; an empty table gives no rows; other columns
    are not read. The weights sent out are at most ``2**BITS``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS)
        w[shared.value[0]] = shared.value[1]
        used = w != 0
        for b in batches:
            total = []
            for t in b.column("text").to_pylist():
                at = features(t)
                at = np.unique(at[used[at]])
                total.append(w[at].sum() + (w[0] if not len(at) or at[0] else 0.0))
            score = 1 / (1 + np.exp(-np.clip(np.array(total, float), -30, 30)))
            yield pa.record_batch([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(id: Column) -> Column:
    """Whether a row is kept from learning; a null id is not held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null").select("doc_id", F.col("toxic").alias("label"))
    out = scored(docs, fit(docs, labels.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
