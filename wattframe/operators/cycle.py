"""One training cycle: from telemetry to a published version and a metrics row."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.operators import events as ev
from wattframe.operators import features as ft
from wattframe.operators import grid, ml
from wattframe.plans.folds import checkpoint
from wattframe.series import Series
from wattframe.sources import registry, writers


def gate_window(xy: DataFrame, series: Series, train_s: float, eval_s: float, min_train: int, min_pos: int) -> ml.Window4 | None:
    """Newest train range with enough rows and spikes whose two evaluation
    ranges hold a spike (M14); all candidates are counted in one pass."""
    folds = ml.sliding_folds(xy, series.ts, train_s, 2 * eval_s, 0.0)
    if not folds:
        return None
    ts, hit = F.col(series.ts), F.col("label") > 0
    counts = []
    for i, f in enumerate(folds):
        train = (ts >= F.lit(f.train_start)) & (ts < F.lit(f.train_end))
        test = (ts >= F.lit(f.test_start)) & (ts < F.lit(f.test_end))
        counts += [F.count_if(train).alias(f"n{i}"), F.count_if(train & hit).alias(f"p{i}"), F.count_if(test & hit).alias(f"t{i}")]
    row = xy.agg(*counts).first()
    good = [f for i, f in enumerate(folds) if row[f"n{i}"] >= min_train and row[f"p{i}"] >= min_pos and row[f"t{i}"] > 0]
    return good[-1] if good else None


def training_cycle(
    spark: SparkSession, telemetry: DataFrame, series: Series, root: str, version: str, learner: ml.Learner,
    *, zone: str | None = None, power: str = "power_watts", upstream: bool = True, horizon: int = 5, watts: float = 60.0,
    train_s: float = 6 * 3600.0, eval_s: float = 2 * 3600.0, block_s: float = 3600.0, horizon_s: float = 5.0,
    min_train: int = 500, min_pos: int = ml.MIN_TRAIN_POS, directions: Sequence[str] = ("rise", "drop"),
) -> dict:
    """Load, filter, choose a gate window, fit, score, promote, publish and log.

    The challenger learns with the champion's mistakes weighted up; its rise
    and drop heads learn from everything before the gate.  It takes the
    champion's place in the registry under ``root`` if the promotion rule says
    so.  Every cycle appends one row to ``root/metrics``, which is returned; a
    cycle without a viable window says so and changes nothing.
    """
    champion, champion_version = registry.load_latest(spark, root)
    rows = telemetry if zone is None else grid.business_hours(telemetry, series.ts, zone)
    xy, names = ft.build_xy(rows, series, horizon=horizon, upstream=upstream)
    xy = checkpoint(xy)
    window = gate_window(xy, series, train_s, eval_s, min_train, min_pos)
    out = {"version": version, "champion": champion_version, "rows": xy.count(), "promoted": False, "status": "no viable window"}
    if window is not None:
        train, test = ml.train_rows(xy, series.ts, window), ml.test_rows(xy, series.ts, window)
        onsets = checkpoint(ev.true_transitions(rows, series, power, "rise", watts))
        challenger = ml.train_detector(
            ml.hard_example_weights(train, champion), series, names, learner, events=onsets, block_s=block_s,
            lead_s=horizon_s, lag_s=horizon_s, min_pos=min_pos,
        )
        before = rows.filter(F.col(series.ts) < F.lit(window.test_start))
        heads = {d: checkpoint(ft.build_xy(before, series, horizon=horizon, upstream=upstream, direction=d)[0]) for d in directions}
        challenger = ml.attach_direction_heads(challenger, heads, series, learner, block_s=block_s)
        score = lambda d: None if d is None else ml.score_fold(d, test, series, onsets, horizon_s)
        new, old = score(challenger), score(champion)
        promoted = ml.beats(new, old)
        if promoted:
            registry.publish(spark, challenger, root, version)
        n_train, n_pos = (int(x) for x in train.agg(F.count(F.lit(1)), F.sum("label")).first())
        out |= {
            "status": "promoted" if promoted else "kept", "promoted": promoted, "train_rows": n_train, "train_positives": n_pos,
            "eval_start": str(window.test_start), "eval_end": str(window.test_start + timedelta(seconds=2 * eval_s)),
            **{f"{k}_head": h["status"] for k, h in challenger.heads.items()},
            **{k: float(v) for k, v in (new or {}).items() if v is not None},
            **{f"champion_{k}": float(v) for k, v in (old or {}).items() if v is not None},
        }
    ddl = ", ".join(f"`{k}` {'BOOLEAN' if isinstance(v, bool) else 'LONG' if isinstance(v, int) else 'DOUBLE' if isinstance(v, float) else 'STRING'}" for k, v in out.items())
    writers.append_metrics(spark.createDataFrame([tuple(out.values())], ddl), f"{root}/metrics")
    return out
