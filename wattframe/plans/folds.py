"""Data-dependent sequential state over series."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.plans.tables import checkpoint_dir, placed
from wattframe.plans.timeline import BUCKET
from wattframe.series import Series


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows to the cluster's shared checkpoint folder and
    read them back.  The table survives lost executors and is column-pruned by
    later reads."""
    path = f"{checkpoint_dir(df.sparkSession)}/wattframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark jobs of a driver loop that run at once.
AT_ONCE = 4


def at_once(jobs: Sequence[Callable]) -> list:
    """Results of jobs that do not depend on each other, a few running at once, so that small ones share the executors.

    No job may scan a :class:`~wattframe.plans.timeline.Timeline`, which sets an option of the session meanwhile.
    """
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(job)) for job in jobs]]


GroupFn = Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]


def map_groups(
    df: DataFrame, by: Sequence[str], order: Sequence[str], fn: GroupFn, schema: T.StructType
) -> DataFrame:
    """Run ``fn`` over whole groups of an already ``by``-distributed DataFrame.

    Rows arrive sorted by ``by`` then ``order``; ``fn(rows, starts)`` gets many
    complete groups per call with their start offsets, so small groups do not
    pay one pandas call each.  Memory holds one Arrow batch plus one group.
    """
    cols = list(by)

    def starts_of(pdf: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(pdf), dtype=bool)
        change[0] = True
        for c in cols:
            v = pdf[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            cut = int(starts_of(pdf)[-1])
            same = held and all(held[-1][c].iloc[-1] == pdf[c].iloc[0] for c in cols)
            if same and cut == 0:
                held.append(pdf)
                continue
            ready = pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            if len(ready):
                yield fn(ready, starts_of(ready))
            held = [pdf.iloc[cut:]]
        if held:
            ready = pd.concat(held, ignore_index=True)
            yield fn(ready, starts_of(ready))

    return df.sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def spans(starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    return zip(starts.tolist(), [*starts[1:].tolist(), n])


def _hops(pos: np.ndarray, gap: float, side: str) -> np.ndarray:
    """Index of the next accepted candidate after accepting each one."""
    return np.maximum(np.searchsorted(pos, pos + gap, side=side), np.arange(len(pos)) + 1)


def _last_from(nxt: np.ndarray) -> np.ndarray:
    """Last accepted index when the greedy choice starts at each index."""
    n = len(nxt)
    last, jump = np.arange(n), nxt.copy()
    while (live := np.flatnonzero(jump < n)).size:
        last[live] = last[jump[live]]
        jump[live] = jump[jump[live]]
    return last


def refractory(
    candidates: DataFrame, series: Series, gap: float, inclusive: bool = False
) -> DataFrame:
    """Greedy thinning: keep a candidate when it lies more than ``gap`` after the
    last kept one (``inclusive``: at least ``gap``).

    Buckets are solved independently.  A bucket only needs the last kept
    position before it, and that can only change which of its first few
    candidates is kept first, so each bucket publishes a small table
    "first kept -> last kept"; the tables are chained per key and every bucket
    is then thinned from its known entry state.
    """
    side = "left" if inclusive else "right"
    scale = series.scale(candidates)
    reach = gap * scale
    width = series.width * scale
    keys = list(series.key)
    pos = series.position(candidates).cast("double")
    dealt = placed(
        candidates.withColumns({"_wf_x": pos, BUCKET: F.floor(pos / F.lit(width)).cast("long")}), [*keys, BUCKET], ["_wf_x"]
    )

    def publish(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        xs, buckets = pdf["_wf_x"].to_numpy(), pdf[BUCKET].to_numpy()
        firsts, lasts = [], []
        for a, b in spans(starts, len(pdf)):
            x = xs[a:b]
            zone = buckets[a] * width + reach
            entry = min(int(np.searchsorted(x, zone, side="right")) + 1, len(x))
            firsts.append(x[:entry].tolist())
            lasts.append(x[_last_from(_hops(x, reach, side))[:entry]].tolist())
        out = pdf.iloc[starts][[*keys, BUCKET]].reset_index(drop=True)
        return out.assign(firsts=firsts, lasts=lasts)

    def chain(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        entry, heads = [], set(starts.tolist())
        state = -np.inf
        for i, (firsts, lasts) in enumerate(zip(pdf["firsts"], pdf["lasts"])):
            if i in heads:
                state = -np.inf
            entry.append(state)
            at = int(np.searchsorted(firsts, state + reach, side=side))
            if at < len(firsts):
                state = lasts[at]
        return pdf[[*keys, BUCKET]].assign(_wf_entry=entry)

    def thin(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        xs, entry = pdf["_wf_x"].to_numpy(), pdf["_wf_entry"].to_numpy()
        keep = np.zeros(len(xs), dtype=bool)
        for a, b in spans(starts, len(pdf)):
            x = xs[a:b]
            nxt = _hops(x, reach, side)
            i = int(np.searchsorted(x, entry[a] + reach, side=side))
            while i < b - a:
                keep[a + i] = True
                i = int(nxt[i])
        return pdf.loc[keep, out_cols]

    out_cols = candidates.columns
    place = [*keys, BUCKET]
    place_fields = [dealt.schema[c] for c in place]
    doubles = T.ArrayType(T.DoubleType())
    tables = map_groups(
        dealt.select(*place, "_wf_x"),
        place,
        ["_wf_x"],
        publish,
        T.StructType(
            [*place_fields, T.StructField("firsts", doubles), T.StructField("lasts", doubles)]
        ),
    )
    entries = map_groups(
        tables.repartition(*keys),
        keys,
        [BUCKET],
        chain,
        T.StructType([*place_fields, T.StructField("_wf_entry", T.DoubleType())]),
    )
    return map_groups(dealt.join(entries, place), place, ["_wf_x"], thin, candidates.schema)


Step = Callable[[list[float] | None, pd.DataFrame], tuple[pd.DataFrame, list[float]]]


def fold(
    df: DataFrame,
    series: Series,
    step: Step,
    out_schema: T.StructType,
    slice_width: float | None = None,
) -> DataFrame:
    """Order-dependent recursion that has no parallel form inside one series.

    ``step(state, rows) -> (output rows, state)`` sees the rows of one series in
    time order.  The time axis is cut into slices that are run one after the
    other over all series at once: a task then holds one series' slice, and the
    state between slices is a reliable checkpoint, so a lost executor repeats
    one slice at most.  Without ``slice_width`` there is a single slice.
    """
    keys = list(series.key)
    order = [series.ts, *series.tie]
    out_cols = out_schema.fieldNames()
    nullable = [T.StructField(f.name, f.dataType) for f in out_schema.fields]
    whole = T.StructType([*nullable, T.StructField("_wf_state", T.ArrayType(T.DoubleType()))])

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """One carried-state row (when present) sorts first in each group."""
        pieces, tails = [], []
        for a, b in spans(starts, len(pdf)):
            state = None
            if pdf["_wf_in"].iloc[a] is not None:
                state, a = list(pdf["_wf_in"].iloc[a]), a + 1
            key = [pdf[k].iloc[b - 1] for k in keys]
            if b > a:
                rows, state = step(state, pdf.iloc[a:b].reset_index(drop=True))
                pieces.append(rows[out_cols])
            tails.append([*key, list(map(float, state))])
        ends = pd.DataFrame(tails, columns=[*keys, "_wf_state"])
        out = pd.concat([*pieces, ends], ignore_index=True) if pieces else ends
        for c in out_cols:
            if c not in out.columns:  # only carried states in this batch
                out[c] = pd.Series([None] * len(out), dtype=object)
        out = out[[*out_cols, "_wf_state"]]
        out["_wf_state"] = [v if isinstance(v, list) else None for v in out["_wf_state"]]
        return out

    carried = T.ArrayType(T.DoubleType())
    if slice_width is None:
        ready = df.withColumn("_wf_in", F.lit(None).cast(carried)).repartition(*keys)
        done = map_groups(ready, keys, order, run, whole)
        return done.filter(F.col("_wf_state").isNull()).drop("_wf_state")

    # The rows are read once and written by slice; a slice is then one folder.
    width = slice_width * series.scale(df)
    path = f"{checkpoint_dir(df.sparkSession)}/wattframe-{uuid.uuid4().hex}"
    sliced = df.withColumn("_wf_slice", F.floor(series.position(df) / F.lit(width)).cast("long")).filter("_wf_slice IS NOT NULL")
    sliced.repartition("_wf_slice", *keys).write.partitionBy("_wf_slice").parquet(path)
    stored = df.sparkSession.read.schema(sliced.schema).parquet(path)
    slices = sorted(r[0] for r in stored.select("_wf_slice").distinct().collect())
    outputs: list[DataFrame] = []
    states: DataFrame | None = None
    for at in slices:
        part = stored.filter(F.col("_wf_slice") == at).drop("_wf_slice")
        part = part.withColumns({"_wf_in": F.lit(None).cast(carried), "_wf_go": F.lit(1)})
        if states is not None:
            part = states.withColumn("_wf_go", F.lit(0)).unionByName(part, allowMissingColumns=True)
        done = checkpoint(
            map_groups(part.repartition(*keys), keys, ["_wf_go", *order], run, whole)
        )
        outputs.append(done.filter(F.col("_wf_state").isNull()).drop("_wf_state"))
        states = done.filter(F.col("_wf_state").isNotNull()).select(
            *keys, F.col("_wf_state").alias("_wf_in")
        )
    if not outputs:
        return df.sparkSession.createDataFrame([], out_schema)
    result = outputs[0]
    for nxt in outputs[1:]:
        result = result.unionByName(nxt)
    return result
