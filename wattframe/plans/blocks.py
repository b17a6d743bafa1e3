"""Array work over blocks of a series: halo blocks, rolling order statistics and relayed recursions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.plans.folds import map_groups, spans
from wattframe.plans.tables import placed
from wattframe.plans.timeline import BLOCK, BUCKET, HOME, POS, row_blocks, time_blocks
from wattframe.series import Series


class Ranks:
    """Order statistics of any slice of an array in ``log`` steps (a wavelet matrix over value ranks).

    Values are replaced by their ranks; each level splits the array by one bit
    of the rank, zeros first, and keeps how many zeros stand before each place.
    All queries go down the levels together, as arrays.
    """

    def __init__(self, values: np.ndarray):
        self.values, rank = np.unique(values, return_inverse=True)
        self.levels: list[tuple[np.ndarray, int]] = []
        self.bits = max(1, int(len(self.values) - 1).bit_length())
        rank = rank.astype(np.int64)
        for bit in range(self.bits - 1, -1, -1):
            one = (rank >> bit) & 1
            before = np.concatenate([[0], np.cumsum(1 - one)])
            self.levels.append((before, int(before[-1])))
            rank = np.concatenate([rank[one == 0], rank[one == 1]])

    def kth(self, start: np.ndarray, stop: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest (from 0) of each slice ``start:stop``; NaN where the slice has no such element."""
        ok = (k >= 0) & (k < stop - start)
        lo, hi, k = np.where(ok, start, 0), np.where(ok, stop, 1), np.where(ok, k, 0)
        if not len(self.values):
            return np.full(len(ok), np.nan)
        found = np.zeros(len(k), np.int64)
        for depth, (before, zeros) in enumerate(self.levels):
            lo0, hi0 = before[lo], before[hi]
            right = k >= hi0 - lo0
            k = np.where(right, k - (hi0 - lo0), k)
            lo, hi = np.where(right, zeros + lo - lo0, lo0), np.where(right, zeros + hi - hi0, hi0)
            found |= right.astype(np.int64) << (self.bits - 1 - depth)
        return np.where(ok, self.values[np.minimum(found, len(self.values) - 1)], np.nan)

    def quantile(self, start: np.ndarray, stop: np.ndarray, q: float) -> np.ndarray:
        """Linear interpolation at ``(n - 1) q`` of each slice."""
        at = (stop - start - 1) * q
        low = np.floor(at).astype(np.int64)
        a, b = self.kth(start, stop, low), self.kth(start, stop, np.minimum(low + 1, stop - start - 1))
        return a + (b - a) * (at - low)


#: ``fn(rows, start, stop)``: values for rows ``start .. stop - 1`` of a block in order, given as arrays by column.
BlockFn = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def over_blocks(spread: DataFrame, series: Series, order: str, columns: Sequence[str], fn: BlockFn, out: dict[str, T.DataType]) -> DataFrame:
    """Add columns that ``fn`` makes of each block's rows, halo rows included; only home rows stay.

    ``spread`` comes from ``row_blocks`` or ``time_blocks``; rows reach ``fn`` in
    the order of ``order``. A task holds one block at a time.
    """
    by = [*series.key, BLOCK]
    carried = [f for f in spread.schema.fields if f.name not in (BLOCK, HOME)]
    schema = T.StructType([*carried, *[T.StructField(n, t) for n, t in out.items()]])
    names = [f.name for f in carried]

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        given = {c: pdf[c].to_numpy() for c in columns}
        made = [fn({c: v[a:b] for c, v in given.items()}) for a, b in spans(starts, len(pdf))]
        home = pdf[HOME].to_numpy(bool)
        return pdf[names][home].assign(**{n: np.concatenate([m[n] for m in made])[home] for n in out})

    return map_groups(spread.repartition(*by), by, [order], run, schema)


def rolling_rows(
    df: DataFrame, series: Series, rows: int, fn: BlockFn, columns: Sequence[str], out: dict[str, T.DataType], row_number: str = "rn"
) -> DataFrame:
    """:func:`over_blocks` with ``rows`` preceding rows at hand."""
    return over_blocks(row_blocks(df, series, before=rows, row_number=row_number), series, row_number, [row_number, *columns], fn, out)


def rolling_time(
    df: DataFrame, series: Series, seconds: float, fn: BlockFn, columns: Sequence[str], out: dict[str, T.DataType]
) -> DataFrame:
    """:func:`over_blocks` with the rows of the last ``seconds`` at hand; ``fn`` finds their positions as ``_wf_pos``."""
    return over_blocks(time_blocks(df, series, before=seconds), series, POS, [POS, *columns], fn, out).drop(POS)


# Recursions that are told from block to block

#: ``publish(rows, starts)``: what each block does to any state, as numbers.
Publish = Callable[[pd.DataFrame, np.ndarray], Sequence[Sequence[float]]]
#: ``follow(published, starts)``: the state before each block (None before the first), blocks of a series in order.
Follow = Callable[[Sequence[np.ndarray], np.ndarray], Sequence[Sequence[float] | None]]
#: ``apply(states, rows, starts)``: the output rows of all blocks, given the state before each.
Apply = Callable[[Sequence[Sequence[float] | None], pd.DataFrame, np.ndarray], pd.DataFrame]


def relay(df: DataFrame, series: Series, publish: Publish, follow: Follow, apply: Apply, out_schema: T.StructType) -> DataFrame:
    """A recursion along each series, run by all its time buckets at once.

    Every bucket publishes what it does to an unknown state before it. Those
    few numbers are followed from bucket to bucket per key, and each bucket then
    runs from the state it really starts with. Rows are exchanged once; the
    sequential part sees one row per bucket. Each step gets many buckets at
    once, so short ones need no call of their own.
    """
    keys, place = list(series.key), [*series.key, BUCKET]
    order = [series.ts, *series.tie]
    bucket = F.floor(series.position(df) / F.lit(series.width * series.scale(df))).cast("long")
    dealt = placed(df.withColumn(BUCKET, bucket), place, order)
    fields = [dealt.schema[c] for c in place]
    numbers = T.ArrayType(T.DoubleType())

    def told(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        return pdf.iloc[starts][place].reset_index(drop=True).assign(_wf_said=list(publish(pdf, starts)))

    def chained(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        return pdf[place].assign(_wf_entry=list(follow(pdf["_wf_said"].tolist(), starts)))

    def ran(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        return apply(pdf["_wf_entry"].iloc[starts].tolist(), pdf, starts)[out_schema.fieldNames()]

    said = map_groups(dealt, place, order, told, T.StructType([*fields, T.StructField("_wf_said", numbers)]))
    entries = map_groups(said.repartition(*keys), keys, [BUCKET], chained, T.StructType([*fields, T.StructField("_wf_entry", numbers)]))
    return map_groups(dealt.join(entries, place), place, order, ran, out_schema)


def lockstep(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups in falling order of size: their places in ``starts``, first rows, and how many have each next row."""
    sizes = np.diff(np.append(starts, n))
    order = np.argsort(-sizes, kind="stable")
    rows = np.arange(int(sizes.max(initial=0)))
    return order, starts[order], len(sizes) - np.searchsorted(np.sort(sizes), rows, side="right")
