"""Windows over series that never need a whole series in one task.

Three shapes cover the operators:

* :class:`Timeline` - running state (sum, max, last seen value ...).  Rows are
  hash-distributed and sorted once on ``(key, time bucket)`` and cut from their
  lineage there.  Each bucket is reduced to one summary row, the summaries are
  scanned per key (as many rows as there are buckets, not samples) and the carry
  is joined back on the same distribution, without another exchange or sort.
* :func:`by_rows` - windows that reach a bounded number of rows back or ahead.
  Rows are numbered with a Timeline, cut into equal blocks, and the few rows
  next to a block edge are copied to the neighbour block.
* :func:`by_time` - windows bounded in time; edge rows are copied to the
  neighbour bucket, no numbering needed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wattframe.plans.tables import placed, recut
from wattframe.series import Series

BUCKET = "_wf_bucket"
POS = "_wf_pos"
RN = "_wf_rn"
BLOCK = "_wf_block"
HOME = "_wf_home"

BLOCK_ROWS = 200_000

Stage = Callable[[WindowSpec], dict[str, Column]]


@dataclass(frozen=True)
class Running:
    """One running quantity: ``kind`` in sum, max, min, last, before, first,
    lag, lead, or all_max, all_min over the whole series."""

    kind: str
    value: Column


def running_sum(value: Column) -> Running:
    return Running("sum", value)


def running_count() -> Running:
    return Running("sum", F.lit(1).cast("long"))


def running_max(value: Column) -> Running:
    return Running("max", value)


def running_min(value: Column) -> Running:
    return Running("min", value)


def last_seen(value: Column) -> Running:
    """Latest non-null value up to and including the row."""
    return Running("last", value)


def last_before(value: Column) -> Running:
    """Latest non-null value strictly before the row."""
    return Running("before", value)


def first_seen(value: Column) -> Running:
    """Earliest non-null value up to and including the row."""
    return Running("first", value)


def previous(value: Column) -> Running:
    """Value of the preceding row, null on the first row of a series."""
    return Running("lag", value)


def following(value: Column) -> Running:
    """Value of the next row, null on the last row of a series."""
    return Running("lead", value)


def series_max(value: Column) -> Running:
    """Largest value of the whole series, on each of its rows."""
    return Running("all_max", value)


def series_min(value: Column) -> Running:
    """Smallest value of the whole series, on each of its rows."""
    return Running("all_min", value)


class Timeline:
    """A DataFrame distributed on (series key, time bucket), ready for scans.

    The rows are exchanged and sorted once and cut from their lineage
    (:func:`~wattframe.plans.tables.placed`); every later step of a scan works on
    that distribution, so the source is read once however many scans follow.
    A scan of preceding rows (``previous``) and the scan after it are one pass:
    only the first row of a bucket depends on another bucket in the first scan,
    so the bucket's summary keeps that row aside and its values are worked out
    once the row before it is known.
    """

    def __init__(self, df: DataFrame, series: Series):
        width = series.width * series.scale(df)
        bucket = F.floor(series.position(df) / F.lit(width)).cast("long")
        rows = placed(df.withColumn(BUCKET, bucket), [*series.key, BUCKET], [series.ts, *series.tie])
        self._set(rows, series, True, None, [])

    def _set(self, df, series, cut, waiting, after) -> Timeline:
        self.df, self.series = df, series
        self._cut, self._waiting, self._after = cut, waiting, after
        return self

    def _with(self, df: DataFrame, cut: bool, waiting=None, after=()) -> Timeline:
        return object.__new__(Timeline)._set(df, self.series, cut, waiting, list(after))

    def with_columns(self, cols: dict[str, Column]) -> Timeline:
        return self._then(lambda df: df.withColumns(cols))

    def drop(self, *cols: str) -> Timeline:
        return self._then(lambda df: df.drop(*cols))

    def _then(self, change: Callable[[DataFrame], DataFrame]) -> Timeline:
        if self._waiting is not None:
            return self._with(self.df, self._cut, self._waiting, [*self._after, change])
        return self._with(change(self.df), self._cut)

    def scan(self, reverse: bool = False, **specs: Running) -> Timeline:
        """Add one running column per spec (``reverse`` runs from the end)."""
        if self._waiting is not None:
            return self._with(_fused(self.df, self.series, self._waiting, self._after, specs, reverse), False)
        df = self.df if self._cut else recut(self.df, [*self.series.key, BUCKET], [self.series.ts, *self.series.tie])
        if not reverse and all(sp.kind == "lag" for sp in specs.values()):
            return self._with(df, True, specs)
        return self._with(_scanned(df, self.series, specs, reverse), False)

    def done(self) -> DataFrame:
        df = self.df
        if self._waiting is not None:
            df = _scanned(df, self.series, self._waiting, False)
            for change in self._after:
                df = change(df)
        return df.drop(BUCKET)


FOLDS = {"sum": F.sum, "max": F.max, "min": F.min, "all_max": F.max, "all_min": F.min}


class _Scan:
    """One scan's windows, summaries and carries for a bucket order and direction."""

    def __init__(self, series: Series, specs: dict[str, Running], reverse: bool, tag: str):
        self.specs, self.reverse, self.key = specs, reverse, list(series.key)
        self.place = [*series.key, BUCKET]
        order = [c.desc() for c in series.order()] if reverse else series.order()
        self.local = Window.partitionBy(*self.place).orderBy(*order)
        self.upto = self.local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.earlier = self.local.rowsBetween(Window.unboundedPreceding, -1)
        by_bucket = Window.partitionBy(*series.key).orderBy(F.col(BUCKET).desc() if reverse else F.col(BUCKET))
        self.before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
        self.whole = Window.partitionBy(*series.key)
        self.behind = by_bucket.rowsBetween(1, Window.unboundedFollowing)
        self.at = F.struct(*series.order())
        self.newest, self.oldest = (F.min_by, F.max_by) if reverse else (F.max_by, F.min_by)
        self.value = {n: F.col(f"_wf_v{tag}_{i}") for i, n in enumerate(specs)}
        self.tmp = {n: f"_wf_p{tag}_{i}" for i, n in enumerate(specs)}
        self.out = {n: f"_wf_c{tag}_{i}" for i, n in enumerate(specs)}

    def values(self) -> dict[str, Column]:
        return {f"_wf_v{t}": sp.value for t, sp in self._tagged()}

    def _tagged(self):
        return [(self.tmp[n].removeprefix("_wf_p"), sp) for n, sp in self.specs.items()]

    def partial(self, counted: Column | None = None) -> list[Column]:
        """Summary of a bucket's rows, or of those that are ``counted``."""
        yes = F.lit(True) if counted is None else counted
        out = []
        for n, sp in self.specs.items():
            v, tmp = self.value[n], self.tmp[n]
            if sp.kind in FOLDS:
                made = FOLDS[sp.kind](v if counted is None else F.when(yes, v))
            elif sp.kind in ("last", "before"):
                made = self.newest(v, F.when(yes & v.isNotNull(), self.at))
            elif sp.kind == "first":
                made = self.oldest(v, F.when(yes & v.isNotNull(), self.at))
            else:  # neighbours: boxed, so that a null value is still a value
                pick = self.newest if sp.kind == "lag" else self.oldest
                made = pick(F.struct(v.alias("v")), F.when(yes, self.at))
            out.append(made.alias(tmp))
        return out

    def totals(self) -> dict[str, Column]:
        """Summaries of all rows of a bucket but its first one, joined with that row's values."""
        out = {}
        for n, sp in self.specs.items():
            p, v = F.col(self.tmp[n]), self.value[n]
            if sp.kind == "sum":
                made = F.coalesce(p + v, p, v)
            elif sp.kind in FOLDS:
                made = (F.greatest if sp.kind.endswith("max") else F.least)(p, v)
            elif sp.kind == "first":
                made = F.coalesce(p, v) if self.reverse else F.coalesce(v, p)
            elif sp.kind in ("last", "before"):
                made = F.coalesce(v, p) if self.reverse else F.coalesce(p, v)
            else:
                own = F.struct(v.alias("v"))
                made = own if self.reverse == (sp.kind == "lag") else F.coalesce(p, own)
            out[self.tmp[n]] = made
        return out

    def carries(self) -> dict[str, Column]:
        out = {}
        for n, sp in self.specs.items():
            tmp = F.col(self.tmp[n])
            if sp.kind in FOLDS:
                made = FOLDS[sp.kind](tmp).over(self.whole if sp.kind.startswith("all") else self.before)
            elif sp.kind == "first":
                made = F.first(tmp, ignorenulls=True).over(self.before)
            elif sp.kind == "lead":
                made = F.first(tmp).over(self.behind)
            else:
                made = F.last(tmp, ignorenulls=True).over(self.before)
            out[self.out[n]] = made
        return out

    def results(self) -> dict[str, Column]:
        return {n: self._result(n, sp) for n, sp in self.specs.items()}

    def _result(self, name: str, sp: Running) -> Column:
        v, c = self.value[name], F.col(self.out[name])
        if sp.kind.startswith("all"):
            return c
        if sp.kind == "sum":
            mine = F.sum(v).over(self.upto)
            return F.coalesce(mine + c, mine, c)
        if sp.kind == "max":
            return F.greatest(F.max(v).over(self.upto), c)
        if sp.kind == "min":
            return F.least(F.min(v).over(self.upto), c)
        if sp.kind == "last":
            return F.coalesce(F.last(v, ignorenulls=True).over(self.upto), c)
        if sp.kind == "before":
            return F.coalesce(F.last(v, ignorenulls=True).over(self.earlier), c)
        if sp.kind == "first":
            return F.coalesce(c, F.first(v, ignorenulls=True).over(self.upto))
        step = F.lag if sp.kind == "lag" else F.lead
        return F.coalesce(step(F.struct(v.alias("v"))).over(self.local), c)["v"]

    def temporary(self) -> list[str]:
        return [*self.values(), *self.out.values()]


def _scanned(df: DataFrame, series: Series, specs: dict[str, Running], reverse: bool) -> DataFrame:
    """One scan over placed rows: bucket summaries, their running carry, and the rows with it."""
    s = _Scan(series, specs, reverse, "a")
    base = df.withColumns(s.values())
    summary = base.groupBy(*s.place).agg(*s.partial())
    carried = summary.withColumns(s.carries()).select(*s.place, *s.out.values())
    return base.join(carried, s.place, "left").withColumns(s.results()).drop(*s.temporary())


def _fused(
    df: DataFrame, series: Series, first: dict[str, Running], after: list, second: dict[str, Running], reverse: bool
) -> DataFrame:
    """A scan of preceding rows, columns made of it, and a scan over those, in one pass."""
    a, b = _Scan(series, first, False, "a"), _Scan(series, second, reverse, "b")

    def made(df: DataFrame) -> DataFrame:
        for change in after:
            df = change(df)
        return df.withColumns(b.values())

    base = df.withColumns(a.values())
    inside = {n: F.lag(F.struct(a.value[n].alias("v"))).over(a.local) for n in first}
    local = base.withColumns({"_wf_inner": F.lag(F.lit(True)).over(a.local).isNotNull(), **{n: x["v"] for n, x in inside.items()}})
    rest = made(local.withColumn("_wf_row", F.struct(*df.columns)))
    summary = rest.groupBy(*a.place).agg(
        *a.partial(), *b.partial(F.col("_wf_inner")), a.oldest("_wf_row", a.at).alias("_wf_head")
    )
    known = summary.withColumns(a.carries())
    kept = [*a.out.values(), *b.tmp.values()]
    heads = known.select(*kept, "_wf_head.*").withColumns({n: F.col(a.out[n])["v"] for n in first})
    totals = made(heads).select(*a.place, *a.out.values(), *[c.alias(n) for n, c in b.totals().items()])
    carried = totals.withColumns(b.carries()).select(*a.place, *a.out.values(), *b.out.values())
    seen = made(base.join(carried, a.place, "left").withColumns(a.results()))
    return seen.withColumns(b.results()).drop(*a.temporary(), *b.temporary())


def number_rows(df: DataFrame, series: Series, name: str = "rn") -> DataFrame:
    """Exact 1-based row number of every row in its series."""
    return Timeline(df, series).scan(**{name: running_count()}).done()


def _stages(out: DataFrame, w: WindowSpec, stages: tuple[Stage, ...]) -> DataFrame:
    for stage in stages:
        out = out.withColumns(stage(w))
    return out


def row_blocks(
    df: DataFrame, series: Series, before: int = 0, after: int = 0, block_rows: int = BLOCK_ROWS,
    row_number: str | None = None,
) -> DataFrame:
    """Rows with the block they belong to, and copies of the rows that the neighbour blocks must see."""
    block_rows = max(block_rows, before, after, 1)
    rn = row_number or RN
    numbered = df if row_number and row_number in df.columns else number_rows(df, series, rn)
    block = F.floor((F.col(rn) - 1) / block_rows).cast("long")
    offset = (F.col(rn) - 1) - block * block_rows
    copies = [F.struct(block.alias("b"), F.lit(True).alias("h"))]
    if before:
        into_next = F.when(
            offset >= block_rows - before, F.struct((block + 1).alias("b"), F.lit(False).alias("h"))
        )
        copies.append(into_next)
    if after:
        into_prev = F.when(
            (offset < after) & (block > 0),
            F.struct((block - 1).alias("b"), F.lit(False).alias("h")),
        )
        copies.append(into_prev)
    return (
        numbered.withColumn("_wf_copy", F.explode(F.array_compact(F.array(*copies))))
        .withColumns({BLOCK: F.col("_wf_copy.b"), HOME: F.col("_wf_copy.h")})
        .drop("_wf_copy")
    )


def by_rows(
    df: DataFrame,
    series: Series,
    *stages: Stage,
    before: int = 0,
    after: int = 0,
    block_rows: int = BLOCK_ROWS,
    row_number: str | None = None,
) -> DataFrame:
    """Evaluate window columns that reach at most ``before`` rows back and
    ``after`` rows ahead.  Each stage maps the window (ordered, unframed) to
    columns; later stages may window over columns of earlier ones, so
    ``before``/``after`` must cover their sum."""
    rn = row_number or RN
    spread = row_blocks(df, series, before, after, block_rows, row_number)
    w = Window.partitionBy(*series.key, BLOCK).orderBy(rn)
    out = _stages(spread, w, stages).filter(F.col(HOME)).drop(BLOCK, HOME)
    return out if row_number else out.drop(RN)


def time_blocks(df: DataFrame, series: Series, before: float = 0.0, after: float = 0.0) -> DataFrame:
    """The same for time buckets; ``before`` and ``after`` in seconds (or time units)."""
    scale = series.scale(df)
    width = max(series.width, before, after) * scale
    pos = series.position(df)
    placed = df.withColumn(POS, pos).withColumn(
        BUCKET, F.floor(F.col(POS) / F.lit(width)).cast("long")
    )
    start = F.col(BUCKET) * F.lit(width)
    copies = [F.struct(F.col(BUCKET).alias("b"), F.lit(True).alias("h"))]
    if before:
        copies.append(
            F.when(
                F.col(POS) >= start + F.lit(width - before * scale),
                F.struct((F.col(BUCKET) + 1).alias("b"), F.lit(False).alias("h")),
            )
        )
    if after:
        copies.append(
            F.when(
                F.col(POS) <= start + F.lit(after * scale),
                F.struct((F.col(BUCKET) - 1).alias("b"), F.lit(False).alias("h")),
            )
        )
    return (
        placed.withColumn("_wf_copy", F.explode(F.array_compact(F.array(*copies))))
        .withColumns({BLOCK: F.col("_wf_copy.b"), HOME: F.col("_wf_copy.h")})
        .drop("_wf_copy", BUCKET)
    )


def by_time(
    df: DataFrame,
    series: Series,
    *stages: Stage,
    before: float = 0.0,
    after: float = 0.0,
) -> DataFrame:
    """Evaluate RANGE windows reaching ``before`` / ``after`` seconds (or time
    units).  The window is ordered by numeric position; use
    :func:`reach` to build frame bounds."""
    spread = time_blocks(df, series, before, after)
    w = Window.partitionBy(*series.key, BLOCK).orderBy(POS)
    return _stages(spread, w, stages).filter(F.col(HOME)).drop(BLOCK, HOME, POS)


def reach(df: DataFrame, series: Series, seconds: float) -> int | float:
    """Seconds as a frame bound in position units."""
    if series.is_timestamp(df):
        return int(round(seconds * series.scale(df)))
    return seconds
