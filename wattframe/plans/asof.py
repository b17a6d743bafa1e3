"""As-of lookups: nearest row of another series before or after each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.plans.timeline import Timeline, last_seen
from wattframe.series import Series

SIDE = "_wf_side"
HIT = "_wf_hit"
AT = "_wf_at"


def asof(
    left: DataFrame,
    right: DataFrame,
    series: Series,
    *,
    columns: dict[str, str],
    left_at: str | None = None,
    forward: bool = False,
    strict: bool = False,
    tolerance: float | None = None,
) -> DataFrame:
    """Attach columns of the nearest ``right`` row at or before each left row.

    ``columns`` maps right column -> output name.  ``left_at`` is the left
    column to look up from (default ``series.ts``).  ``forward`` looks at or
    after instead; ``strict`` excludes equal times; ``tolerance`` (seconds or
    time units) nulls hits further away.  Of several right rows at one time the
    last by the series' tie-breakers counts (the first when looking ahead), as
    far as the right side has them.  Both sides are stacked and scanned
    once, so no pair of rows is ever formed and no frame grows with the data.
    """
    at = left_at or series.ts
    scale = series.scale(right)
    right_pos = series.position(right)
    lpos = F.unix_micros(F.col(at)) if scale > 1 else F.col(at)
    payload = F.struct(
        right_pos.alias("_pos"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    )
    # rows of equal time: the side that must be seen first sorts first
    right_first = not strict
    r_rank, l_rank = (0, 1) if right_first != forward else (1, 0)
    lft = left.withColumns({AT: lpos, SIDE: F.lit(l_rank), "_wf_left": F.lit(True)})
    ties = {f"_wf_tie{i}": c for i, c in enumerate(series.tie) if c in right.columns}
    rgt = right.select(
        *series.key,
        right_pos.alias(AT),
        F.lit(r_rank).alias(SIDE),
        *[F.col(c).alias(n) for n, c in ties.items()],
        F.lit(False).alias("_wf_left"),
        payload.alias(HIT),
    )
    both = lft.unionByName(rgt, allowMissingColumns=True)
    axis = Series(series.key, AT, (SIDE, *ties), series.width * scale)
    seen = Timeline(both, axis).scan(reverse=forward, **{HIT: last_seen(F.col(HIT))}).done()
    out = seen.filter("_wf_left")
    hit = F.col(HIT)
    if tolerance is not None:
        near = F.abs(F.col(AT) - hit["_pos"]) <= F.lit(tolerance * scale)
        out = out.withColumn(HIT, F.when(near, hit))
    out = out.withColumns({name: hit[f"c{i}"] for i, name in enumerate(columns.values())})
    return out.drop(AT, SIDE, HIT, "_wf_left", *ties)
