"""How a DataFrame is read as many time series."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = 1_000_000


@dataclass(frozen=True)
class Series:
    """Key columns, time column and tie-breakers of a set of series.

    ``width`` is the length of one time bucket, in seconds when ``ts`` is a
    timestamp and in the units of ``ts`` otherwise.  A bucket is the unit of
    parallelism inside one series: work is distributed on ``(key, bucket)``, so
    a single very long series still spreads over the cluster.  Pick a width
    that holds roughly 1e5 - 1e6 rows of the busiest series.
    """

    key: tuple[str, ...] = ("server",)
    ts: str = "ts"
    tie: tuple[str, ...] = ()
    width: float = 86_400.0

    def with_width(self, width: float) -> Series:
        return replace(self, width=width)

    def with_key(self, *key: str) -> Series:
        return replace(self, key=tuple(key))

    def is_timestamp(self, df: DataFrame) -> bool:
        return isinstance(df.schema[self.ts].dataType, (T.TimestampType, T.TimestampNTZType))

    def scale(self, df: DataFrame) -> int:
        """Position units per second (microseconds for timestamps)."""
        return MICROS if self.is_timestamp(df) else 1

    def position(self, df: DataFrame) -> Column:
        """Numeric position of a row on its time axis."""
        if self.is_timestamp(df):
            return F.unix_micros(F.col(self.ts).cast("timestamp"))
        return F.col(self.ts)

    def order(self) -> list[Column]:
        return [F.col(self.ts), *[F.col(c) for c in self.tie]]

    def keys(self) -> list[Column]:
        return [F.col(c) for c in self.key]
