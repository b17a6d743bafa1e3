"""wattframe: power and system telemetry analytics as Spark jobs."""

from wattframe.series import Series

__all__ = ["Series"]
