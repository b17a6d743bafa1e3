"""Values that are equal but for rounding have no deviation and no score."""

from datetime import datetime, timedelta

import pytest

from wattframe import Series
from wattframe.operators import features

S = Series(("server",), "ts", ("event_id",), 10 * 86_400.0)
#: The ninth step repeats the first, so the deviations of steps 1 to 8 and 2 to 9 are equal.
SWAPPED = (
    [97.16, 13.46, 20.07, 45.37, 4.8, 11.31, 42.49, 137.18, 116.29, 32.59, 77.68, 12.95],
    [2.97, 27.26, 138.71, 76.61, 1.9, 52.78, 133.63, 89.72, 15.25, 39.54, 39.08, 15.33],
    [3.13, 7.72, 43.54, 48.43, 21.22, 42.08, 231.09, 6.89, 8.04, 12.63, 31.64, 70.99],
)


@pytest.mark.parametrize("watts", SWAPPED)
def test_equal_jerks_have_no_score(spark, watts):
    rows = [("a", datetime(2024, 1, 1) + timedelta(hours=i), i, v / 0.997) for i, v in enumerate(watts)]
    df = spark.createDataFrame(rows, "server STRING, ts TIMESTAMP, event_id LONG, power_watts DOUBLE")
    got = features.segment_features(df, S, 172_800.0, 10, 20, 8, 2.0, 0.1, "power_watts", "power_watts")
    z = [r["j_z"] for r in got.orderBy("event_id").collect()]
    assert z[:10] == [None] * 10 and None not in z[10:]
