import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from wattframe.plans.session import session  # noqa: E402

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.checkpoint.dir": shared}
    s = session("local[8]", "tests", **conf)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def series_of(spark):
    """One-second rows of one or more servers from value lists."""

    def make(step=1.0, server="a", **cols):
        n = len(next(iter(cols.values())))
        rows = [
            (server, T0 + timedelta(seconds=i * step), *[None if v[i] is None else float(v[i]) for v in cols.values()])
            for i in range(n)
        ]
        return spark.createDataFrame(rows, "server STRING, ts TIMESTAMP, " + ", ".join(f"{c} DOUBLE" for c in cols))

    return make
