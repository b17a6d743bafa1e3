"""Scans of written files with the oddities that captures have."""

import json
from datetime import datetime

import pytest

from wattframe.operators import risk
from wattframe.sources import readers, registry, writers


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_traces_take_two_columns_and_drop_broken_rows(spark, tmp_path):
    text = "t,power,extra\n0.0,100.5,x\n0.1,,y\n0.2,nan,z\n0.3,101\n0.4\nbad,7,q\n0.5, 102.25 ,1,2,3\n0.6,inf\n"
    path = write(tmp_path, "run3/hpl_rampc_x.csv", text)
    got = readers.read_traces(spark, path).orderBy("seq").collect()
    assert [(r.time_s, r.power_W, r.run, r.workload, r.arm) for r in got] == [(t, p, 3, "hpl", "rampc") for t, p in ((0.0, 100.5), (0.3, 101.0), (0.5, 102.25))]


def test_order_of_lines_in_a_split_file(spark, tmp_path):
    path = write(tmp_path, "run1/hpl_base.csv", "t,p\n" + "".join(f"{i},{i * 2}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = readers.read_traces(spark, path)
        assert df.rdd.getNumPartitions() > 3
        assert [r.time_s for r in df.orderBy("seq").collect()] == list(range(20_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("head", ["time_s,power_W", "mono_s,x,watts"])
def test_capture_schemas(spark, tmp_path, head):
    row = "1.5,2.5" if "power_W" in head else "1.5,9,2.5"
    got = readers.read_capture(spark, write(tmp_path, "c.csv", f"{head}\n{row}\n")).collect()
    assert [tuple(r) for r in got] == [(1.5, 2.5)]
    with pytest.raises(ValueError):
        readers.read_capture(spark, write(tmp_path, "d.csv", "a,b\n1,2\n"))


def test_high_rate_capture_mixes_fractions(spark, tmp_path):
    path = write(tmp_path, "hf.csv", "time,power\n2024-01-01T00:00:00Z,1\n2024-01-01T00:00:00.1Z,2\n2024-01-01T00:00:00.250000Z,x\nnot a time,4\n2024-01-01T00:00:01Z,5\n")
    got = readers.read_hf(spark, path, "2024-01-01 00:00:00", "2024-01-01 00:00:01").orderBy("time").collect()
    assert [r.power for r in got] == [1.0, 2.0, None]


def test_annotated_export(spark, tmp_path):
    text = (
        "#datatype,string,long\n,result,_time,_value\n,,2024-01-01T00:00:00.123456789Z,1.5\n,,2024-01-01T00:00:01Z,true\n"
        ",,,7\n,,2024-01-01T00:00:00.123456Z,99\n,,2024-01-01T00:00:02Z,oops\n\n"
        "#group,x\n,result,_field,other\n,,2024-01-01T00:00:05Z,5\n\n,_value,_time\n,8,2024-01-01T00:00:03Z\n"
    )
    got = readers.read_annotated(spark, write(tmp_path, "a.csv", text)).collect()
    assert [(r.ts.replace(tzinfo=None), r.value) for r in got] == [
        (datetime(2024, 1, 1, 0, 0, 0, 123456), 1.5), (datetime(2024, 1, 1, 0, 0, 1), 1.0), (datetime(2024, 1, 1, 0, 0, 3), 8.0),
    ]


def test_epoch_series(spark, tmp_path):
    got = readers.read_epoch(spark, write(tmp_path, "e.csv", "t,v,w\n10.5,1,z\n,2\n11,x\n")).orderBy("ts").collect()
    assert [(r.ts.timestamp(), r.value) for r in got] == [(10.5, 1.0), (11.0, None)]


def test_event_phase_and_benchmark_logs(spark, tmp_path):
    log = write(tmp_path, "run2/hpl_usagegov.jsonl", 'noise\n{"ts": "2024-01-01T00:00:00Z", "event": "clamp", "power_w": 5.5}\n{"event": "no time"}\n')
    got = readers.read_event_log(spark, log).collect()
    assert [(r.event, r.power_w, r.run, r.workload, r.arm) for r in got] == [("clamp", 5.5, 2, "hpl", "usagegov")]
    log = write(tmp_path, "run2/hpl_rampc.log", "x\n[10:20:30] busy START at t= 1.5 s\n[10:20:40] busy STOP at t= 11.5 s\n")
    phases = readers.read_phase_log(spark, log)
    assert [(r.kind, r.edge, r.t_rel) for r in phases.orderBy("line_no").collect()] == [("busy", "START", 1.5), ("busy", "STOP", 11.5)]
    anchor = readers.clock_anchor(phases, ["run"]).first()
    assert (anchor.hh, anchor.mm, anchor.ss, anchor.anchor_rel) == (10, 20, 30, 1.5)
    log = write(tmp_path, "run2/hpl_base.out", "WR00 1 2 100.0 1.0e+03\nother\nWC01 1 2 187.1 1.8241e+03\nend\n")
    assert [(r.solve_s, r.gflops) for r in readers.read_benchmark_log(spark, log).collect()] == [(187.1, 1824.1)]


def test_incremental_load_appends_late_rows_and_refuses_duplicates(spark, tmp_path):
    def rows(*r):
        return spark.createDataFrame([(s, datetime.fromisoformat(t), v) for s, t, v in r], "server string, ts timestamp, v int")

    target = str(tmp_path / "cache")
    rows(("a", "2024-01-01T00:00:00", 1), ("a", "2024-01-02T00:00:00", 2)).selectExpr("*", "to_date(ts) as date").write.partitionBy("date").parquet(target)
    fresh = rows(("a", "2024-01-02T00:00:00", 3), ("a", "2024-01-03T00:00:00", 4), ("a", "2024-01-01T00:00:00", 9))
    got = readers.load_incremental(spark, fresh, target, ["server", "ts"], "v").orderBy("ts").collect()
    assert [r.v for r in got] == [1, 3, 4]
    assert [r.v for r in readers.read_telemetry(spark, target, "2024-01-02 00:00:00", "2024-01-03 00:00:00").collect()] == [3]
    with pytest.raises(ValueError):
        readers.assert_unique(rows(("a", "2024-01-01T00:00:00", 1), ("a", "2024-01-01T00:00:00", 2)), ["server", "ts"])


def test_registry_without_models(spark, tmp_path):
    assert registry.load_latest(spark, str(tmp_path / "none")) == (None, "none")
    write(tmp_path, "bad/registry/x.parquet", "not a parquet file")
    with pytest.raises(Exception, match="(?i)parquet|footer|schema"):
        registry.load_latest(spark, str(tmp_path / "bad"))


def test_table_and_document_sinks(spark, tmp_path):
    board = spark.createDataFrame([("run1", "base", 0.25), ("run2", None, None)], "run STRING, arm STRING, cv DOUBLE")
    path = str(tmp_path / "board")
    writers.write_table(board, path)
    writers.write_table(board, path)  # replaces
    back = spark.read.option("header", True).schema(board.schema).csv(path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, board.collect()), key=str)
    writers.write_table(board, str(tmp_path / "pq"), "parquet")
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2
    key = [("hpl", "base")]
    power = spark.createDataFrame([(*k, 12.5, 8.0, 99.0) for k in key], "workload STRING, arm STRING, peak_MW DOUBLE, mean_MW DOUBLE, trace_energy_MJ DOUBLE")
    danger = spark.createDataFrame([(*k, 0.4, 3) for k in key], "workload STRING, arm STRING, cv DOUBLE, n_exceedances_in_trace INT")
    docs = risk.metrics_document(power, danger, ["workload", "arm"])
    writers.write_documents(docs, str(tmp_path / "docs"))
    doc = json.loads(next((tmp_path / "docs").glob("part-*")).read_text())
    assert doc == {"workload": "hpl", "arm": "base", "power": {"peak_MW": 12.5, "mean_MW": 8.0, "trace_energy_MJ": 99.0}, "risk": {"cv": 0.4, "n_exceedances_in_trace": 3}}


def test_metrics_documents_are_keyed_by_their_folder(spark, tmp_path):
    text = json.dumps({"power": {"peak_MW": 1.5}, "risk": {"cv": 0.2, "unknown": 7}, "voltage": {"min_voltage_pu": 0.97}}, indent=2)
    for name in ("hpl_base_worst", "hpl_rampc_r3_worst", "ai_base_r2_N500_worst"):
        write(tmp_path, f"docs/{name}/metrics.json", text)
    got = readers.read_metrics(spark, str(tmp_path / "docs/*/metrics.json")).collect()
    assert {(r.workload, r.arm, r.run, r.n_servers) for r in got} == {("hpl", "base", None, 10_000), ("hpl", "rampc", 3, 10_000), ("ai", "base", 2, 500)}
    assert {(r.power.peak_MW, r.risk.cv, r.voltage.min_voltage_pu, r.frequency) for r in got} == {(1.5, 0.2, 0.97, None)}


def test_trace_export_is_rebased_or_absolute(spark, tmp_path):
    rows = [("a", datetime.fromisoformat("2024-01-01T00:00:10.500"), 5.0), ("a", datetime.fromisoformat("2024-01-01T00:00:10"), 4.0), ("b", datetime.fromisoformat("2024-01-01T00:01:00"), 6.0)]
    df = spark.createDataFrame(rows, "server STRING, ts TIMESTAMP, value DOUBLE")
    for epoch, first in ((False, 0.0), (True, 1704067210.0)):
        path = str(tmp_path / f"trace-{epoch}")
        writers.export_trace(df, ["server"], path, epoch=epoch)
        back = spark.read.option("header", True).schema("time_s DOUBLE, power_W DOUBLE, server STRING").csv(path)
        assert [(r.time_s, r.power_W) for r in back.filter("server = 'a'").orderBy("time_s").collect()] == [(first, 4.0), (first + 0.5, 5.0)]
        lines = next((tmp_path / f"trace-{epoch}" / "server=a").glob("part-*")).read_text().splitlines()
        assert lines[0] == "time_s,power_W" and len(lines) == 3
