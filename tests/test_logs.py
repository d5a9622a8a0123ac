import datetime as dt
import os

from pyspark.sql import functions as F

from fleetframe.sources import logs


def _records(spark):
    rows = [("cluster", "INFO", dt.datetime(2022, 2, 1, 12, 0, 0, 123999), "Creating nodes ..."),
            ("cluster", "ERROR", dt.datetime(2022, 2, 1, 12, 0, 5), "ssh: timeout: 5"),
            ("cluster2", "DEBUG", dt.datetime(2022, 2, 1, 12, 0, 6), "[worker000] Waiting for SSH ...")]
    return spark.createDataFrame(rows, "name string, level string, ts timestamp_ntz, message string")


def test_render_format(spark):
    line = logs.render_lines(_records(spark), "name", "level", "ts", "message").first()["value"]
    assert line == "cluster INFO 2022-02-01 12:00:00,123: Creating nodes ..."


def test_roundtrip_through_text_files(spark, scratch_dir):
    path = os.path.join(scratch_dir, "log")
    logs.write_lines(logs.render_lines(_records(spark), "name", "level", "ts", "message"), path)
    parsed = logs.parse_lines(logs.read_lines(spark, path))
    got = sorted((r["logger"], r["levelno"], r["message"], r["ts"]) for r in parsed.collect())
    assert got == [
        ("cluster", 20, "Creating nodes ...", dt.datetime(2022, 2, 1, 12, 0, 0, 123000)),
        ("cluster", 40, "ssh: timeout: 5", dt.datetime(2022, 2, 1, 12, 0, 5)),
        ("cluster2", 10, "[worker000] Waiting for SSH ...", dt.datetime(2022, 2, 1, 12, 0, 6)),
    ]
    assert logs.level_filter(parsed).count() == 1                       # default ERROR
    assert logs.level_filter(parsed, logs.DEBUG_LEVEL).count() == 3       # debug flag


def test_unparseable_line(spark):
    parsed = logs.parse_lines(spark.createDataFrame([("garbage",)], "value string")).first()
    assert parsed["logger"] is None and parsed["levelno"] is None


def test_provisioning_phases_from_log_lines(spark, scratch_dir):
    from fleetframe.operators import lifecycle
    t0 = dt.datetime(2022, 2, 1, 12, 0, 0)
    steps = [(0, "worker000", "Create folder for root files on node ..."), (2, "worker000", "Copying root files to node ..."),
             (10, "worker000", "Rebooting ..."), (70, "worker000", "Bootstrapping done."),
             (1, "scheduler", "Running first bootstrap script ..."), (31, "scheduler", "Bootstrapping done.")]
    rows = [("cluster", "INFO", t0 + dt.timedelta(seconds=s), f"[{n}] {m}") for s, n, m in steps]
    rows.append(("cluster", "INFO", t0, "Creating nodes ..."))                # untagged
    recs = spark.createDataFrame(rows, "name string, level string, ts timestamp_ntz, message string")
    path = os.path.join(scratch_dir, "prov")
    logs.write_lines(logs.render_lines(recs, "name", "level", "ts", "message"), path)
    parsed = logs.parse_lines(logs.read_lines(spark, path))
    out = lifecycle.provisioning_phases(parsed).collect()
    got = sorted((r["node"], r["phase"], r["duration_us"]) for r in out)
    assert got == [
        ("scheduler", "Bootstrapping done.", None),
        ("scheduler", "Running first bootstrap script", 30_000_000),
        ("worker000", "Bootstrapping done.", None),
        ("worker000", "Copying root files to node", 8_000_000),
        ("worker000", "Create folder for root files on node", 2_000_000),
        ("worker000", "Rebooting", 60_000_000),
    ]
