"""Stream = batch: events split over several files, read one file per
micro-batch, arriving out of order within the watermark delay."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from fleetframe.operators import lifecycle
from fleetframe.plans import queries
from fleetframe.streaming import stateful as streaming
from tests.oracle_check import compare, duck

PROBES = "event_id long, user_id long, ts timestamp_ntz, ok boolean"
RUNS = "event_id long, user_id long, ts timestamp_ntz, is_start boolean, is_end boolean"
BASE = dt.datetime(2024, 1, 1)


def _stream(spark, folder, blocks, schema):
    """One file per block, read one per micro-batch, in the blocks' order."""
    for i, rows in enumerate(blocks):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(folder, f"part{i:03d}"))
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(folder))


def _folded(spark, stream, name):
    out, ckpt = streaming.stream_workdir(spark, name)
    streaming.run_upserts(stream, out, ckpt).awaitTermination()
    return streaming.read_upserts(spark, out, ["user_id", "_ff_b"])


def _first_success(spark, folder, blocks, watermark, width="1 day", bucket=None):
    """(stream result, batch result) as sorted rows."""
    bucket = lifecycle.day_bucket("ts") if bucket is None else bucket
    stream = streaming.bucket_stream(_stream(spark, folder, blocks, PROBES), "user_id", "ts",
                                     lifecycle.success_aggregates("ts", "event_id", F.col("ok")), watermark, width)
    rows = spark.createDataFrame([r for b in blocks for r in b], PROBES)
    got = lifecycle.first_success_from(_folded(spark, stream, "t1"), rows, "user_id", "ts", "event_id", "_ff_b", bucket)
    want = lifecycle.first_success(rows, "user_id", "ts", "event_id", F.col("ok"), bucket)
    return got.orderBy("user_id").collect(), want.orderBy("user_id").collect()


def _run_timeout(spark, folder, blocks, timeout_s, watermark):
    stream = streaming.bucket_stream(_stream(spark, folder, blocks, RUNS), "user_id", "ts",
                                     lifecycle.run_aggregates("ts", "event_id", F.col("is_start"), F.col("is_end")), watermark)
    rows = spark.createDataFrame([r for b in blocks for r in b], RUNS)
    buckets = _folded(spark, stream, "t2")
    got = lifecycle.run_timeout_from(buckets, rows, "user_id", "ts", "event_id", F.col("is_end"), "_ff_b",
                                     lifecycle.day_bucket("ts"), timeout_s, 7, streaming.last_millisecond(buckets))
    want = lifecycle.run_timeout(rows, "user_id", "ts", "event_id", F.col("is_start"), F.col("is_end"), timeout_s, 7)
    return got.orderBy("user_id").collect(), want.orderBy("user_id").collect()


def _events(seed, n, step=dt.timedelta(minutes=20)):
    rng = random.Random(seed)
    return [(i, rng.randint(0, 9), BASE + i * step + dt.timedelta(seconds=rng.randint(0, 50)), rng.random() < 0.02)
            for i in range(n)]


def test_first_success_equals_batch_over_many_days(spark, scratch_dir):
    rows = _events(1, 600)  # eight days, files interleaved
    got, want = _first_success(spark, scratch_dir, [rows[i::5] for i in range(5)], "10 days")
    assert got == want
    assert any(r.success_ts and r.success_ts.date() > r.first_ts.date() for r in want)


def test_narrow_buckets_give_the_same(spark, scratch_dir):
    rows = _events(2, 300, dt.timedelta(minutes=3))
    hour = F.date_trunc("hour", F.col("ts"))
    got, want = _first_success(spark, scratch_dir, [rows[i::4] for i in range(4)], "2 days", "1 hour", hour)
    plain = lifecycle.first_success(spark.createDataFrame(rows, PROBES), "user_id", "ts", "event_id", F.col("ok"))
    assert got == want == plain.orderBy("user_id").collect()


def test_a_success_that_comes_late(spark, scratch_dir):
    """Four failures from 5:00 to 11:00, then a success stamped 1:00."""
    rows = [(i, 1, BASE + dt.timedelta(hours=h), False) for i, h in enumerate((5, 7, 9, 11))] + [(9, 1, BASE + dt.timedelta(hours=1), True)]
    got, want = _first_success(spark, scratch_dir, [[r] for r in rows], "1 hour")
    assert got == want and got[0].attempts_before == 0


def test_an_earlier_success_that_comes_late(spark, scratch_dir):
    """Attempts at minutes 10 and 20, another user at 25, then successes
    stamped 15 and 30."""
    at = lambda m: BASE + dt.timedelta(minutes=m)
    rows = [(1, 1, at(10), False), (2, 1, at(20), False), (5, 2, at(25), False), (3, 1, at(15), True), (4, 1, at(30), True)]
    got, want = _first_success(spark, scratch_dir, [[r] for r in rows], "1 hour")
    assert got == want and (got[0].success_event_id, got[0].attempts_before) == (3, 1)


def test_an_end_that_comes_late(spark, scratch_dir):
    """A start at minute 10, other rows at 20 and 25, an end stamped 15."""
    at = lambda m: BASE + dt.timedelta(minutes=m)
    rows = [(1, 1, at(10), True, False), (2, 1, at(20), False, False), (3, 2, at(25), False, False), (4, 1, at(15), False, True)]
    got, want = _run_timeout(spark, scratch_dir, [[r] for r in rows], 3600, "1 hour")
    assert got == want and got[0].status == "finished"


def test_run_timeout_equals_batch(spark, scratch_dir):
    rng = random.Random(9)
    rows = []
    for i in range(480):
        kind = rng.choices(["start", "end", "other"], [0.1, 0.1, 0.8])[0]
        rows.append((i, rng.randint(0, 30), BASE + dt.timedelta(minutes=17 * i, seconds=rng.randint(0, 59)), kind == "start", kind == "end"))
    got, want = _run_timeout(spark, scratch_dir, [rows[i::4] for i in range(4)], 36 * 3600, "10 days")
    assert got == want
    assert {r.status for r in want} >= {"finished", "timed_out"}


def test_rows_later_than_the_watermark_are_dropped(spark, scratch_dir):
    day = dt.timedelta(days=1)
    rows = [(1, 1, BASE + 9 * day, False), (2, 1, BASE + 10 * day, False), (3, 2, BASE + 11 * day, False), (4, 1, BASE, True)]
    got, want = _first_success(spark, scratch_dir, [[r] for r in rows], "1 day")
    assert got[0].success_ts is None and want[0].success_event_id == 4


def test_never_succeeds_stays_open(spark, scratch_dir):
    rows = [(s, 7, BASE + dt.timedelta(seconds=s), False) for s in range(3)]
    got, want = _first_success(spark, scratch_dir, [rows], "1 hour")
    assert got == want and got[0].success_ts is None and got[0].attempts_before == 3


def test_latest_state_stream_equals_batch(spark, scratch_dir):
    rows = _events(2, 400)
    stream = _stream(spark, scratch_dir, [rows[i::4] for i in range(4)], PROBES)
    out, ckpt = streaming.stream_workdir(spark, "t3-test")
    streaming.run_upserts(streaming.latest_state_stream(stream, "user_id", ["ts", "event_id"], ["event_id", "ts", "ok"]),
                          out, ckpt).awaitTermination()
    got = sorted(tuple(r) for r in streaming.read_upserts(spark, out, ["user_id"]).select("user_id", "event_id").collect())
    batch = spark.createDataFrame(rows, PROBES)
    want = sorted(tuple(r) for r in lifecycle.latest_state(batch, "user_id", ["ts", "event_id"]).select("user_id", "event_id").collect())
    assert got == want


def test_compacted_log_folds_to_the_same(spark, scratch_dir):
    rows = _events(4, 200)
    stream = _stream(spark, os.path.join(scratch_dir, "src"), [rows[i::3] for i in range(3)], PROBES)
    out, ckpt = streaming.stream_workdir(spark, "compact")
    streaming.run_upserts(streaming.latest_state_stream(stream, "user_id", ["ts", "event_id"], ["event_id", "ts"]),
                          out, ckpt).awaitTermination()
    snap = os.path.join(scratch_dir, "snap")
    streaming.compact_upserts(spark, out, ["user_id"], snap)
    full = streaming.read_upserts(spark, out, ["user_id"])
    from_snap = streaming.read_upserts(spark, out, ["user_id"], snapshot=snap)
    key = lambda df: sorted(tuple(r) for r in df.select("user_id", "event_id").collect())
    assert key(full) == key(from_snap)


@pytest.fixture(scope="module")
def part_files(spark, tmp_path_factory):
    """A table folder of three part files, as large tables are."""
    base = str(tmp_path_factory.mktemp("tables"))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(f"{base}/events.parquet")
    return base


@pytest.mark.parametrize("name", ["first_success_stream", "first_success_final", "run_timeout_stream", "latest_state_stream"])
def test_stream_queries_read_folders(spark, part_files, name, monkeypatch):
    monkeypatch.setattr(queries, "FILES_PER_TRIGGER", 1)
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{part_files}/events.parquet/*.parquet')")
    result = compare(spark, name, part_files, con)
    assert result["status"] == "ok", result


def test_stream_reads_as_many_rows_as_the_table(spark, part_files):
    for base in (part_files, "/root/testdata/sf0.001"):
        stream = queries._event_stream(spark, base, 1)
        out, ckpt = streaming.stream_workdir(spark, "count")
        streaming.run_upserts(stream.groupBy("event_type").count(), out, ckpt).awaitTermination()
        n = streaming.read_upserts(spark, out, ["event_type"]).agg(F.sum("count")).first()[0]
        assert n == spark.read.parquet(f"{base}/events.parquet").count()


def test_no_python_in_the_stream(spark, scratch_dir):
    rows = spark.createDataFrame(_events(5, 20), PROBES)
    b = rows.groupBy("user_id", lifecycle.day_bucket("ts").alias("_ff_b")).agg(
        *lifecycle.success_aggregates("ts", "event_id", F.col("ok")))
    plan = lifecycle.first_success_from(b, rows, "user_id", "ts", "event_id", "_ff_b", lifecycle.day_bucket("ts"))
    assert "Python" not in plan._jdf.queryExecution().toString()
