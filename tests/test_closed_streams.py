"""Streams in append mode: buckets and runs are written once, when the
watermark has passed them, and their state is gone."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from fleetframe.operators import keyed, lifecycle
from fleetframe.streaming import stateful as streaming

SCHEMA = "id long, k long, ts timestamp_ntz, kind string"
BASE = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


def _stream(spark, folder, blocks):
    for i, rows in enumerate(blocks):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(os.path.join(folder, f"part{i:03d}"))
    return (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(folder))


def _closed(spark, stream, name):
    """What was written, and the progress of every batch."""
    out, ckpt = streaming.stream_workdir(spark, name)
    q = streaming.run_closed(stream, out, ckpt)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), q.recentProgress


def _rows(n_days, per_day=40, seed=1):
    rng = random.Random(seed)
    return [[(100 * d + i, rng.randrange(8), BASE + d * DAY + dt.timedelta(seconds=rng.randrange(86_400)), rng.choice("aab"))
             for i in range(per_day)] for d in range(n_days)]


def _held(progress):
    return [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]


def test_state_of_closed_days_is_gone(spark, scratch_dir):
    days = _rows(9)
    aggregates = lifecycle.success_aggregates("ts", "id", F.col("kind") == "b")
    stream = streaming.bucket_stream(_stream(spark, scratch_dir, days), "k", "ts", aggregates, "6 hours")
    closed, progress = _closed(spark, stream, "closed-days")
    # Two days of eight entities at most, though nine days came.
    assert max(_held(progress)) <= 16 < 8 * 9 - 8
    rows = spark.createDataFrame([r for d in days for r in d], SCHEMA)
    want = rows.groupBy("k", lifecycle.day_bucket("ts").alias("_ff_b")).agg(*aggregates)
    last = BASE + 7 * DAY
    key = lambda df: sorted(map(str, df.select("k", "_ff_b", "n", "first_ts", "last_ts", "hit").collect()))
    assert key(closed.where(F.col("_ff_b") <= F.lit(last))) == key(want.where(F.col("_ff_b") <= F.lit(last)))
    assert closed.groupBy("k", "_ff_b").count().where("count > 1").count() == 0


def test_first_success_of_closed_days_equals_batch(spark, scratch_dir):
    days = _rows(6, seed=2)
    stream = streaming.bucket_stream(_stream(spark, scratch_dir, days), "k", "ts",
                                     lifecycle.success_aggregates("ts", "id", F.col("kind") == "b"), "6 hours")
    closed, _ = _closed(spark, stream, "closed-first")
    rows = spark.createDataFrame([r for d in days for r in d], SCHEMA).where(F.col("ts") < F.lit(BASE + 5 * DAY))
    day = lifecycle.day_bucket("ts")
    got = lifecycle.first_success_from(closed.where(F.col("_ff_b") < F.lit(BASE + 5 * DAY)), rows, "k", "ts", "id", "_ff_b", day)
    want = lifecycle.first_success(rows, "k", "ts", "id", F.col("kind") == "b")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_latest_state_of_closed_days(spark, scratch_dir):
    days = _rows(7, seed=3)
    stream = streaming.closed_state_stream(_stream(spark, scratch_dir, days), "k", "ts", ["ts", "id"], ["id", "ts", "kind"], "6 hours")
    closed, progress = _closed(spark, stream, "closed-state")
    assert max(_held(progress)) <= 16
    rows = spark.createDataFrame([r for d in days for r in d], SCHEMA).where(F.col("ts") < F.lit(BASE + 6 * DAY))
    got = keyed.last_wins(closed.where(F.col("ts") < F.lit(BASE + 6 * DAY)), ["k"], ["ts", "id"])
    assert sorted(map(str, got.select("k", "id").collect())) == sorted(map(str, keyed.last_wins(rows, ["k"], ["ts", "id"]).select("k", "id").collect()))


def _at(hours, k, kind, i=0):
    return (i, k, BASE + dt.timedelta(hours=hours), kind)


def test_a_timer_fires_without_a_further_row(spark, scratch_dir):
    """Entity 1 starts and falls silent; rows of others move the watermark."""
    blocks = [[_at(0, 1, "start"), _at(0, 2, "start")], [_at(1, 2, "end")], [_at(1.5, 9, "other")], [_at(3, 9, "start")], [_at(30, 9, "other")]]
    stream = streaming.timer_stream(_stream(spark, scratch_dir, blocks), "k", "ts", F.col("kind") == "start",
                                    F.col("kind") == "end", 7200, 1, "0 seconds")
    # Rows that neither start nor end a run still move event time: the filter stands above the watermark.
    closed, progress = _closed(spark, stream, "timer")
    got = {r["k"]: (r["status"], r["closed_ts"]) for r in closed.collect()}
    assert got[1] == ("timed_out", BASE + dt.timedelta(hours=2))
    assert got[2] == ("finished", BASE + dt.timedelta(hours=2))
    assert _held(progress)[-1] == 0 and got[9][0] == "timed_out"


def test_a_tick_of_the_clock_fires_timers(spark, scratch_dir):
    events = _stream(spark, os.path.join(scratch_dir, "events"), [[_at(0, 1, "start"), _at(5, 2, "start")]])
    table = spark.createDataFrame([_at(0, 1, "start"), _at(5, 2, "start")], SCHEMA)
    make = lambda ev: streaming.timer_stream(ev, "k", "ts", F.col("kind") == "start", F.col("kind") == "end", 3600, 1, streaming.REPLAY)
    out = streaming.replay_closed(make, events, table, "ts", "tick").collect()
    assert [(r["k"], r["status"]) for r in out] == [(1, "timed_out")]  # 2 still runs at the table's last time


def test_timer_equals_batch_over_unordered_files(spark, scratch_dir):
    rng = random.Random(8)
    rows = [(i, rng.randrange(12), BASE + dt.timedelta(seconds=rng.randrange(500_000)), rng.choice(["start", "end", "end", "other"]))
            for i in range(500)]
    start, end = F.col("kind") == "start", F.col("kind") == "end"
    make = lambda ev: streaming.timer_stream(ev, "k", "ts", start, end, 5000, 7, streaming.REPLAY)
    table = spark.createDataFrame(rows, SCHEMA)
    got = streaming.replay_closed(make, _stream(spark, os.path.join(scratch_dir, "e"), [rows[i::5] for i in range(5)]), table, "ts", "unordered")
    cut = dt.timedelta(seconds=5005)
    last, want = max(r[2] for r in rows), []
    for k in range(12):
        open_ = None
        for _, _, t, kind in sorted((r for r in rows if r[1] == k), key=lambda r: r[2]):
            if open_ and t > open_[2]:
                want.append((k, *open_))
                open_ = None
            if kind == "start":
                open_ = [open_[0] if open_ else t, open_[1] if open_ else None, t + cut]
            elif kind == "end" and open_ and open_[1] is None:
                open_[1] = t
        if open_:
            want.append((k, *open_))
    want = sorted((k, s, "finished" if e and e - s <= cut else "timed_out") for k, s, e, closed in want if closed <= last)
    assert sorted((r["k"], r["start_ts"], r["status"]) for r in got.collect()) == want
    assert {w[2] for w in want} == {"finished", "timed_out"}


def test_watermark_is_a_required_argument():
    import inspect
    for f in (streaming.bucket_stream, streaming.closed_state_stream, streaming.timer_stream):
        assert inspect.signature(f).parameters["watermark"].default is inspect.Parameter.empty
