import datetime as dt
import random

from pyspark.sql import functions as F

from fleetframe.operators import lifecycle
from tests import fixtures as fx


def _probes(spark):
    return fx.frames(spark)["probes"].withColumn("probe_id", F.unix_micros(F.col("ts").cast("timestamp")))


def test_first_success_probes(spark):
    out = {r["node"]: r for r in lifecycle.first_success(_probes(spark), "node", "ts", "probe_id",
                                                        F.col("status") == 0).collect()}
    assert out["never"]["success_ts"] is None and out["never"]["attempts_before"] == 3
    assert out["first"]["attempts_before"] == 0 and out["first"]["wait_us"] == 0
    assert out["later"]["attempts_before"] == 2 and out["later"]["success_ts"] == fx.ts(2)
    # rows arrive out of order; event time decides
    assert out["shuffled"]["success_ts"] == fx.ts(3) and out["shuffled"]["attempts_before"] == 2
    assert out["shuffled"]["wait_us"] == 2_000_000


def _runs(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, kind string")


def test_run_timeout_rounds_up_to_poll(spark):
    rows = [
        ("fast", fx.ts(0), 1, "start"), ("fast", fx.ts(3), 2, "end"),
        ("edge", fx.ts(0), 3, "start"), ("edge", fx.ts(6), 4, "end"),     # ends at 6 s; cut at ceil(5/2)*2 = 6 s
        ("slow", fx.ts(0), 5, "start"), ("slow", fx.ts(7), 6, "end"),
        ("open", fx.ts(8), 7, "start"),
        ("lost", fx.ts(0), 8, "start"),
        ("end_before", fx.ts(0), 9, "end"), ("end_before", fx.ts(1), 10, "start"),
    ]
    out = lifecycle.run_timeout(_runs(spark, rows), "k", "ts", "id", F.col("kind") == "start",
                                F.col("kind") == "end", timeout_s=5, poll_s=2)
    got = {r["k"]: r["status"] for r in out.collect()}
    assert got == {"fast": "finished", "edge": "finished", "slow": "timed_out", "open": "running",
                   "lost": "timed_out", "end_before": "timed_out"}  # an end before the start does not count


def _hot(spark):
    """Two thirds of 12,000 rows on one key, over forty days; its first
    success is on the tenth day."""
    base = dt.datetime(2024, 1, 1)
    rows = [(1 if i % 3 else 2 + i % 7, base + dt.timedelta(minutes=4 * i + 2880 * (i // 600)), i,
             i % 3 == 1 and i > 2990 and i % 50 == 0) for i in range(12_000)]
    return spark.createDataFrame(rows, "k int, ts timestamp_ntz, id long, ok boolean"), rows


def test_hot_key_is_spread_by_bucket(spark):
    """No task gets a hot key's rows: they are reduced per (key, day) first,
    and only the deciding day's rows are compared."""
    df, rows = _hot(spark)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lifecycle.first_success(df.repartition(8), "k", "ts", "id", F.col("ok"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r["k"]: (r["success_id"], r["attempts_before"]) for r in out.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    # Single rows are shuffled by (key, bucket) only; by key alone, aggregates are.
    assert "hashpartitioning(_ff_kb" in plan
    lines = plan.splitlines()
    for i, x in enumerate(lines):
        if "Exchange hashpartitioning(k#" in x and "_ff_b" not in x.split("hashpartitioning")[1].split(")")[0]:
            assert "Aggregate" in lines[i + 1] or "Project" in lines[i + 1], lines[i + 1]
    per = {}
    for r in rows:
        per[(r[0], r[1].date())] = per.get((r[0], r[1].date()), 0) + 1
    hot = sum(n for (k, _), n in per.items() if k == 1)
    assert max(per.values()) < hot / 10
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r[1], r[2], r[3]) for r in rows if r[0] == k)
        at = next((n for n, r in enumerate(mine) if r[2]), None)
        want[k] = (None, len(mine)) if at is None else (mine[at][1], at)
    assert got == want


def test_any_rising_bucket_gives_the_same(spark):
    df, _ = _hot(spark)
    start, end = F.col("id") % 11 == 3, F.col("id") % 13 == 5
    want = [sorted(tuple(r) for r in q.collect()) for q in (
        lifecycle.first_success(df, "k", "ts", "id", F.col("ok"), F.lit(0)),
        lifecycle.run_timeout(df, "k", "ts", "id", start, end, 3600, bucket=F.lit(0)))]
    for b in (F.date_trunc("hour", F.col("ts")), F.col("ts")):
        got = [sorted(tuple(r) for r in q.collect()) for q in (
            lifecycle.first_success(df, "k", "ts", "id", F.col("ok"), b),
            lifecycle.run_timeout(df, "k", "ts", "id", start, end, 3600, bucket=b))]
        assert got == want


def test_latest_state(spark):
    out = {r["node"]: r["status"] for r in lifecycle.latest_state(_probes(spark), "node", ["ts", "probe_id"]).collect()}
    assert out == {"never": 255, "first": 0, "later": 255, "shuffled": 0}


def test_phase_durations_bucketed_equals_plain(spark):
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(rng.randint(0, 3), base + dt.timedelta(minutes=rng.randint(0, 5000)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, id long")
    plain = sorted(tuple(r) for r in lifecycle.phase_durations(df, "k", "ts", "id").collect())
    bucketed = sorted(tuple(r) for r in lifecycle.phase_durations(df, "k", "ts", "id",
                                                                  bucket=F.date_trunc("day", "ts")).collect())
    assert plain == bucketed
    assert len(plain) == 300 - len({r[0] for r in rows})
    for k, ts, i, nts, d in plain:
        assert d == int((nts - ts).total_seconds() * 1_000_000)


def test_durations_across_dst(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("n", dt.datetime(2024, 3, 10, 1, 30), 1), ("n", dt.datetime(2024, 3, 10, 3, 30), 2)],
                                   "k string, ts timestamp_ntz, id long")
        row = lifecycle.phase_durations(df, "k", "ts", "id").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert row["duration_us"] == 2 * 3600 * 1_000_000
