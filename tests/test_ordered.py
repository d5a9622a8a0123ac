import random

from pyspark.sql import functions as F

from fleetframe.plans import ordered


def _frame(spark, seed=4, n=300):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, 3, None]), i, rng.randint(0, 40), rng.choice([None, 1, 2, 5])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k int, id int, pos int, v int")


def _want(rows, inclusive):
    out = {}
    for k in {r[0] for r in rows}:
        acc = 0
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            v = r[3] or 0
            out[r[1]] = acc + v if inclusive else acc
            acc += v
    return out


def test_running_sum_bucketed_equals_plain(spark):
    rows, df = _frame(spark)
    for inclusive in (True, False):
        want = _want(rows, inclusive)
        for bucket in (None, F.floor(F.col("pos") / 6), F.col("pos")):
            got = {r["id"]: r["s"] for r in ordered.running_sum(df, ["k"], ["pos", "id"], "v", "s",
                                                               bucket=bucket, inclusive=inclusive).collect()}
            assert got == want


def test_next_row_bucketed_equals_plain(spark):
    rows, df = _frame(spark, seed=8)
    plain = {r["id"]: (r["next_id"], r["next_pos"]) for r in ordered.next_row(df, ["k"], ["pos", "id"], ["id", "pos"]).collect()}
    for bucket in (F.floor(F.col("pos") / 5), F.col("pos")):
        got = {r["id"]: (r["next_id"], r["next_pos"])
               for r in ordered.next_row(df, ["k"], ["pos", "id"], ["id", "pos"], bucket=bucket).collect()}
        assert got == plain


def _partitions_of_hot_key(spark, df):
    # Keep every column: a projection of the partition id alone would let
    # Catalyst prune the window away.
    rows = df.where("k = 1").select(F.spark_partition_id().alias("_pid"), *df.columns).collect()
    return len({r["_pid"] for r in rows})


def test_hot_key_spreads_over_partitions(spark):
    """A key with most rows: the plain window gathers it in one partition,
    the bucketed one spreads its row-level work over many."""
    from fleetframe.operators import sequences
    rows = [(1 if i % 10 else 2, i, i // 3, "|" if i % 7 == 0 else "x", 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, id int, pos int, tok string, v int")
    saved = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bucket = F.floor(F.col("pos") / 50)
        plain = ordered.running_sum(df, ["k"], ["pos", "id"], "v", "s")
        spread = ordered.running_sum(df, ["k"], ["pos", "id"], "v", "s", bucket=bucket)
        assert _partitions_of_hot_key(spark, plain) == 1
        assert _partitions_of_hot_key(spark, spread) > 1
        nxt = ordered.next_row(df, ["k"], ["pos", "id"], ["id"], bucket=bucket)
        assert _partitions_of_hot_key(spark, nxt) > 1
        runs = sequences.label_runs(df, ["k"], ["pos", "id"], "tok", "|", bucket=bucket)
        assert _partitions_of_hot_key(spark, runs) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", saved)


def _check_adaptive(spark, rows, max_rows, most):
    df = spark.createDataFrame(rows, "k int, id int, pos int")
    b = ordered.adaptive_bucket(df, ["k"], ["pos", "id"], F.floor(F.col("pos") / 100_000), max_rows=max_rows)
    sizes = {(r["k"], r["_ff_abk"]["f"]): r["count"] for r in b.groupBy("k", "_ff_abk").count().collect()}
    assert max(sizes.values()) <= most
    # monotone: a row later in the order never gets a lower bucket
    per = sorted((r["pos"], r["id"], r["_ff_abk"]["f"]) for r in b.where("k = 1").collect())
    assert all(a[2] <= c[2] for a, c in zip(per, per[1:]))
    got = {r["id"]: r["s"] for r in ordered.row_number(b, ["k"], ["pos", "id"], "s", bucket=F.col("_ff_abk")).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])), 1):
            want[r[1]] = n
    assert got == want
    return sizes


def test_adaptive_bucket_splits_hot_groups_exactly(spark):
    rng = random.Random(17)
    # key 1 holds most rows, all in one coarse bucket
    rows = [(1 if i % 5 else rng.randint(2, 4), i, rng.randint(0, 10_000)) for i in range(3000)]
    sizes = _check_adaptive(spark, rows, 300, 600)
    assert len([s for s in sizes if s[0] == 1]) >= 6


def test_adaptive_bucket_splits_ties(spark):
    """Three quarters of the rows share one value of the first order column."""
    rows = [(1, i, 7 if i % 4 else i) for i in range(20_000)]
    sizes = _check_adaptive(spark, rows, 1000, 1500)
    assert len(sizes) >= 20


def test_adaptive_bucket_without_hot_groups(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(10)], "k int, id int, pos int")
    b = ordered.adaptive_bucket(df, ["k"], ["pos", "id"], F.lit(0), max_rows=1 << 20)
    assert {r["_ff_abk"]["f"] for r in b.collect()} == {0}
