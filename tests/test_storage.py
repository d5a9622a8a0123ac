"""What is stored so that less is read or moved: logs by level, names behind
Bloom filters, bucketed snapshots, and a sketch of keys."""

import datetime as dt
import os

from pyspark.sql import functions as F

from fleetframe.operators import inventory, keyed
from fleetframe.sources import logs, tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _metric(spark, df, operator, name):
    """A metric of the operators of this name, after a run of the whole plan
    without adaptive execution."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        q = df.select("*")._jdf.queryExecution()
        rows = q.executedPlan().executeCollect()
        total, todo = 0, [q.executedPlan()]
        while todo:
            p = todo.pop()
            if p.nodeName().startswith(operator):
                total += p.metrics().apply(name).value()
            children = p.children()
            todo += [children.apply(i) for i in range(children.length())]
        return total, len(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def _lines(spark):
    levels = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]
    rows = [(f"c{i}", levels[i % 5], dt.datetime(2024, 1, 1, 0, 0, i % 60), f"message {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "name string, level string, ts timestamp_ntz, message string")
    odd = spark.createDataFrame([("garbage",), ("a STRANGE b: c",), (None,)], "value string")
    return logs.render_lines(df, "name", "level", "ts", "message").unionByName(odd)


def test_threshold_reads_only_the_folders_above_it(spark, scratch_dir):
    path = os.path.join(scratch_dir, "log")
    logs.write_by_level(_lines(spark).where("value is not null"), path)
    for threshold, n in ((10, 100), (30, 60), (40, 40), (50, 20), (51, 0)):
        found = logs.read_by_level(spark, path, threshold)
        plan = _plan(found)
        assert "PartitionFilters: [isnotnull(levelno" in plan and f">= {threshold}" in plan
        assert found.count() == n and logs.parse_lines(found).where("levelno is null").count() == 0
        read = {f.split("levelno=")[1].split("/")[0] for f in found.select(F.input_file_name()).toDF("f").distinct().toPandas()["f"]}
        assert all(int(x) >= threshold for x in read)
    assert logs.read_by_level(spark, path, logs.NO_LEVEL).count() == 102


def test_log_stream_by_level_is_the_table(spark, scratch_dir):
    src, out = os.path.join(scratch_dir, "src"), os.path.join(scratch_dir, "out")
    _lines(spark).where("value is not null").repartition(4).write.parquet(src)
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(src)
    logs.stream_by_level(stream, out, os.path.join(scratch_dir, "ck")).awaitTermination()
    assert logs.read_by_level(spark, out, logs.NO_LEVEL).count() == 102
    assert logs.read_by_level(spark, out).count() == 40


def test_point_lookup_reads_fewer_row_groups(spark, scratch_dir):
    """Names in no order: every group's least and greatest name span them all."""
    servers = (spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("name"), F.col("id").alias("port"))
               .repartition(2, F.rand(1)))
    plain, filtered = os.path.join(scratch_dir, "plain"), os.path.join(scratch_dir, "filtered")
    servers.write.option("parquet.enable.dictionary", "false").option("parquet.block.size", str(1 << 20)).parquet(plain)
    tables.write_lookup(servers, filtered, "name", names_per_file=100_000, row_group=1 << 20)
    name = servers.where("port = 777").first()["name"]
    without, n = _metric(spark, inventory.lookup_one(spark.read.parquet(plain), name), "Scan", "numOutputRows")
    with_, m = _metric(spark, inventory.lookup_one(spark.read.parquet(filtered), name), "Scan", "numOutputRows")
    assert n == m == 1 and without == 200_000 and 0 < with_ < without / 4
    absent, none = _metric(spark, inventory.lookup_one(spark.read.parquet(filtered), "no such name"), "Scan", "numOutputRows")
    assert none == 0 and absent < without / 4
    assert inventory.require_one(spark.read.parquet(filtered), name)["port"] == 777


def test_bucketed_snapshots_join_without_a_shuffle(spark):
    nodes = spark.range(500).select(F.concat(F.lit("c"), F.col("id") % 40).alias("cluster"), F.col("id").alias("node"), F.lit(None).cast("int").alias("port"))
    base = spark.range(45).select(F.concat(F.lit("c"), "id").alias("cluster"), F.col("id").cast("int").alias("port"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = tables.write_bucketed(nodes, "ff_nodes", ["cluster"], 4)
        small = tables.write_bucketed(base, "ff_clusters", ["cluster"], 4)
        merged = keyed.override_merge(big, small, "cluster", ["port"])  # P7
        assert "Exchange" not in _plan(merged) and "SortMergeJoin" in _plan(merged)
        want = keyed.override_merge(nodes, base, "cluster", ["port"])
        assert sorted(map(str, merged.collect())) == sorted(map(str, want.collect()))
        report = inventory.lookup_names(big, small.withColumnRenamed("port", "dash"), "cluster", "cluster")  # J3's and J1's join
        assert "Exchange" not in _plan(report)
        # One bucketed side: only the other moves.
        half = _plan(keyed.override_merge(big, base, "cluster", ["port"]))
        assert half.count("Exchange") == 1 and "Exchange" not in half.split("ff_nodes")[0].split("SortMergeJoin")[1].split("Sort ")[0]
        by_cluster = big.groupBy("cluster").count()
        assert "Exchange" not in _plan(by_cluster) and by_cluster.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop table if exists ff_nodes")
        spark.sql("drop table if exists ff_clusters")


def _guard_tables(spark):
    requests = spark.range(4000).select(F.when(F.col("id") != 5, F.concat(F.lit("r"), "id")).alias("name"), F.col("id").alias("x"))
    existing = spark.range(3990, 4300).select(F.concat(F.lit("r"), "id").alias("name")).unionByName(
        spark.createDataFrame([("r7",), ("r7",), (None,)], "name string"))
    return requests, existing


def test_sketch_changes_no_answer(spark):
    requests, existing = _guard_tables(spark)
    for f in (inventory.admit_new, inventory.reject_existing):
        plain, quick = (sorted(map(str, f(requests, existing, "name", sketch=s).collect())) for s in (False, True))
        assert plain == quick
    none = existing.limit(0)
    assert inventory.admit_new(requests, none, "name", sketch=True).count() == 4000
    assert inventory.reject_existing(requests, none, ["name"], sketch=True).count() == 0
    assert inventory.admit_new(requests.limit(0), existing, ["name"], sketch=True).count() == 0


def test_sketch_lets_everything_known_through_even_when_full(spark):
    keys = spark.range(3000).select("id")
    sketch = inventory.key_sketch(keys, "id", bits=128)
    assert keys.where(inventory.may_hold(sketch, "id", bits=128)).count() == 3000
    roomy = inventory.key_sketch(keys, "id")
    assert spark.range(10_000, 30_000).where(inventory.may_hold(roomy, "id")).count() < 200


def test_sketch_drops_requests_before_the_shuffle(spark):
    requests, existing = _guard_tables(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = lambda s, f: _metric(spark, f(requests, existing, "name", sketch=s),
                                     "Exchange", "shuffleRecordsWritten")[0]
        for f in (inventory.admit_new, inventory.reject_existing):
            plain, quick = moved(False, f), moved(True, f)
            assert plain - quick > 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
