import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetframe.functions import text
from fleetframe.operators import keyed
from tests import fixtures as fx


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 20), st.integers(0, 100)), min_size=1, max_size=40,
                unique_by=lambda t: (t[0], t[1])))
def test_last_wins_matches_dict_build(spark, rows):
    df = spark.createDataFrame(rows, "k int, seq int, v int")
    got = {r["k"]: r["v"] for r in keyed.last_wins(df, ["k"], ["seq"]).collect()}
    want = {}
    for k, _, v in sorted(rows, key=lambda r: r[1]):
        want[k] = v
    assert got == want


def test_override_merge_false_and_zero_override(spark):
    base = spark.createDataFrame([("n", *fx.SSH_BASE[0])], "key string, name string, user string, fn_private string, port int, compression boolean, cipher string")
    fields = ["name", "user", "fn_private", "port", "compression", "cipher"]
    over = spark.createDataFrame(fx.SSH_OVERRIDES, "key string, name string, user string, fn_private string, port int, compression boolean, cipher string")
    rows = {}
    for okey, *vals in fx.SSH_OVERRIDES:
        one = over.where(F.col("key") == okey).withColumn("key", F.lit("n"))
        rows[okey] = keyed.override_merge(base, one, "key", fields).first()
    assert tuple(rows["all_null"])[1:] == fx.SSH_BASE[0]
    assert rows["no_compression"]["compression"] is False
    assert (rows["new_port"]["user"], rows["new_port"]["port"]) == ("root", 2222)


def test_copy_verdicts(spark):
    req = spark.createDataFrame(fx.COPY_REQUESTS, fx.S.COPY_REQUEST)
    p = text.normalize_path("path")
    parsed = req.select("request_id", "role", text.path_kind(p).alias("kind"), text.path_host(p).alias("host"))
    sources = parsed.where("role = 'source'")
    targets = parsed.where("role = 'target'")
    got = {r["request_id"]: (r["verdict"], r["host"]) for r in keyed.copy_verdict(sources, targets, "request_id").collect()}
    assert got[1] == ("no_host", None)
    assert got[2] == ("multiple_sources", None)
    assert got[3] == ("ok", "worker000")
    assert got[4] == ("host_to_host", None)
    assert got[6] == ("host_to_host", None)   # C:/data/file reads as host "C"
    assert got[7] == ("ok", "scheduler")
    kinds = {r["request_id"]: r["kind"] for r in parsed.where("role = 'source'").collect()}
    assert kinds[5] == "invalid"


def test_copy_verdicts_without_a_source(spark):
    """A request without sources is legal: it has no host unless its target
    has one."""
    sources = spark.createDataFrame([(3, "a")], "request_id long, host string")
    targets = spark.createDataFrame([(1, None), (2, "b"), (3, None)], "request_id long, host string")
    got = {r["request_id"]: (r["n_source_hosts"], r["verdict"], r["host"])
           for r in keyed.copy_verdict(sources, targets, "request_id").collect()}
    assert got == {1: (0, "no_host", None), 2: (0, "ok", "b"), 3: (1, "ok", "a")}


def test_capacity_rollup_golden(spark):
    cfg = fx.frames(spark)["cluster_configs"].where("prefix = 'big'")
    from fleetframe.operators import sequences
    nodes = sequences.expand_nodes(cfg, "prefix", "workers").join(
        cfg.select("prefix", "scheduler", "worker"), "prefix").select(
        "prefix", F.when(F.col("role") == "worker", F.col("worker")).otherwise(F.col("scheduler")).alias("type"),
        "role")
    types = spark.createDataFrame([("ccx52", 32, 128.0), ("ccx12", 2, 8.0)], "name string, cores int, memory double")
    workers = nodes.where("role = 'worker'")
    out = keyed.capacity_rollup(workers, types, "type", "name", ["prefix"], {"cores": "cores", "memory": "memory"}).first()
    assert (out["n_nodes"], out["cores"], out["memory"]) == (8, 256, 1024.0)   # 256 vCPU, 1 TB


def test_catalog_rank_bucketed_equals_plain(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["shared", "dedicated"]), rng.randint(1, 8)) for i in range(200)]
    df = spark.createDataFrame(rows, "name int, cpu_type string, cores int")
    plain = {r["name"]: r["rank"] for r in keyed.catalog_rank(df).collect()}
    bucketed = {r["name"]: r["rank"] for r in keyed.catalog_rank(df, bucket=F.col("cores")).collect()}
    want = {}
    for t in ("shared", "dedicated"):
        for pos, r in enumerate(sorted((r for r in rows if r[1] == t), key=lambda r: (r[2], r[0])), 1):
            want[r[0]] = pos
    assert plain == want and bucketed == want
    first = keyed.catalog_sorted(df).first()
    assert first["cpu_type"] == "dedicated"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(-2, 2)),
                          st.one_of(st.none(), st.booleans())), min_size=1, max_size=6, unique_by=lambda t: t[0]))
def test_override_merge_matches_python_merge(spark, overrides):
    base_rows = [(k, k * 10, k % 2 == 0) for k in range(6)]
    base = spark.createDataFrame(base_rows, "k int, port int, compression boolean")
    over = spark.createDataFrame(overrides, "k int, port int, compression boolean")
    got = {r["k"]: (r["port"], r["compression"]) for r in keyed.override_merge(base, over, "k", ["port", "compression"]).collect()}
    ov = {k: (p, c) for k, p, c in overrides}
    want = {}
    for k, p, c in base_rows:
        op, oc = ov.get(k, (None, None))
        want[k] = (p if op is None else op, c if oc is None else oc)
    assert got == want


def test_copy_verdict_unknown_host_first(spark):
    req = spark.createDataFrame(fx.COPY_REQUESTS, fx.S.COPY_REQUEST)
    p = text.normalize_path("path")
    parsed = req.select("request_id", "role", text.path_host(p).alias("host"))
    known = spark.createDataFrame([("worker000",), ("worker001",), ("scheduler",)], "host string")
    got = {r["request_id"]: (r["verdict"], r["unknown_host"])
           for r in keyed.copy_verdict(parsed.where("role = 'source'"), parsed.where("role = 'target'"),
                                       "request_id", known=known).collect()}
    assert got[6] == ("unknown_host", "C")          # C:/data/file names host C
    assert got[2] == ("multiple_sources", None)
    assert got[3] == ("ok", None)
