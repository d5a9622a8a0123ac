import itertools
import random

from pyspark.sql import functions as F

from fleetframe.functions import text
from fleetframe.operators import inventory
from tests import fixtures as fx


def test_worker_filter_has_no_separator(spark):
    servers = fx.frames(spark)["servers"]
    names = sorted(r["name"] for r in inventory.worker_filter(servers, "cluster").collect())
    # the reference's bare startswith also selects cluster2's workers
    assert names == ["cluster-node-worker000", "cluster2-node-worker000", "cluster2-node-worker001"]


def test_delete_plan_reports_kept(spark):
    inv = inventory.union_inventory({
        "server": fx.frames(spark)["servers"],
        "network": spark.createDataFrame([(n,) for n in fx.NETWORKS], "name string"),
        "firewall": spark.createDataFrame([(n,) for n in fx.FIREWALLS], "name string"),
        "ssh_key": spark.createDataFrame([(n,) for n in fx.SSH_KEYS], "name string"),
    })
    plan = {(r["kind"], r["name"]): r["action"] for r in inventory.delete_plan(inv, "cluster2").collect()}
    assert len(plan) == 6 + 2 + 1 + 3
    assert plan[("network", "cluster2-network")] == "delete"
    assert plan[("server", "cluster-node-scheduler")] == "keep"
    assert plan[("ssh_key", "other-key")] == "keep"


def test_prefix_collisions_matches_brute_force(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(60)] + [None]
    df = spark.createDataFrame([(w,) for w in words], "name string")
    got = sorted(tuple(r) for r in inventory.prefix_collisions(df).collect())
    names = {w for w in words if w is not None}
    want = sorted((a, b) for a, b in itertools.permutations(names, 2) if b.startswith(a))
    assert got == want


def test_prefix_collisions_plan_is_equi_join(spark):
    df = spark.createDataFrame([("cluster",), ("cluster2",)], "name string")
    plan = inventory.prefix_collisions(df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [tuple(r) for r in inventory.prefix_collisions(df).collect()] == [("cluster", "cluster2")]


def test_component_status_from_inventory(spark):
    inv = inventory.union_inventory({
        "server": fx.frames(spark)["servers"],
        "network": spark.createDataFrame([(n,) for n in fx.NETWORKS], "name string"),
        "firewall": spark.createDataFrame([(n,) for n in fx.FIREWALLS], "name string"),
    })
    parts = inv.select(inventory.classify_resource("name").alias("c")).where("c is not null").select("c.*")
    status = {r["prefix"]: r["status"] for r in inventory.component_status(parts, "prefix", "component").collect()}
    assert status == {"cluster": "complete", "cluster2": "firewall_missing"}


def test_access_report_golden(spark):
    servers = fx.frames(spark)["servers"].where(F.col("name").startswith("cluster-"))
    workers = (inventory.worker_filter(servers, "cluster")
               .select(F.lit("cluster").alias("cluster"), F.col("name").alias("node"), F.col("public_ip4").alias("ip")))
    scheds = (servers.where(F.col("name").endswith("-node-scheduler"))
              .select(F.lit("cluster").alias("cluster"), F.col("name").alias("node"), F.col("public_ip4").alias("ip"),
                      text.label_int("labels", "dask_dash").alias("port")))
    rows = inventory.access_report(workers, scheds, "cluster", "node", "ip", "port").orderBy("role_rank", "node").collect()
    assert [(r["node"], r["url"]) for r in rows] == [
        ("cluster-node-worker000", "http://188.34.155.13:9756/"),
        ("cluster-node-scheduler", "http://78.47.76.87:9756/"),
    ]


def test_lookup_and_unknown(spark):
    known = spark.createDataFrame([("worker000", "188.34.155.13"), ("scheduler", "78.47.76.87")], "host string, ip string")
    req = spark.createDataFrame([(1, "worker000"), (2, "worker009"), (3, "worker009"), (4, "scheduler")], "id int, host string")
    got = {r["id"]: (r["ip"], r["resolved"]) for r in inventory.lookup_names(req, known.withColumnRenamed("host", "k"), "host", "k").collect()}
    assert got == {1: ("188.34.155.13", True), 2: (None, False), 3: (None, False), 4: ("78.47.76.87", True)}
    unknown = [tuple(r) for r in inventory.unknown_names(req, known, "host", "host").collect()]
    assert unknown == [("worker009", 2)]


def test_lookup_one(spark):
    servers = fx.frames(spark)["servers"]
    assert inventory.lookup_one(servers, "cluster-node-scheduler").count() == 1
    assert inventory.lookup_one(servers, "missing").count() == 0


def test_count_members_keeps_zero(spark):
    groups = spark.createDataFrame([("cluster",), ("cluster2",), ("dead",)], "prefix string")
    members = spark.createDataFrame([("cluster",), ("cluster2",), ("cluster2",)], "p string")
    got = {r["prefix"]: r["n_members"] for r in inventory.count_members(groups, members, "prefix", "p").collect()}
    assert got == {"cluster": 1, "cluster2": 2, "dead": 0}


def test_admit_and_reject(spark):
    req = spark.createDataFrame([("cluster",), ("fresh",)], "name string")
    existing = spark.createDataFrame([("cluster",)], "name string")
    assert [r[0] for r in inventory.admit_new(req, existing, "name").collect()] == ["fresh"]
    assert [r[0] for r in inventory.reject_existing(req, existing, "name").collect()] == ["cluster"]


def test_require_one(spark):
    import pytest
    servers = fx.frames(spark)["servers"]
    assert inventory.require_one(servers, "cluster-node-scheduler", kind="node")["public_ip4"] == "78.47.76.87"
    with pytest.raises(inventory.NotFound):
        inventory.require_one(servers, "cluster3-node-scheduler", kind="node")


def test_delete_plan_with_prefix_table_matches_list(spark):
    rng = random.Random(21)
    names = ["".join(rng.choice("ab-") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    inv = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    prefixes = sorted({n[:rng.randint(1, len(n))] for n in names[:10]})
    by_list = {r["id"]: r["action"] for r in inventory.delete_plan(inv, prefixes).collect()}
    table = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    by_table = {r["id"]: r["action"] for r in inventory.delete_plan(inv, table).collect()}
    want = {i: ("delete" if any(n.startswith(p) for p in prefixes) else "keep") for i, n in enumerate(names)}
    assert by_list == want and by_table == want


def test_cluster_status_reference_semantics(spark):
    servers = fx.frames(spark)["servers"].select("name")
    clusters = spark.createDataFrame([("cluster",), ("cluster2",), ("gone",), ("clus",)], "prefix string")
    nets = spark.createDataFrame([(n,) for n in fx.NETWORKS] + [("clus-network",)], "name string")
    fws = spark.createDataFrame([(n,) for n in fx.FIREWALLS] + [("clus-firewall",)], "name string")
    got = {r["prefix"]: (r["status"], r["n_workers"]) for r in inventory.cluster_status(clusters, servers, fws, nets).collect()}
    assert got["cluster"] == ("complete", 3)        # its own worker plus cluster2's two (no separator)
    assert got["cluster2"] == ("firewall_missing", 2)
    assert got["gone"] == ("scheduler_missing", 0)
    assert got["clus"] == ("scheduler_missing", 3)   # workers seen, but no clus-node-scheduler


def test_host_index_scheduler_overrides(spark):
    servers = fx.frames(spark)["servers"]
    idx = {r["host"]: r["name"] for r in inventory.host_index(servers, "cluster").collect()}
    assert idx == {"scheduler": "cluster-node-scheduler",
                   "worker000": "cluster2-node-worker000",      # suffix clash across clusters
                   "worker001": "cluster2-node-worker001"}
    idx2 = {r["host"]: r["name"] for r in inventory.host_index(servers, "cluster2").collect()}
    assert idx2 == {"scheduler": "cluster2-node-scheduler", "worker000": "cluster2-node-worker000",
                    "worker001": "cluster2-node-worker001"}
