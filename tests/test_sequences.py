import itertools
import random

from pyspark.sql import functions as F

from fleetframe.operators import sequences
from tests import fixtures as fx


def _token_frame(spark, seqs):
    rows = [(sid, pos, tok) for sid, toks in seqs.items() for pos, tok in enumerate(toks)]
    return spark.createDataFrame(rows, "seq_id long, pos int, token string")


def _reference_split(tokens, delim):
    return [list(g) for is_d, g in itertools.groupby(tokens, lambda t: t == delim) if not is_d]


def _runs_as_lists(spark, df, bucket=None):
    labelled = sequences.label_runs(df, ["seq_id"], ["pos"], "token", "|", bucket=bucket).collect()
    runs = {}
    for r in sorted(labelled, key=lambda r: (r["seq_id"], r["pos"])):
        runs.setdefault(r["seq_id"], {}).setdefault(r["run_no"], []).append(r["token"])
    assert all(sorted(v) == list(range(len(v))) for v in runs.values())   # dense numbering
    return {k: [v[i] for i in sorted(v)] for k, v in runs.items()}


def test_split_runs_fixture(spark):
    df = _token_frame(spark, fx.TOKENS)
    got = _runs_as_lists(spark, df)
    for sid, toks in fx.TOKENS.items():
        assert got.get(sid, []) == _reference_split(toks, "|")
    summary = sequences.split_runs(df, ["seq_id"], ["pos"], "token", "|", id_col="pos")
    rows = sorted((r["seq_id"], r["run_no"], r["n_items"], r["first_pos"], r["last_pos"]) for r in summary.collect())
    assert rows == [(1, 0, 2, 1, 2), (1, 1, 2, 5, 6), (3, 0, 2, 0, 1)]


def test_split_runs_property_bucketed(spark):
    rng = random.Random(11)
    seqs = {s: [rng.choice(["|", "a", "b"]) for _ in range(rng.randint(0, 60))] for s in range(12)}
    df = _token_frame(spark, seqs)
    bucket = F.floor(F.col("pos") / 7)
    got = _runs_as_lists(spark, df, bucket)
    for sid, toks in seqs.items():
        assert got.get(sid, []) == _reference_split(toks, "|")
    plain = sorted(tuple(r) for r in sequences.split_runs(df, ["seq_id"], ["pos"], "token", "|", id_col="pos").collect())
    bucketed = sorted(tuple(r) for r in sequences.split_runs(df, ["seq_id"], ["pos"], "token", "|", id_col="pos",
                                                             bucket=bucket).collect())
    assert plain == bucketed
    n_runs = sum(len(_reference_split(t, "|")) for t in seqs.values())
    assert len(plain) == n_runs


def test_concat_ordered(spark):
    a = spark.createDataFrame([(1, 5, "ls"), (1, 2, "cat"), (2, 1, "echo")], "k int, s int, tok string")
    b = spark.createDataFrame([(1, 0, "grep"), (1, 9, "wc"), (3, 4, "sort")], "k int, s int, tok string")
    got = sorted((r["k"], r["pos"], r["tok"]) for r in sequences.concat_ordered(a, b, ["k"], ["s"]).collect())
    assert got == [(1, 0, "cat"), (1, 1, "ls"), (1, 2, "grep"), (1, 3, "wc"), (2, 0, "echo"), (3, 0, "sort")]


def test_render_and_outcome(spark):
    stages = fx.frames(spark)["stages"].withColumn("cmd", F.concat(F.lit("cmd"), F.col("stage").cast("string")))
    out = {r["pipeline_id"]: r for r in sequences.stage_outcome(stages, ["pipeline_id"], "stage", "code").collect()}
    assert (out[1]["failed"], out[1]["running"]) == (False, False)
    assert (out[2]["failed"], out[2]["first_failed_stage"]) == (True, 1)
    assert (out[3]["failed"], out[3]["running"]) == (False, True)
    rows = sequences.render_stages(stages, ["pipeline_id"], "stage", "cmd", "code", "out", "err")
    by = lambda k, c: [r[c] for r in sorted(rows.where(F.col("pipeline_id") == k).collect(), key=lambda r: r["position"])]
    assert by(2, "token") == ["cmd0", "cmd1", "cmd2"] and by(2, "code") == [0, 2, 0] and by(2, "n_stages") == [3, 3, 3]
    assert by(3, "code") == [0, None] and by(1, "position") == [0, 1, 2]
    assert {r["pipeline_id"]: r["rendered"] for r in sequences.rendered(rows, ["pipeline_id"]).collect()}[2] == "cmd0 | cmd1 | cmd2"


def test_render_keeps_one_shape_whatever_the_length(spark):
    n = 2500
    df = (spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("s"), F.concat(F.lit("t"), "id").alias("tok"),
                                F.lit(0).alias("c"), F.concat(F.lit("line\nof "), "id").alias("o"))
          .unionByName(spark.sql("select 2 as k, 0L as s, 't0' as tok, 0 as c, 'x' as o")))
    for bucket in (None, F.floor(F.col("s") / 100)):
        rows = sequences.render_stages(df, ["k"], "s", "tok", "c", "o", F.lit(None).cast("string"), bucket=bucket)
        got = sorted((r["k"], r["position"], r["token"], r["out"], r["n_stages"]) for r in rows.collect())
        assert got == [(1, i, f"t{i}", f"line\nof {i}", n) for i in range(n)] + [(2, 0, "t0", "x", 1)]


def test_expand_nodes_edges(spark):
    cfg = fx.frames(spark)["cluster_configs"]
    nodes = sequences.expand_nodes(cfg, "prefix", "workers")
    counts = {r["prefix"]: r["count"] for r in nodes.groupBy("prefix").count().collect()}
    assert counts["empty"] == 1 and counts["cluster"] == 2 and counts["clash"] == 102
    first = nodes.where("prefix = 'cluster'").orderBy("role").collect()
    assert [(r["node"], r["ip"]) for r in first] == [
        ("cluster-node-scheduler", "10.0.1.200"), ("cluster-node-worker000", "10.0.1.100")]
    bad = {(r["prefix"], r["node_index"]) for r in nodes.where("not ip_ok").collect()}
    # i = 100 takes the scheduler's 10.0.1.200; i = 156 is 10.0.1.256
    assert bad == {("clash", 100), ("octet", 100), ("octet", 156)}


def test_expand_rules_golden(spark):
    cfg = fx.frames(spark)["cluster_configs"].where("prefix = 'cluster'")
    rules = sequences.expand_rules(cfg, "prefix", "dask_ipc", "dask_dash", "dask_nanny")
    got = sorted({(r["rule_no"], r["protocol"], r["port"]) for r in rules.collect()})
    assert got == [(0, "tcp", "22"), (1, "icmp", None), (2, "tcp", "9753"), (3, "tcp", "9756"), (4, "tcp", "9759")]
    assert rules.count() == 10
    assert {tuple(r["destination_ips"]) for r in rules.collect()} == {()}


def test_expand_nodes_in_blocks(spark):
    cfg = spark.createDataFrame([("big", 1000), ("one", 1), ("none", 0)], "prefix string, workers int")
    nodes = sequences.expand_nodes(cfg, "prefix", "workers", block=64).where("role = 'worker'")
    got = {r["prefix"]: (r["n"], r["lo"], r["hi"], r["d"]) for r in nodes.groupBy("prefix").agg(
        F.count("*").alias("n"), F.min("node_index").alias("lo"), F.max("node_index").alias("hi"),
        F.countDistinct("node_index").alias("d")).collect()}
    assert got == {"big": (1000, 0, 999, 1000), "one": (1, 0, 0, 1)}


def test_label_runs_one_row_per_bucket(spark):
    rng = random.Random(13)
    seqs = {s: [rng.choice(["|", "|", "a"]) for _ in range(rng.randint(0, 40))] for s in range(10)}
    df = _token_frame(spark, seqs)
    got = _runs_as_lists(spark, df, F.col("pos"))        # every row its own bucket
    for sid, toks in seqs.items():
        assert got.get(sid, []) == _reference_split(toks, "|")


def test_render_collects_decoded_outputs(spark):
    from fleetframe.functions.text import decode_safe
    stages = fx.frames(spark)["stages"].withColumn("cmd", F.concat(F.lit("cmd"), F.col("stage").cast("string")))
    rows = sequences.render_stages(stages, ["pipeline_id"], "stage", "cmd", "code", decode_safe("out"), decode_safe("err")).collect()
    values = lambda k, c: [r[c] for r in sorted((r for r in rows if r["pipeline_id"] == k), key=lambda r: r["position"])]
    assert values(2, "out") == ["a", "", "c"] and values(2, "err") == ["", "boom", ""]
    assert values(3, "out") == ["a", ""]                # null output of a running stage
    assert values(4, "out") == ["0xC328"]


def test_null_tokens_are_elements(spark):
    seqs = {1: [None, "a", "|", None, "|", "|", "b", None, None], 2: ["|", None], 3: [None] * 5}
    df = _token_frame(spark, seqs)
    for bucket in (None, F.floor(F.col("pos") / 2), F.col("pos"), F.lit(0)):
        got = _runs_as_lists(spark, df, bucket)
        assert got == {k: _reference_split(v, "|") for k, v in seqs.items()}
