"""Sequences: runs, ordered concatenation, rendering, row expansion and
stage outcomes (G1-G5, A2-A4, O2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetframe.functions.text import node_name, zero_pad
from fleetframe.plans import ordered

# The reference's node addressing and firewall rules.
PRIVATE_NET = "10.0.1."
WORKER_IP_BASE = 100
SCHEDULER_HOST = 200
SCHEDULER_SUFFIX = "scheduler"
WORKER_SUFFIX = "worker"
WORKER_DIGITS = 3
RULE_SOURCES = ("0.0.0.0/0", "::/0")
RULE_DIRECTION = "in"


def label_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], token: str,
               delimiter: str, bucket: Column | None = None) -> DataFrame:
    """G1, long form: drop delimiter rows and give every other row the
    0-based ``run_no`` of its run.  Repeated, leading and trailing
    delimiters make no empty run.  A null token is no delimiter.

    A row starts a run when it is not a delimiter and the row before it
    (in ``order``, per key) is a delimiter or absent; ``run_no`` is the
    running count of starts, minus one.  With ``bucket`` the row-level
    window runs per (key, bucket), and a small per-bucket table (first and
    last row's delimiter flag, starts counted inside) carries the count and
    the "previous row" across bucket borders.
    """
    d = F.col(token).eqNullSafe(F.lit(delimiter)).cast("int")
    src = df.withColumn("_ff_d", d)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        start = (1 - F.col("_ff_d")) * F.coalesce(F.lag("_ff_d").over(w), F.lit(1))
        runs = src.withColumn("_ff_s", start).withColumn(
            "run_no", F.sum("_ff_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint") - 1)
        return runs.where(F.col("_ff_d") == 0).drop("_ff_d", "_ff_s")
    src = src.withColumn("_ff_b", bucket)
    src = src.withColumn("_ff_jk", ordered.join_key(keys, "_ff_b"))
    w = Window.partitionBy("_ff_jk").orderBy(*order)
    local = (src.withColumn("_ff_prev", F.lag("_ff_d").over(w))
             .withColumn("_ff_s", (1 - F.col("_ff_d")) * F.coalesce(F.col("_ff_prev"), F.lit(0)))
             .withColumn("_ff_rs", F.sum("_ff_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("_ff_last", F.lead(F.lit(1)).over(w).isNull()))
    first = F.col("_ff_prev").isNull()
    # Grouped by the window's own partitioning key: no shuffle.  The keys are
    # named too, so that this side reads the columns of the other and, unless
    # the caller carries more, the rows' exchange is used for both.
    edges = (local.where(first | F.col("_ff_last")).groupBy("_ff_jk", *keys)
             .agg(F.max(F.when(first, F.col("_ff_d"))).alias("_ff_df"),
                  F.max(F.when(F.col("_ff_last"), F.col("_ff_d"))).alias("_ff_dl"),
                  F.max(F.when(F.col("_ff_last"), F.col("_ff_rs"))).alias("_ff_sb"))
             .select(*keys, F.col("_ff_jk")["_ff_b"].alias("_ff_b"), "_ff_df", "_ff_dl", "_ff_sb"))
    wb = Window.partitionBy(*keys).orderBy("_ff_b")
    # The bucket's first row starts a run unless it is a delimiter or the
    # previous bucket ended on a non-delimiter.
    first_start = (1 - F.col("_ff_df")) * F.coalesce(F.lag("_ff_dl").over(wb), F.lit(1))
    edges = edges.withColumn("_ff_fs", first_start).withColumn("_ff_tot", F.col("_ff_sb") + F.col("_ff_fs"))
    offsets = edges.select(
        *keys, "_ff_b", "_ff_fs",
        F.coalesce(F.sum("_ff_tot").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ff_off"))
    offsets = offsets.select(ordered.join_key(keys, "_ff_b").alias("_ff_jk"), "_ff_fs", "_ff_off")
    # Same struct key as the window's partitioning: the large side is not
    # shuffled again for this join.
    j = local.join(offsets, "_ff_jk", "left")
    j = j.withColumn("run_no", (F.col("_ff_off") + F.col("_ff_fs") + F.col("_ff_rs")).cast("bigint") - 1)
    return (j.where(F.col("_ff_d") == 0)
            .drop("_ff_d", "_ff_b", "_ff_jk", "_ff_prev", "_ff_s", "_ff_rs", "_ff_last", "_ff_fs", "_ff_off"))


def split_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], token: str,
               delimiter: str, id_col: str, ts_col: str | None = None,
               bucket: Column | None = None) -> DataFrame:
    """G1: one row per non-empty run between delimiters, numbered 0, 1, ...
    per key in sequence order (``run_no``), with its size and first/last
    element.

    :func:`label_runs` numbers the rows; they are reduced per (key, run)
    with partial aggregates, so a long run is never gathered in one task.
    """
    rows = label_runs(df, keys, order, token, delimiter, bucket=bucket)
    aggs = [F.count(F.lit(1)).alias("n_items"),
            F.min_by(F.col(id_col), F.struct(*order)).alias(f"first_{id_col}"),
            F.max_by(F.col(id_col), F.struct(*order)).alias(f"last_{id_col}")]
    if ts_col:
        aggs += [F.min(ts_col).alias(f"first_{ts_col}"), F.max(ts_col).alias(f"last_{ts_col}")]
    return rows.groupBy(*keys, "run_no").agg(*aggs)


def concat_ordered(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   order: Sequence[str], out: str = "pos", bucket: Column | None = None) -> DataFrame:
    """``a | b`` per key: left rows first at positions 0..n-1 in
    ``order``, then right rows at n, n+1, ...  One numbering over the union
    ordered by (side, order) gives exactly that; with ``bucket`` the
    numbering runs per (key, side, bucket)."""
    both = (left.withColumn("_ff_side", F.lit(0))
            .unionByName(right.withColumn("_ff_side", F.lit(1))))
    b = None if bucket is None else F.struct(F.col("_ff_side"), bucket)
    numbered = ordered.row_number(both, keys, ["_ff_side", *order], "_ff_rn", bucket=b)
    return numbered.withColumn(out, F.col("_ff_rn") - 1).drop("_ff_rn", "_ff_side")


def render_stages(df: DataFrame, keys: Sequence[str], stage: str, token: str, code: str, out: str | Column,
                  err: str | Column, bucket: Column | None = None) -> DataFrame:
    """The stages of each key in order, one row per stage:
    ``position`` (0, 1, ... in stage order), ``token``, ``code`` (null: still
    running), ``out``, ``err`` and the key's ``n_stages``.

    The rows in ``position`` order are the reference's lists of tokens, exit
    codes, outputs and errors; as rows they keep their values apart and have
    the same shape whatever their number.  ``bucket`` (non-decreasing in
    ``stage``) spreads a key with very many stages over tasks; the count per
    key is a partial aggregate joined back.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    numbered = ordered.row_number(df, keys, [stage], "_ff_rn", bucket=bucket)
    counts = df.groupBy(F.struct(*keys).alias("_ff_k")).agg(F.count(F.lit(1)).alias("n_stages"))
    rows = numbered.withColumn("_ff_k", F.struct(*keys)).join(counts, "_ff_k")
    return rows.select(*keys, (F.col("_ff_rn") - 1).alias("position"), F.col(token).alias("token"),
                       F.col(code).alias("code"), col(out).alias("out"), col(err).alias("err"), "n_stages")


def rendered(stages: DataFrame, keys: Sequence[str], sep: str = " | ", order: str = "position",
             token: str = "token") -> DataFrame:
    """The tokens of each key's stages as one text, in ``order`` (an ordered
    string aggregate), and their number ``n_stages``.  Null tokens are stages
    without a text.  A command is a handful of stages; its text is one value."""
    quoted = sep.replace("\\", "\\\\").replace("'", "\\'")
    text = F.expr(f"listagg(`{token}`, '{quoted}') WITHIN GROUP (ORDER BY `{order}`)")
    return stages.groupBy(*keys).agg(F.coalesce(text, F.lit("")).alias("rendered"), F.count(F.lit(1)).alias("n_stages"))


def stage_outcome(df: DataFrame, keys: Sequence[str], stage: str, code: str) -> DataFrame:
    """A2 + A3: per command, ``failed`` (some stage exited non-zero),
    ``running`` (some stage has no exit code yet), the stage count and the
    first failed stage.  ``bool_or`` skips nulls, so a running stage never
    counts as failed.  All partial aggregates."""
    c = F.col(code)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_stages"),
        F.coalesce(F.bool_or(c != 0), F.lit(False)).alias("failed"),
        F.coalesce(F.bool_or(c.isNull()), F.lit(False)).alias("running"),
        F.min(F.when(c != 0, F.col(stage))).alias("first_failed_stage"),
        F.max(F.col(stage)).alias("last_stage"))


def require_success(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A2 with the reference's contract: the rows of :func:`stage_outcome`, but
    reading one of a failed command raises, naming it and its first failed
    stage.  Callers who want exit codes instead read the outcome itself."""
    name = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys])
    message = F.concat(F.lit("command failed: "), name, F.lit(", stage "), F.col("first_failed_stage").cast("string"))
    return outcomes.withColumn("failed", F.when(F.col("failed"), F.raise_error(message).cast("boolean")).otherwise(F.lit(False)))


def expand_nodes(configs: DataFrame, prefix: str, workers: str, block: int = 1 << 16) -> DataFrame:
    """G4 + E4: one row per node of each cluster configuration: workers
    ``{prefix}-node-worker{i:03d}`` at ``10.0.1.{100+i}`` and the scheduler
    at ``10.0.1.200``.  ``ip_ok`` flags addresses that clash with the
    scheduler (i = 100) or leave the octet range (i > 155), which the
    reference does not check.

    Worker indexes are generated in two steps: one row per ``block`` of
    indexes, hash-distributed on (prefix, block), then the indexes of each
    block.  A configuration with a huge worker count is thus expanded by
    many tasks; the redistributed rows are tiny (two columns per block).
    """
    n = F.col(workers)
    n_blocks = F.floor((n + (block - 1)) / block).cast("int")
    blocks = (configs.select(F.col(prefix).alias("prefix"), n.alias("_ff_n"),
                             F.explode(F.when(n > 0, F.sequence(F.lit(0), n_blocks - 1))
                                       .otherwise(F.array().cast("array<int>"))).alias("_ff_b"))
              .repartition("prefix", "_ff_b"))
    lo = F.col("_ff_b") * block
    hi = F.least(lo + block, F.col("_ff_n")) - 1
    w = blocks.select("prefix", F.explode(F.sequence(lo, hi)).alias("node_index"))
    host = F.col("node_index") + WORKER_IP_BASE
    worker_rows = w.select(
        "prefix", F.lit(WORKER_SUFFIX).alias("role"), F.col("node_index").cast("int").alias("node_index"),
        node_name("prefix", F.concat(F.lit(WORKER_SUFFIX), zero_pad("node_index", WORKER_DIGITS))).alias("node"),
        F.concat(F.lit(PRIVATE_NET), host.cast("string")).alias("ip"),
        ((host <= 255) & (host != SCHEDULER_HOST)).alias("ip_ok"))
    sched_rows = configs.select(
        F.col(prefix).alias("prefix"), F.lit(SCHEDULER_SUFFIX).alias("role"),
        F.lit(None).cast("int").alias("node_index"),
        node_name(F.col(prefix), F.lit(SCHEDULER_SUFFIX)).alias("node"),
        F.lit(f"{PRIVATE_NET}{SCHEDULER_HOST}").alias("ip"), F.lit(True).alias("ip_ok"))
    return worker_rows.unionByName(sched_rows)


def expand_rules(configs: DataFrame, prefix: str, ipc: str, dash: str, nanny: str) -> DataFrame:
    """The firewall rules of each cluster: (tcp 22), (icmp, no port),
    (tcp ipc), (tcp dash), (tcp nanny), each once per source CIDR, inbound,
    with no destination addresses.  Ports are strings as in the API."""
    rules = F.array(
        F.struct(F.lit("tcp").alias("protocol"), F.lit("22").alias("port")),
        F.struct(F.lit("icmp").alias("protocol"), F.lit(None).cast("string").alias("port")),
        F.struct(F.lit("tcp").alias("protocol"), F.col(ipc).cast("string").alias("port")),
        F.struct(F.lit("tcp").alias("protocol"), F.col(dash).cast("string").alias("port")),
        F.struct(F.lit("tcp").alias("protocol"), F.col(nanny).cast("string").alias("port")))
    r = configs.select(F.col(prefix).alias("prefix"), F.posexplode(rules).alias("rule_no", "rule"))
    r = r.select("prefix", "rule_no", F.lit(RULE_DIRECTION).alias("direction"),
                 F.col("rule")["protocol"].alias("protocol"), F.col("rule")["port"].alias("port"),
                 F.explode(F.array(*[F.lit(s) for s in RULE_SOURCES])).alias("source_ip"),
                 F.array().cast("array<string>").alias("destination_ips"))
    return r
