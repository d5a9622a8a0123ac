"""Probe, poll and provisioning timelines in batch.

The reference answers these for one node inside a polling loop; here
each is a table operator over many entities.  The streaming versions are
in :mod:`fleetframe.streaming.stateful`; both reduce the rows per entity and
time bucket first and share what follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetframe.operators.keyed import last_wins
from fleetframe.plans import ordered


def micros_between(start: str | Column, end: str | Column) -> Column:
    """``end - start`` in microseconds.  For TIMESTAMP_NTZ this is wall-clock
    time, independent of the session time zone (no cast to TIMESTAMP,
    which would shift across daylight-saving changes)."""
    return F.timestamp_diff("MICROSECOND", start if isinstance(start, Column) else F.col(start),
                            end if isinstance(end, Column) else F.col(end))


def day_bucket(ts: str) -> Column:
    """The day of a timestamp: a bucket that does not fall as time goes on."""
    return F.date_trunc("day", F.col(ts))


# Tasks that the rows of one (entity, bucket) are dealt to at most.
SALTS = 16


def _by_bucket(key: str, b: Column) -> Column:
    """One join column for (key, bucket); struct fields compare null-safe."""
    return F.struct(F.col(key).alias("k"), b.alias("b"))


def meet_by_bucket(per_key: DataFrame, rows: DataFrame, key: str, ts: str, tie: str, b: str, bucket: Column,
                   salts: int = SALTS) -> DataFrame:
    """Each row of ``per_key`` (one an entity, with its deciding bucket ``b``)
    beside the ``rows`` of that bucket (``row``: their time and tie), or
    beside null.

    Both sides are dealt to ``salts`` parts of the bucket, the rows by a hash
    of their own order, the one row of the entity once to each, so the rows
    of a single hot bucket meet it in as many tasks.  What is made of a part
    is a partial result: the caller adds them up by entity.
    """
    sides = (per_key.withColumn("_ff_kb", _by_bucket(key, F.col(b)))
             .withColumn("_ff_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    dealt = rows.select(_by_bucket(key, bucket).alias("_ff_kb"), F.pmod(F.xxhash64(ts, tie), F.lit(salts)).cast("int").alias("_ff_salt"),
                        F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie")).alias("row"))
    return sides.join(dealt, ["_ff_kb", "_ff_salt"], "left").drop("_ff_kb", "_ff_salt")


def success_aggregates(ts: str, tie: str, success: Column) -> list[Column]:
    """What T1 needs of each (key, bucket): its number of attempts, the time
    of the first and the last, and the first success."""
    return [F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
            F.min(F.when(success, F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie")))).alias("hit")]


def first_success_from(buckets: DataFrame, rows: DataFrame, key: str, ts: str, tie: str, b: str,
                       bucket: Column, salts: int = SALTS) -> DataFrame:
    """T1 from ``buckets`` (:func:`success_aggregates` by key and ``b``) and
    the single ``rows``.

    Buckets before the one that holds the first success count whole, by a
    window over a key's buckets (its days, not its rows); only the rows of
    that deciding bucket are compared one by one.  They meet the success on
    (key, bucket, salt), so that neither a hot key nor a hot bucket of it is
    one task, and the parts' counts are added up.
    """
    whole = Window.partitionBy(key)  # over buckets, not rows
    so_far = whole.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    hit_at = F.min(F.when(F.col("hit").isNotNull(), F.col(b))).over(whole)
    per_key = (buckets.select(key, b, F.col("hit")["ts"].alias("_ff_ts"), F.col("hit")["tie"].alias("_ff_tie"),
                              F.min("first_ts").over(whole).alias("first_ts"), hit_at.alias("at"),
                              F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("earlier"),
                              F.sum("n").over(whole).alias("total"), F.min(b).over(whole).alias("_ff_first"))
               # The deciding bucket's row; any one where nothing succeeded.
               .where(F.col(b).eqNullSafe(F.coalesce("at", "_ff_first"))))
    met = meet_by_bucket(per_key, rows, key, ts, tie, b, bucket, salts)
    before = F.col("row") < F.struct(F.col("_ff_ts").alias("ts"), F.col("_ff_tie").alias("tie"))
    # All but the count are the same in every part.
    out = met.groupBy(key).agg(*[F.min(c).alias(c) for c in ("first_ts", "at", "earlier", "total", "_ff_ts", "_ff_tie")],
                               F.count_if(before).alias("inside"))
    found = F.col("at").isNotNull()
    attempts = F.when(found, F.col("earlier") + F.col("inside")).otherwise(F.col("total"))
    return out.select(key, "first_ts", F.col("_ff_ts").alias("success_ts"), F.col("_ff_tie").alias(f"success_{tie}"),
                      attempts.cast("bigint").alias("attempts_before"),
                      micros_between(F.col("first_ts"), F.col("_ff_ts")).alias("wait_us"))


def first_success(df: DataFrame, key: str, ts: str, tie: str, success: Column,
                  bucket: Column | None = None) -> DataFrame:
    """Per entity, its first successful attempt and what came before.

    Output: ``first_ts`` (first attempt), ``success_ts`` / ``success_<tie>``
    (null while it never succeeded; the reference waits forever),
    ``attempts_before`` (attempts ordered before the success, or all of
    them), ``wait_us``.  ``bucket`` must not fall as ``ts`` grows (default:
    its day); see :func:`first_success_from`.
    """
    b = day_bucket(ts) if bucket is None else bucket
    buckets = df.groupBy(F.col(key), b.alias("_ff_b")).agg(*success_aggregates(ts, tie, success))
    return first_success_from(buckets, df, key, ts, tie, "_ff_b", b)


def cut_micros(timeout_s: float, poll_s: float) -> int:
    """When a run is cut: the clock is read only after each sleep."""
    return int(-(-timeout_s // poll_s) * poll_s * 1_000_000)


def run_aggregates(ts: str, tie: str, start: Column, end: Column) -> list[Column]:
    """What T2 needs of each (key, bucket): the first start, the first end,
    and the last time of all."""
    return [F.max(ts).alias("last_ts"), F.min(F.when(end, F.col(ts))).alias("end_ts"),
            F.min(F.when(start, F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie")))).alias("begin")]


def run_timeout_from(buckets: DataFrame, rows: DataFrame, key: str, ts: str, tie: str, end: Column, b: str,
                     bucket: Column, timeout_s: float, poll_s: float, asof: Column, salts: int = SALTS) -> DataFrame:
    """T2 from ``buckets`` (:func:`run_aggregates` by key and ``b``) and the
    single ``rows``: ends in later buckets come from the aggregates, and only
    the ends in the bucket of the start are compared with it one by one, dealt
    to ``salts`` parts like those of :func:`first_success_from`."""
    cut_us = cut_micros(timeout_s, poll_s)
    whole = Window.partitionBy(key)  # over buckets, not rows
    begin_at = F.min(F.when(F.col("begin").isNotNull(), F.col(b))).over(whole)
    per_key = (buckets.withColumn("at", begin_at)
               .withColumn("later", F.min(F.when(F.col(b) > F.col("at"), F.col("end_ts"))).over(whole))
               .where(F.col(b) == F.col("at"))
               .select(key, b, F.col("begin")["ts"].alias("_ff_ts"), F.col("begin")["tie"].alias("_ff_tie"), "later"))
    met = meet_by_bucket(per_key, rows.where(end), key, ts, tie, b, bucket, salts)
    after = F.col("row") > F.struct(F.col("_ff_ts").alias("ts"), F.col("_ff_tie").alias("tie"))
    j = (met.groupBy(key).agg(F.min("_ff_ts").alias("start_ts"), F.min("later").alias("later"),
                              F.min(F.when(after, F.col("row")["ts"])).alias("inside"))
         .select(key, "start_ts", F.coalesce("inside", "later").alias("end_ts")))
    elapsed = micros_between("start_ts", "end_ts")
    waited = micros_between(F.col("start_ts"), asof)
    status = (F.when(F.col("end_ts").isNotNull() & (elapsed <= cut_us), F.lit("finished"))
              .when(F.col("end_ts").isNotNull() | (waited >= cut_us), F.lit("timed_out"))
              .otherwise(F.lit("running")))
    return j.withColumn("status", status)


def run_timeout(df: DataFrame, key: str, ts: str, tie: str, start: Column, end: Column,
                timeout_s: float, poll_s: float = 1.0, asof: Column | None = None,
                bucket: Column | None = None) -> DataFrame:
    """Run-with-timeout status per entity.

    A run starts at the entity's first ``start`` row and ends at the first
    ``end`` row after it.  The reference checks the clock only after each
    ``poll_s`` sleep, so a run is cut at ``ceil(timeout/poll) * poll``
    seconds: ``finished`` when it ended by then, ``timed_out`` when it did
    not and that time has passed at ``asof``, else ``running``.  ``asof``
    defaults to the latest timestamp in ``df`` (a scalar subquery);
    ``bucket`` as in :func:`first_success`.
    """
    b = day_bucket(ts) if bucket is None else bucket
    buckets = df.groupBy(F.col(key), b.alias("_ff_b")).agg(*run_aggregates(ts, tie, start, end))
    asof = asof if asof is not None else df.select(F.max(ts)).scalar()
    return run_timeout_from(buckets, df, key, ts, tie, end, "_ff_b", b, timeout_s, poll_s, asof)


def latest_state(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """The newest record per entity (refetch by name)."""
    return last_wins(df, [key], order, cols)


def phase_durations(df: DataFrame, key: str, ts: str, tie: str,
                    bucket: Column | None = None) -> DataFrame:
    """T4: each phase's duration = time to the entity's next record
    (``lead``), for all but the last record.  ``bucket`` (e.g. the day of
    ``ts``) spreads a hot entity over tasks."""
    nxt = ordered.next_row(df, [key], [ts, tie], [ts], prefix="next_", bucket=bucket)
    nxt = nxt.where(F.col(f"next_{ts}").isNotNull())
    return nxt.withColumn("duration_us", micros_between(ts, f"next_{ts}"))


# Fixed value: the reference prefixes node messages with "[<node suffix>] ".
NODE_TAG_PATTERN = r"^\[([^\]]+)\] (.*?)(?: \.\.\.)?$"


def node_phase(message: str | Column) -> Column:
    """``struct(node, phase)`` of a node-tagged log message
    (``"[worker000] Rebooting ..."`` -> ``worker000``, ``Rebooting``);
    null for untagged messages.  The message is cut by place at its first
    ``]``; ``NODE_TAG_PATTERN`` says the same."""
    m = F.col(message) if isinstance(message, str) else message
    end = F.instr(m, "]")
    rest = F.substring(m, end + 2, F.length(m))
    phase = F.when(F.endswith(rest, F.lit(" ...")), F.substring(rest, F.lit(1), F.length(rest) - 4)).otherwise(rest)
    tagged = F.startswith(m, F.lit("[")) & (end > 2) & (F.substring(m, end + 1, F.lit(1)) == " ") & (F.instr(m, "\n") == 0)
    return F.when(tagged, F.struct(F.substring(m, F.lit(2), end - 2).alias("node"), phase.alias("phase")))


def provisioning_phases(records: DataFrame, logger: str = "logger", message: str = "message",
                        ts: str = "ts", bucket: Column | None = None, ranges: int | None = None) -> DataFrame:
    """T4 from parsed log records (see :mod:`fleetframe.sources.logs`): the
    node-tagged messages of each cluster (the logger name) and node, each
    phase lasting until that node's next message.  Messages with the same
    timestamp are ordered by text, so reruns agree.  ``ranges`` cuts the
    messages of all nodes into about so many ranges of their order (see
    :func:`fleetframe.plans.ordered.range_bucket`), so that few busy nodes are
    many tasks; ``bucket`` gives a bucket of one's own instead."""
    # A generator keeps what was parsed: a filter on a plain column would be moved
    # below the parsing and do it again for every use.
    tagged = (records.select(logger, ts, F.explode(F.array(node_phase(message))).alias("_ff_np"))
              .where(F.col("_ff_np").isNotNull())
              .select(F.col(logger).alias("cluster"), F.col("_ff_np")["node"].alias("node"),
                      F.col("_ff_np")["phase"].alias("phase"), F.col(ts).alias("ts")))
    if ranges is not None:
        tagged = ordered.range_bucket(tagged, ["cluster", "node"], ["ts", "phase"], ranges, out="_ff_range")
        bucket = F.col("_ff_range")
    nxt = ordered.next_row(tagged, ["cluster", "node"], ["ts", "phase"], ["ts", "phase"],
                           prefix="next_", bucket=bucket).drop("_ff_range")
    return nxt.withColumn("duration_us", micros_between("ts", "next_ts"))
