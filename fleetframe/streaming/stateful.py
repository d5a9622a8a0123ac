"""Structured Streaming forms of the polling operators.

The reference polls one node in a loop; here a stream of attempts for many
entities is reduced by native streaming aggregates per entity and time
bucket, without any Python state.  Results are written with ``foreachBatch``
as an upsert log (one row per group per micro-batch that changed it) under
the shared checkpoint folder; :func:`read_upserts` folds the log to the
latest row per group.  What follows is the second half of the batch
operators in :mod:`fleetframe.operators.lifecycle`: whole buckets come from
the folded log, and only the rows of an entity's deciding bucket are read
from the source itself.

``watermark`` is the most that rows may come out of order, and has no default.
Rows that come later than that for a closed bucket are dropped and a bucket's
state with them, so it must exceed the disorder of the source; to replay a
table, whose files come in no order, it must exceed the table's time span.

In append mode (:func:`run_closed`) a bucket is written once, when the
watermark has passed its end, and its state is gone from then on; what is
written needs no folding.  Event time only moves when rows come.  A source
that can fall silent gets a clock beside it (:func:`with_clock`): a stream of
plain times whose rows move the watermark and belong to no entity.
:func:`replay_closed` replays a table that way: first its rows in any order,
then one tick that closes everything up to the table's last time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from fleetframe.operators import lifecycle
from fleetframe.operators.keyed import last_wins
from fleetframe.session import checkpoint_dir

REPLAY = "36500 days"  # a watermark beyond any table's time span
BUCKET = "1 day"


TICK = "_ff_tick"  # marks the rows of a clock


def with_clock(events: DataFrame, clock: DataFrame, ts: str) -> DataFrame:
    """The rows of both streams; of ``clock`` only its ``ts``."""
    ticks = clock.select(F.col(ts).cast(events.schema[ts].dataType).alias(ts), F.lit(True).alias(TICK))
    return events.withColumn(TICK, F.lit(False)).unionByName(ticks, allowMissingColumns=True)


def _timed(events: DataFrame, ts: str, watermark: str) -> DataFrame:
    """``events`` with ``event_ts`` and a watermark on it."""
    return events.withColumn("event_ts", F.timestamp_micros(epoch_micros(events, ts))).withWatermark("event_ts", watermark)


def _by_window(events: DataFrame, key: str, ts: str, aggregates: Sequence[Column], watermark: str, width: str) -> DataFrame:
    """``aggregates`` per key and time bucket ``_ff_w``.  Ticks are groups of their
    own, told by an aggregate: a filter on a plain column would be moved below
    the watermark, which must see them."""
    src, window = _timed(events, ts, watermark), F.window("event_ts", width).alias("_ff_w")
    if TICK not in events.columns:
        return src.groupBy(key, window).agg(*aggregates)
    return (src.groupBy(key, TICK, window).agg(*aggregates, F.bool_or(TICK).alias("_ff_none"))
            .where(~F.col("_ff_none")).drop(TICK, "_ff_none"))


def bucket_stream(events: DataFrame, key: str, ts: str, aggregates: Sequence[Column],
                  watermark: str, width: str = BUCKET, out: str = "_ff_b") -> DataFrame:
    """``aggregates`` per key and time bucket of a stream, for update mode or,
    closed buckets only, append mode.  The bucket's start is ``out``, in wall-clock time like ``ts``; day-wide
    buckets are those of :func:`fleetframe.operators.lifecycle.day_bucket`."""
    grouped = _by_window(events, key, ts, aggregates, watermark, width)
    start = from_epoch_micros(F.unix_micros(F.col("_ff_w")["start"]))
    return grouped.withColumn(out, start).drop("_ff_w")


def last_millisecond(buckets: DataFrame, last: str = "last_ts") -> Column:
    """The latest event time of a folded log, in whole milliseconds."""
    return buckets.select(F.date_trunc("millisecond", F.max(last))).scalar()


def settled(result: DataFrame, asof: Column, success: str = "success_ts") -> DataFrame:
    """The rows of a first-success result that can change no more once every
    row up to ``asof`` has been seen: those that succeeded before it."""
    return result.where(F.col(success) < asof)


EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch; wall-clock for TIMESTAMP_NTZ."""
    if isinstance(df.schema[ts].dataType, TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), F.col(ts))
    return F.unix_micros(F.col(ts))


def from_epoch_micros(us: str | Column) -> Column:
    """TIMESTAMP_NTZ from wall-clock micros (inverse of :func:`epoch_micros`)."""
    return F.timestamp_add("MICROSECOND", us if isinstance(us, Column) else F.col(us),
                           F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


def latest_state_stream(events: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """T3 on a stream: the newest record per key, as a streaming
    aggregate (``max_by`` over the order struct) in update mode."""
    best = F.max_by(F.struct(*cols), F.struct(*order)).alias("_ff_last")
    return (events.groupBy(key).agg(best)
            .select(key, *[F.col("_ff_last")[c].alias(c) for c in cols]))


def closed_state_stream(events: DataFrame, key: str, ts: str, order: list[str], cols: list[str],
                        watermark: str, width: str = BUCKET) -> DataFrame:
    """T3 on a stream with bounded state: the newest record per key and time
    bucket, for append mode.  A key's state is gone when the watermark passes
    its bucket; the newest record of all is the last of the written ones
    (:func:`fleetframe.operators.keyed.last_wins` by ``order``)."""
    best = F.max_by(F.struct(*cols), F.struct(*order)).alias("_ff_last")
    return (_by_window(events, key, ts, [best], watermark, width)
            .select(key, *[F.col("_ff_last")[c].alias(c) for c in cols]))


def timer_stream(events: DataFrame, key: str, ts: str, start: Column, end: Column, timeout_s: float, poll_s: float,
                 watermark: str) -> DataFrame:
    """T2 on a stream with a timer in event time, for append mode: each run is
    written when the watermark passes its cut-off, as ``finished`` or
    ``timed_out``, without a further row of its entity; then its state is gone.

    A run is a session whose gap is the time to the cut-off after a start and
    nothing after an end: it opens with a start and stays open until the
    cut-offs of all starts within it have passed (a start during a run belongs
    to it).  ``start_ts`` is the first start, ``end_ts`` the first end from then
    on, if any, ``closed_ts`` the session's end.  Ends outside a run are none.
    """
    return runs_of_sessions(_timed(events, ts, watermark), key, ts, "event_ts", start, end, timeout_s, poll_s)


def runs_of_sessions(rows: DataFrame, key: str, ts: str, event_ts: str, start: Column, end: Column, timeout_s: float,
                     poll_s: float) -> DataFrame:
    """The runs of :func:`timer_stream`, of a stream or a table.  Rows that
    neither start nor end a run (ticks among them) have no gap and no session,
    but a stream's watermark has seen them."""
    cut_us = lifecycle.cut_micros(timeout_s, poll_s)
    gap = F.when(start, f"{cut_us} microseconds").when(end, "1 microsecond")
    runs = (rows.groupBy(key, F.session_window(event_ts, gap).alias("_ff_w"))
            .agg(F.min(F.when(start, F.col(ts))).alias("start_ts"), F.min(F.when(end, F.col(ts))).alias("end_ts"))
            .where(F.col("start_ts").isNotNull()))
    in_time = lifecycle.micros_between("start_ts", "end_ts") <= cut_us
    return runs.select(key, "start_ts", "end_ts", F.when(in_time, "finished").otherwise("timed_out").alias("status"),
                       from_epoch_micros(F.unix_micros(F.col("_ff_w")["end"])).alias("closed_ts"))


def run_closed(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Start the stream with a Parquet sink in append mode: every group is
    written once, when the watermark has passed it.  The sink's own log makes a
    replayed batch write nothing twice."""
    writer = (stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
              .option("path", path).format("parquet"))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def replay_closed(make: Callable[[DataFrame], DataFrame], events: DataFrame, table: DataFrame, ts: str, name: str) -> DataFrame:
    """The closed groups of ``make`` over the stream ``events`` of a whole table.

    The table's files come in no order, so ``make`` must take ``REPLAY`` as its
    watermark.  When all have been read, one tick ``REPLAY`` after the table's
    last time moves the watermark to that time, and what ends by it is written.
    """
    spark = events.sparkSession
    out, checkpoint = stream_workdir(spark, name)
    clock = f"{out}-clock"
    last = from_epoch_micros(epoch_micros(table, ts))
    tick = table.agg(F.max(last).alias("t")).select((F.col("t") + F.expr(f"INTERVAL {REPLAY}")).alias(ts))
    tick.limit(0).write.parquet(clock)
    stream = make(with_clock(events, spark.readStream.schema(tick.schema).parquet(clock), ts))
    run_closed(stream, out, checkpoint).awaitTermination()
    tick.write.mode("append").parquet(clock)
    run_closed(stream, out, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_upserts(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Start the stream with a ``foreachBatch`` sink that appends each
    micro-batch's changed rows, tagged with ``_batch_id``, to ``path``.
    Re-running a batch after a failure rewrites the same rows (the batch
    id is part of the data, and readers keep the latest), so the sink is
    idempotent."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("_batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").parquet(f"{path}/batch={batch_id}"))

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def read_upserts(spark: SparkSession, path: str, keys: list[str], snapshot: str | None = None) -> DataFrame:
    """Fold an upsert log to the latest row per key; with ``snapshot``
    (written by :func:`compact_upserts`), only batches after it are read
    from the log."""
    log = spark.read.parquet(path)
    if snapshot is not None:
        snap = spark.read.parquet(snapshot)
        upto = snap.select(F.max("_batch_id")).scalar()
        log = log.where(F.col("_batch_id") > upto).drop("batch").unionByName(snap, allowMissingColumns=True)
    cols = [c for c in log.columns if c not in ("_batch_id", "batch")]
    return last_wins(log, keys, ["_batch_id"], cols)


def compact_upserts(spark: SparkSession, path: str, keys: list[str], snapshot: str) -> None:
    """Fold the upsert log into a snapshot table (latest row per key, with
    its batch id) in the shared folder, cutting the log's lineage; later
    reads start from the snapshot.  Old batch folders can then be
    removed by the owner of the log."""
    log = spark.read.parquet(path)
    cols = [c for c in log.columns if c not in ("batch",)]
    folded = last_wins(log, keys, ["_batch_id"], [c for c in cols if c not in keys])
    folded.write.mode("overwrite").parquet(snapshot)


def stream_workdir(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh (output, checkpoint) folders for one run under the shared
    checkpoint folder."""
    base = checkpoint_dir(spark)
    run = f"{base}/streams/{name}-{uuid.uuid4().hex[:12]}"
    return f"{run}/out", f"{run}/checkpoint"
