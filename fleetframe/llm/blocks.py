"""Vectors in blocks, and a set of query blocks shown to every block.

Vectors are packed into rows of up to some thousand; each block gets a slot.
The query blocks are copied once for each slot and joined on it, so every
vector block meets every query block, the vectors move once, and no task
holds more than a few blocks at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe.llm.common import col


def usable(vecs: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """(vec_id, v) rows that can take part: vectors of doubles without null
    or non-finite components, empty ones left out, zero ones where ``zero``
    is false, and null ids.  Of rows with equal ids the one with the largest
    vector stays (equal rows count once)."""
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = vecs.select(col(key).cast("bigint").alias("vec_id"), col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(sound, F.lit(False)))
    if not zero:
        rows = rows.where(F.exists(v, lambda x: x != 0.0))
    return rows.groupBy("vec_id").agg(F.max("v").alias("v"))


def slots(df: DataFrame) -> int:
    """Number of slots: as many as shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pack(rows: DataFrame, size: int, n_slots: int, extra: str = "",
         index: Callable[[np.ndarray], dict[str, bytes]] | None = None) -> DataFrame:
    """(slot, dim, n, ids, data, ...) blocks of up to ``size`` of the
    (vec_id, v) rows; ``index`` adds the columns named in ``extra``.  A third
    column of rows, lists of longs, becomes ``counts`` and ``copies``."""
    lists = len(rows.columns) > 2
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, seq = TaskContext.get().partitionId() * 7919, 0
        kept: dict[int, list[tuple]] = {}

        def block(dim: int) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            ids = np.concatenate([p[0] for p in kept[dim]])
            x = np.concatenate([p[1] for p in kept[dim]])
            copies = pa.concat_arrays([p[2] for p in kept[dim]]) if lists else None
            kept[dim] = []
            for a in range(0, len(ids), size):
                part = x[a:a + size]
                out = {"slot": (start + seq) % n_slots, "dim": dim, "n": len(part),
                       "ids": ids[a:a + size].tobytes(), "data": part.tobytes(), **(index(part) if index else {})}
                if lists:
                    some = copies.slice(a, len(part))
                    out["counts"] = some.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32).tobytes()
                    out["copies"] = some.flatten().to_numpy(zero_copy_only=False).tobytes()
                seq += 1
                yield pa.RecordBatch.from_pylist([out], schema=schema)

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            v = b.column(1)
            lengths = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths):
                rows_of = np.flatnonzero(lengths == dim)
                x = flat[(ends[rows_of] - dim)[:, None] + np.arange(dim)]
                kept.setdefault(int(dim), []).append((ids[rows_of], x, *([b.column(2).take(pa.array(rows_of))] if lists else [])))
                if sum(len(p[0]) for p in kept[int(dim)]) >= size:
                    yield from block(int(dim))
        for dim, parts in kept.items():
            if parts:
                yield from block(dim)

    fields = [("slot", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]
    added = [*extra.split(), *(["counts", "copies"] if lists else [])]
    fields += [(c, pa.binary()) for c in added]
    schema = pa.schema(fields)
    return rows.mapInArrow(run, "slot int, dim int, n int, ids binary, data binary"
                           + "".join(f", {c} binary" for c in added))


def search(blocks: DataFrame, queries: DataFrame, n_slots: int, each: Callable[[dict], tuple], score: str) -> DataFrame:
    """(query_id, vec_id, score) rows that ``each`` finds for one pair of a
    vector block and a query block (its columns begin with ``q_``)."""
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))).alias("slot"), "dim",
                       F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    kind = pa.int64() if score == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q_ids, ids, scores = each(b.slice(i, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids, pa.int64()), pa.array(ids, pa.int64()),
                                                  pa.array(scores, kind)], names=["query_id", "vec_id", "score"])

    return blocks.join(q, ["slot", "dim"]).mapInArrow(run, f"query_id long, vec_id long, score {score}")


def best(found: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` highest scores, ties to the smaller vec_id.  Spark
    keeps ``k`` rows of each query in a task before it shuffles them."""
    from pyspark.sql import Window
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def is_query(every: int) -> Column:
    return F.col("vec_id") % every == 0
