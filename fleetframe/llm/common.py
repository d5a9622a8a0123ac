"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.session import checkpoint_dir


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share."""
    return checkpoint_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written reliably to the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.  Unlike ``cut`` the
    reread table has its true size in bytes, by which Catalyst decides
    whether a join may broadcast it.  ``rows`` bounds the rows of a row group,
    of which Spark's reader holds up to 4,096 at once, however large."""
    path = f"{shared_dir(df.sparkSession)}/fleetframe-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.row.count.limit", rows) if rows else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def col(name: str) -> Column:
    """The top-level column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns of these names, whatever their case: an
    operator's output column replaces an input column of the same name."""
    gone = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in gone])


def append_columns(df: DataFrame, column: str, fields: Sequence[T.StructField],
                   make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """``df`` with ``fields`` computed from one column in Arrow batches.

    ``make`` runs once per task and returns the function of a batch.  No
    shuffle; batches are bounded by Spark's rows and bytes per Arrow batch.
    """
    base = without(df, *[f.name for f in fields])
    at = base.columns.index(column)
    names = [*base.columns, *[f.name for f in fields]]
    # mapInArrow can't read names with dots: columns go by their place meanwhile.
    base = base.toDF(*[f"_ff_{i}" for i in range(len(base.columns))])
    schema = T.StructType([*base.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *compute(b.column(at))], names=schema.names)

    return base.mapInArrow(run, schema).toDF(*names)


def range_prefix(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that
    come before the row in ``order``, equal rows not counted.

    The rows are range-partitioned by group and order, so a group with a
    third of all rows is spread over a third of the partitions.  Sums run
    within (partition, group); one row for each of those carries the sum
    of the partitions before it.
    """
    part, total, here, before, key = "_ff_part", "_ff_total", "_ff_here", "_ff_before", "_ff_key"
    r = cut(df.repartitionByRange(*[col(c) for c in (*group, *order)])
            .withColumn(out, value).withColumn(part, F.spark_partition_id()))
    keys = F.struct(F.col(part), *[col(c) for c in group])
    own = F.sum(out).over(Window.partitionBy(key).orderBy(*[col(c) for c in order]))
    same = F.sum(out).over(Window.partitionBy(key, *[col(c) for c in order]))
    local = r.withColumn(key, keys).withColumn(here, own - same)
    totals = r.groupBy(part, *[col(c) for c in group]).agg(F.sum(out).alias(total))
    w = Window.partitionBy(*[col(c) for c in group]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(keys.alias(key), F.coalesce(F.sum(total).over(w), F.lit(0)).alias(before))
    return (local.join(offsets, key).withColumn(out, F.col(here) + F.col(before))
            .drop(part, here, before, key))
