"""Readers for table snapshots.

Snapshots are Parquet folders.  Readers return lazy DataFrames; the
caller's ``select``/``where`` reach the scan as ``ReadSchema`` and
``PushedFilters``, so nothing here reads columns nobody asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TEST_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a snapshot folder: ``{base}/{name}.parquet``."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def read_snapshot(spark: SparkSession, path: str, schema: StructType | None = None,
                  fmt: str = "parquet") -> DataFrame:
    """A catalog or inventory snapshot with an explicit schema.

    The reference builds its columns by reflection at run time; Catalyst
    needs them at analysis time, so the schema is given up front
    (JSON snapshots) or taken from the Parquet footer.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


class Tables:
    """Lazy accessor: ``Tables(spark, dir).lineitem``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TEST_TABLES:
            raise AttributeError(name)
        return read_table(self.spark, self.base, name)


def lookup_options(name: str, names_per_file: int = 1_000_000, row_group: int = 8 << 20) -> dict[str, str]:
    """Options of a Parquet writer, batch or stream, for a snapshot that
    is looked up by ``name``: a Bloom filter of the names in every row group.

    An equality on ``name`` then skips the row groups (of ``row_group`` bytes)
    whose filter lacks it, also where names are in no order and each group's
    least and greatest name span them all.  ``names_per_file`` sizes the
    filters: about 10 bits a name at one error in a hundred.
    """
    return {f"parquet.bloom.filter.enabled#{name}": "true", f"parquet.bloom.filter.expected.ndv#{name}": str(names_per_file),
            "parquet.enable.dictionary": "false", "parquet.block.size": str(row_group)}


def write_lookup(df: DataFrame, path: str, name: str, names_per_file: int = 1_000_000, row_group: int = 8 << 20,
                 mode: str = "overwrite") -> None:
    """A snapshot with :func:`lookup_options`."""
    df.write.mode(mode).options(**lookup_options(name, names_per_file, row_group)).parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, mode: str = "overwrite") -> DataFrame:
    """A snapshot as the catalog table ``table``, dealt to ``buckets``
    files by a hash of ``keys`` and sorted by them.  Snapshots of equal buckets
    join on their keys without a shuffle on either side; one side alone spares
    its own.  Returns the table as it is read back.

    Rows are dealt before they are written, so a bucket is one file; its
    number should follow the size of the largest snapshot that is joined.
    """
    (df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table))
    return df.sparkSession.table(table)
