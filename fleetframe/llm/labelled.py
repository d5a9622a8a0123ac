"""Labelled rows that classifiers learn from.

``labelled_ids`` are all that may be learnt from.  ``training_rows`` is a
bounded sample of them, chosen by a hash of the id; the bound is a parameter.
The sampled ids are a table of bounded size, so joining them to the documents
may broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe.llm.common import col, cut, written

TRAIN_ROWS = 20_000


def remainder(key: Column, by: int) -> Column:
    """CRC-32 of the id's text, modulo ``by``; null for a null id."""
    return F.crc32(key.cast("string").cast("binary")) % by


def labelled_ids(labels: DataFrame, label: str, by: int, held_out: int, key: str = "doc_id") -> DataFrame:
    """(id, y) of all labelled ids that are not held out.

    Labels that repeat an id count by their mean (1 from a half on); null
    ids and null labels are left out.
    """
    return (labels.where(col(key).isNotNull() & col(label).isNotNull() & (remainder(col(key), by) != held_out))
            .groupBy(col(key).alias("id")).agg((F.avg(col(label)) >= 0.5).cast("int").alias("y")))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, by: int, held_out: int, key: str = "doc_id",
                  text: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, text, y) of at most ``rows`` ``labelled_ids``; those without a
    document are left out.  Of documents that repeat an id the one with the
    smallest text is learnt."""
    few = labelled_ids(labels, label, by, held_out, key).orderBy(F.xxhash64("id"), "id").limit(rows)
    few = F.broadcast(cut(few))  # at most ``rows`` rows of two numbers
    found = docs.select(col(key).alias("id"), col(text).alias("text")).join(few, "id")
    return written(found.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")))
