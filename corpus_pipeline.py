"""A corpus pipeline: five stages over ``documents``, each written as Parquet
and read again as the next one's input.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns
of ``documents``; the last adds the encoded texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fleetframe.llm import mixing, pieces, pii, quality, simhash
from fleetframe.llm.common import shared_dir


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.  Null texts are
    judged as empty ones; rows that repeat are judged alike; other columns go
    along, whatever their names; without labels of both kinds all stay."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest
    id, null last, then fingerprint and text.  Null and blank texts are
    near-duplicates of each other; of rows equal in id and text one stays."""
    return simhash.without_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; null texts stay null,
    ``n_chars`` follows the text, and every row stays."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole rows, repeated; a null
    source is a source; tables without words give the rows of whole epochs."""
    return mixing.mixed(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces (null for a null text, none for an
    empty one); an input column ``pieces`` is replaced."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_texts),
]

# Trained models and vocabularies are beyond SQL: tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/fleetframe-pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
