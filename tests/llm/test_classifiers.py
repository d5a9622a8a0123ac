import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetframe.llm import labelled, quality, toxicity
from tests.llm.cases import ROWS, documents

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))


def rates(scored, labels, label):
    """(kept of label 0 as 0, found of label 1) on the held-out rows."""
    rows = scored.where("held_out").join(labels, "doc_id").groupBy(label, "predicted").count().collect()
    n = {(r[0], r[1]): r[2] for r in rows}
    return n.get((0, 0), 0) / (n.get((0, 0), 0) + n.get((0, 1), 0)), n.get((1, 1), 0) / (n.get((1, 1), 0) + n.get((1, 0), 0))


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    out = quality.classify(docs, quality.fit(docs, labels))
    bad, good = rates(out, labels, "quality")
    assert bad > 0.95 and good > 0.99
    assert out.where("score < 0 or score > 1 or predicted <> int(score >= 0.3)").count() == 0


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    clean, toxic = rates(out, labels, "toxic")
    assert clean > 0.97 and toxic > 0.85
    assert out.where("score < 0 or score > 1 or predicted <> int(score >= 0.3)").count() == 0


def test_training_rows_leave_out_the_held_out(spark):
    docs = documents(spark, [(i, f"t{i}", "en", "a") for i in range(60)] + [(1, "again", "en", "a"), (None, "x", "en", "a")])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(70)] + [(None, 1, 0), (2, 1, 0), (2, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = {r.id: (r.text, r.y) for r in labelled.training_rows(docs, labels, "quality", 5, 0).collect()}
    want = {i for i in range(60) if zlib.crc32(str(i).encode()) % 5}
    assert set(got) == want
    assert got[1] == ("again", 1) and (2 not in want or got[2][1] == 1)
    assert labelled.training_rows(docs, labels, "quality", 5, 0, rows=7).count() <= 7


def test_bradley_terry_orders_the_kinds():
    r = np.random.default_rng(0)
    good, bad = r.normal([1, 0, 0], 1, (300, 3)), r.normal([-1, 0, 0], 1, (40, 3))
    w = quality.bradley_terry(good, bad)
    assert w[0] > 0.5 and abs(w[1:]).max() < w[0] / 2
    assert np.allclose(quality.bradley_terry(bad, good), -w, atol=0.3)


def test_models_without_labels(spark, edge_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        q = quality.classify(edge_docs, quality.fit(edge_docs, labels)).collect()
        t = toxicity.score(edge_docs, toxicity.fit(edge_docs, labels)).collect()
        assert len(q) == len(t) == len(ROWS) and {r.score for r in q} == {0.5}
        assert all(0 <= r.score <= 1 for r in t)


def test_edge_rows(spark, edge_docs, tables):
    docs, labels = tables
    for out in (quality.classify(edge_docs, quality.fit(docs, labels)), toxicity.score(edge_docs, toxicity.fit(docs, labels))):
        rows = out.collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
        assert out.columns.count("score") == 1 and "a.b" in out.columns
        same = {r.score for r in rows if r.text == ROWS[0][1]}
        assert len(same) == 1
    empty = documents(spark, [])
    assert quality.classify(empty, quality.fit(empty, labels)).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_scores_do_not_see_ids_or_sources(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    a = {r.text: r.score for r in quality.classify(docs.limit(50), model).collect()}
    b = {r.text: r.score for r in quality.classify(docs.limit(50).withColumn("doc_id", F.col("doc_id") + 7), model).collect()}
    assert a == b


def test_obfuscated_words():
    assert toxicity.plain("St*pid!") == ("stpid", True) or toxicity.plain("1d1ot")[0] == "idiot"
    assert toxicity.plain("1d1ot") == ("idiot", True)
    assert toxicity.plain("Word,") == ("word", False) and toxicity.plain("...")[0] == ""
