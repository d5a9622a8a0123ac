"""The quality model is learnt from every labelled row that is not held out."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetframe.llm import labelled, quality

TABLES = "doc_id long, text string", "doc_id long, quality int, toxic int"


def plain(rows, labels):
    """The model of (id, text) and (id, y) rows whose ids are not held out."""
    y = {i: q for i, q in labels if zlib.crc32(str(i).encode()) % 5}
    text = {}
    for i, t in rows:
        if i in y:
            text.setdefault(i, []).append(t)
    ids = sorted(text)
    first = {i: min((t for t in text[i] if t is not None), default="") for i in ids}
    return quality.fit_rows(np.array([quality.features(first[i]) for i in ids]), np.array([y[i] for i in ids])), len(ids)


def close(model, want):
    assert model.weights == pytest.approx(want.weights, rel=1e-6, abs=1e-9)
    assert model.offset == pytest.approx(want.offset, rel=1e-6)


def test_more_labels_than_a_sample_holds(spark):
    n = labelled.TRAIN_ROWS * 13 // 10
    junk = (F.col("id") % 9 == 0) | (F.col("id") % 31 == 5)
    words = F.concat_ws(" ", F.lit("some"), F.col("id") % 101, F.lit("words"), F.col("id") % 7)
    docs = spark.range(n).select(F.col("id").alias("doc_id"),
                                 F.when(junk, F.concat(words, F.lit(" ## | !!"))).otherwise(words).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 10 != 0).cast("int").alias("quality"))
    rows = [tuple(r) for r in docs.collect()]
    want, learnt = plain(rows, [tuple(r) for r in labels.collect()])
    assert learnt > labelled.TRAIN_ROWS
    close(quality.fit(docs, labels), want)


def test_rows_that_repeat_an_id(spark):
    rows = [(i, f"text {i % 11} of words {i}") for i in range(300)] + [(i, f"A {i} | ##") for i in range(0, 300, 3)]
    rows += [(i, None) for i in range(0, 300, 4)] + [(i, f"text {i % 11} of words {i}") for i in range(0, 300, 5)] + [(None, "x")]
    rows += [(i, None) for i in range(400, 420)]
    labels = [(i, int(i % 6 != 0)) for i in range(420)]
    model = quality.fit(spark.createDataFrame(rows, TABLES[0]),
                        spark.createDataFrame([(*r, 0) for r in labels] + [(None, 1, 0), (7, None, 0)], TABLES[1]))
    close(model, plain(rows, labels)[0])


@pytest.mark.parametrize("rare", [0, 1])
def test_every_labelled_document_is_in_a_pair(spark, rare):
    few, many = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5][::100], range(900)
    rows = [(i, f"text {i % 13} of {i % 17} words" + " more" * (i % 3) + (" #|" if i in few else "")) for i in many]
    labels = [(i, rare if i in few else 1 - rare) for i in many]
    docs = spark.createDataFrame(rows, TABLES[0])
    table = spark.createDataFrame([(*r, 0) for r in labels], TABLES[1])
    x = quality.labelled_features(docs, table, 5, 0)
    n, m = x.where(F.col("y") == rare).count(), x.where(F.col("y") != rare).count()
    assert 0 < n and m > n * quality.PARTNERS
    good, bad = (n, m) if rare else (m, n)
    ones = np.ones(len(quality.FEATURES))
    got = sorted(tuple(r[0]) for r in quality.preference_pairs(x, good, bad, ones).collect())
    kinds = {k: [np.array(r.x) for r in x.where(F.col("y") == k).orderBy("id").collect()] for k in (0, 1)}
    step, met = max(1, m // quality.PARTNERS), [(i, (i * 7 + j * max(1, m // quality.PARTNERS)) % m)
                                                for i in range(n) for j in range(quality.PARTNERS)]
    pairs = met + [(p % n, p) for p in sorted(set(range(m)) - {p for _, p in met})]
    assert step > 1 and {p for _, p in pairs} == set(range(m))
    want = [(kinds[rare][i] - kinds[1 - rare][p]) * (1 if rare else -1) for i, p in pairs]
    assert len(got) == len(want) and np.allclose(got, sorted(map(tuple, want)), atol=1e-12)
    close(quality.fit(docs, table), plain(rows, labels)[0])


def test_a_pair_that_the_rarer_kind_does_not_make():
    r = np.random.default_rng(3)
    good, bad = r.normal([1, 0], 1, (500, 2)), r.normal([-1, 0], 1, (2, 2))
    w = quality.bradley_terry(good, bad)
    for p in range(len(good)):
        other = good.copy()
        other[p, 1] += 5
        assert np.abs(quality.bradley_terry(other, bad) - w).max() > 1e-11


def test_threshold_is_the_exact_quantile(spark):
    """Scores tie, so ranks fall inside groups of equal scores."""
    rows = [(i, "a b c d" if i % 4 else "a a | #") for i in range(200)]
    labels = [(i, int(i % 4 != 0)) for i in range(200)]
    model = quality.fit(spark.createDataFrame(rows, TABLES[0]), spark.createDataFrame([(*r, 0) for r in labels], TABLES[1]))
    close(model, plain(rows, labels)[0])
    ends = {t: float(np.dot(model.weights, quality.features(t))) for _, t in rows}
    assert model.offset == pytest.approx(math.log(0.3 / 0.7) - sum(ends.values()) / 2)
