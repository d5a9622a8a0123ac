"""Quality classifier by Bradley-Terry pairwise ranking.

A good document is preferred to a bad one with a probability that is the
logistic function of the difference of their scores, and a score is linear
in the document's features.  The weights are learnt from preference pairs
of labelled documents by logistic loss on the difference of their features;
every labelled document that is not held out is in a pair at least.  The
threshold is the quantile of the learnt scores of all of them at the share of
bad documents; scores are then shifted so that it lies at ``CUT``.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.llm.common import append_columns, col, range_prefix, without, written
from fleetframe.llm.labelled import labelled_ids, remainder

CUT = 0.3  # a score from here on predicts a good document
PARTNERS = 32  # preference pairs of each document of the rarer kind
FEATURES = ("distinct", "repeats", "symbols", "bangs", "bars", "capitals", "lines", "packed", "words")
SYMBOLS = b"#$%&*+<=>@^_~{}\\"


def features(text: str) -> list[float]:
    """Shares that prose has in common and junk has not, each from 0 to 1
    (but for ``words``, a logarithm)."""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    n, size = max(1, len(words)), max(1, len(raw))
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    lines = [x for x in text.split("\n") if x]
    packed = min(1.0, len(zlib.compress(raw, 1)) / size)
    return [len(set(words)) / n if words else 1.0, sum(map(operator.eq, words, words[1:])) / n,
            min(1.0, sum(int(c[b]) for b in SYMBOLS) / n), min(1.0, int(c[33]) / n), min(1.0, 2 * int(c[124]) / n),
            upper / max(1, upper + lower), 1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
            packed, math.log1p(len(words))]


def _feature_column(docs: DataFrame, text: str, out: str) -> DataFrame:
    kind = pa.list_(pa.float64())

    def make():
        return lambda column: [pa.array([features(t or "") for t in column.to_pylist()], kind)]

    return append_columns(docs, text, [T.StructField(out, T.ArrayType(T.DoubleType()))], make)


@dataclass(frozen=True)
class Model:
    """Score = sigmoid(offset + weights . features)."""

    weights: tuple[float, ...]
    offset: float

    def score(self, x: Column) -> Column:
        s = linear(self.weights, x, self.offset)
        return F.when(s >= 0, 1 / (1 + F.exp(-s))).otherwise(F.exp(s) / (1 + F.exp(s)))


def linear(weights: Sequence[float], x: Column, offset: float = 0.0) -> Column:
    s = F.lit(offset)
    for i, w in enumerate(weights):
        s = s + F.lit(float(w)) * F.element_at(x, i + 1)
    return s


def pair_sums(diff: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number, gradient and Hessian of the logistic loss of feature
    differences, summed and laid out in one row."""
    p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # probability of the wrong order
    return np.concatenate([[len(diff)], diff.T @ p, ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()])


def newton(sums: Callable[[np.ndarray], np.ndarray], size: int, ridge: float = 1e-3) -> np.ndarray:
    """The weights at the least loss; ``sums`` gives the ``pair_sums`` of all
    pairs at some weights."""
    w = np.zeros(size)
    for _ in range(25):
        s = sums(w)
        grad = s[1:size + 1] / s[0] - ridge * w
        hess = s[size + 1:].reshape(size, size) / s[0] + ridge * np.eye(size)
        move = np.linalg.solve(hess, grad)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def bradley_terry(good: np.ndarray, bad: np.ndarray, partners: int = PARTNERS, ridge: float = 1e-3) -> np.ndarray:
    """Weights by Newton's method on the logistic loss of feature differences.
    Each document of the rarer kind meets ``partners`` of the other, and each
    of the other that none of them meets meets one."""
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    step = max(1, len(many) // partners)
    other = ((np.arange(len(few))[:, None] * 7 + np.arange(partners) * step) % len(many)).ravel()
    unmet = np.setdiff1d(np.arange(len(many)), other)
    diff = np.concatenate([many[other] - np.repeat(few, partners, axis=0), many[unmet] - few[unmet % len(few)]])
    diff = diff if few is bad else -diff
    return newton(lambda w: pair_sums(diff, w), diff.shape[1], ridge)


def fit_rows(x: np.ndarray, y: np.ndarray, cut: float = CUT) -> Model:
    """The model of labelled feature rows in memory, as ``fit`` learns it from
    tables.  Without rows of both kinds every document scores 0.5."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Model((0.0,) * len(FEATURES), 0.0)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    w = bradley_terry((good - mean) / spread, (bad - mean) / spread) / spread
    level = float(np.quantile(x @ w, len(bad) / len(x), method="midpoint"))
    return Model(tuple(map(float, w)), math.log(cut / (1 - cut)) - level)


def labelled_features(docs: DataFrame, labels: DataFrame, by: int, held_out: int, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """(id, y, x): the features of every labelled document that is not held
    out.  Of documents that repeat an id the one with the smallest text is
    learnt; texts are moved only where the features of such rows differ."""
    found = (docs.select(col(key).alias("id"), col(text).alias("text"))
             .where(F.col("id").isNotNull() & (remainder(F.col("id"), by) != held_out)))
    each = (_feature_column(found, "text", "x").groupBy("id")
            .agg(F.min("x").alias("x"), F.max("x").alias("last")))
    rows = written(each.join(labelled_ids(labels, "quality", by, held_out, key), "id"))
    alike, unlike = rows.where(F.col("x") == F.col("last")), rows.where(F.col("x") != F.col("last")).select("id", "y")
    if unlike.isEmpty():
        return alike.select("id", "y", "x")
    texts = found.join(unlike, "id").groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    return written(alike.select("id", "y", "x").unionByName(_feature_column(texts, "text", "x").drop("text")))


def preference_pairs(rows: DataFrame, good: int, bad: int, spread: np.ndarray, partners: int = PARTNERS) -> DataFrame:
    """The differences, good less bad, in units of ``spread``, of the pairs that
    ``bradley_terry`` makes of ``rows`` in the order of their ids."""
    rarer, n, m = (0, bad, good) if bad <= good else (1, good, bad)
    placed = written(range_prefix(rows, ["y"], ["id"], F.lit(1), "at"))
    few = placed.where(F.col("y") == rarer).select("at", F.col("x").alias("few"))
    many = placed.where(F.col("y") != rarer).select("at", F.col("x").alias("many"))
    step = max(1, m // partners)
    spots = F.array(*[(F.col("at") * 7 + j * step) % m for j in range(partners)])
    dealt = few.select(F.explode(spots).alias("at"), "few")
    unmet = many.join(dealt.select("at"), "at", "left_anti").withColumn("at", F.col("at") % n)
    pairs = many.join(dealt, "at").unionByName(unmet.join(few, "at"))
    plus, minus = ("many", "few") if rarer == 0 else ("few", "many")
    return written(pairs.select(F.array(*[(F.element_at(plus, i + 1) - F.element_at(minus, i + 1)) / F.lit(float(s))
                                          for i, s in enumerate(spread)]).alias("diff")))


def _summed(pairs: DataFrame, w: np.ndarray) -> np.ndarray:
    """``pair_sums`` of all pairs: one row of sums a task reaches the driver."""
    size = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + size + size * size)
        for b in batches:
            total += pair_sums(b.column(0).flatten().to_numpy().reshape(-1, size), w)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    found = pairs.mapInArrow(run, T.StructType([T.StructField("sums", T.ArrayType(T.DoubleType()))])).collect()
    return np.sum([r[0] for r in found], axis=0)


def fit(docs: DataFrame, labels: DataFrame, by: int = 5, held_out: int = 0, key: str = "doc_id",
        text: str = "text") -> Model:
    """Learn from all labelled documents that are not held out.  Only sums
    reach the driver, once for each step of Newton's method."""
    rows = labelled_features(docs, labels, by, held_out, key, text)
    size = len(FEATURES)
    n, good, *spread = rows.agg(F.count(F.lit(1)), F.sum("y"),
                                *[F.stddev_pop(F.element_at("x", i + 1)) for i in range(size)]).first()
    bad = n - (good or 0)
    if not good or not bad:
        return Model((0.0,) * size, 0.0)
    spread = np.array(spread) + 1e-6
    pairs = preference_pairs(rows, good, bad, spread)
    w = newton(lambda at: _summed(pairs, at), size) / spread
    # The middle between the scores of ranks bad - 1 and bad, from 0: where the share of bad documents ends.
    counts = rows.groupBy(linear(w, F.col("x")).alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    ranked = range_prefix(counts, [], ["raw"], F.col("n"), "before")
    level = (ranked.where((F.col("before") <= bad) & (F.col("before") + F.col("n") >= bad))
             .agg((F.min("raw") + F.max("raw")) / 2).first()[0])
    return Model(tuple(map(float, w)), math.log(CUT / (1 - CUT)) - level)


def classify(docs: DataFrame, model: Model, by: int = 5, held_out: int = 0, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``.

    Null texts score as empty ones; a null key is not held out.  Rows that
    repeat are scored each; output columns replace input columns of their
    names.  Texts are read whole, whatever their length; an empty table gives
    no rows; a score of exactly ``CUT`` predicts a good document.
    """
    out = without(docs, "held_out", "score", "predicted")
    return (_feature_column(out, text, "_ff_x")
            .withColumn("held_out", F.coalesce(remainder(col(key), by) == held_out, F.lit(False)))
            .withColumn("score", model.score(F.col("_ff_x")))
            .withColumn("predicted", (F.col("score") >= CUT).cast("int")).drop("_ff_x"))


def kept(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their
    columns.  Null texts are judged as empty ones, rows that repeat (and texts
    that do) alike, long texts whole; keys are not read; an empty table gives
    no rows, and a score of exactly ``CUT`` is kept."""
    scored = _feature_column(docs, text, "_ff_x")
    return scored.where(model.score(F.col("_ff_x")) >= CUT).drop("_ff_x")
