"""Toxicity by gradient-boosted trees over dense features, with isotonic
calibration.

A lexicon is learnt from labelled texts: words, and beginnings of words, that
toxic texts hold far more often than others, with their log odds.  Features
are the densities of its hits, how near a hit stands to a word of the second
person, and the rates of capitals, punctuation and obfuscated spellings.
The labelled rows are dealt to two halves by a hash.  The trees learn each
half by the lexicon of the other, so that words which stand in toxic texts by
chance show as what they are; a fifth of the rows is kept for the
calibration.  Documents are scored by the lexicon of all labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.llm.common import append_columns, col, cut, without
from fleetframe.llm.labelled import TRAIN_ROWS, remainder, training_rows

CUT = 0.3
LEXICON = 3000  # entries at most; bounds what every task gets
BEGINNINGS = (4, 5, 6, 7)
LEAST_TEXTS = 4  # toxic texts that hold an entry
TREES, DEPTH = 20, 4
CACHED = 300_000
# Words of the second person in the languages at hand.
SECOND = frozenset("""you your yours yourself u ur du dich dir dein deine ihr euch euer eure sie ihnen
tu te toi ton ta tes vous votre vos ti tú usted ustedes su sus vosotros os""".split())
LEET = str.maketrans("013457@$!", "oieastasi")
FEATURES = ("hits", "density", "mean", "top", "sum", "near", "capitals", "bangs", "symbols", "obfuscated", "second", "length")


def plain(token: str) -> tuple[str, bool]:
    """A token in lower case without what stands around and between its
    letters, and whether its spelling was obfuscated."""
    t = token.lower().strip(".,;:!?\"'()[]{}*#$%&|-_")
    if t.isalpha():
        return t, False
    letters = "".join(c for c in t.translate(LEET) if c.isalpha())
    mixed = any(c in "013457@$!*._-" for c in t[1:-1]) and sum(c.isalpha() for c in t) * 2 >= len(t)
    return letters, mixed and len(letters) >= 3


def entries(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself and its beginnings."""
    return [word, *(word[:k] + "~" for k in BEGINNINGS if len(word) >= k)]


class _Tokens(dict):
    """Token to its lexicon weight; obfuscated tokens and words of the second
    person are noted besides."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.odd, self.you = lexicon, set(), set()

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHED:
            self.clear()
            self.odd.clear()
            self.you.clear()
        word, odd = plain(token)
        if odd:
            self.odd.add(token)
        if word in SECOND:
            self.you.add(token)
        found = self[token] = max((self.lexicon.get(e, 0.0) for e in entries(word)), default=0.0) if word else 0.0
        return found


def features(text: str, tokens: _Tokens) -> list[float]:
    """The dense features of a whole text."""
    words = text.split()
    n = max(1, len(words))
    w = np.fromiter(map(tokens.__getitem__, words), np.float64, len(words))
    at = np.flatnonzero(w)
    raw = text.encode("utf-8", "replace")
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    kinds = set(words)
    odd, you = kinds & tokens.odd, kinds & tokens.you
    near = 0.0
    if len(at) and you:
        second = np.array([i for i, x in enumerate(words) if x in you])
        right = np.clip(np.searchsorted(second, at), 0, len(second) - 1)
        gap = np.minimum(np.abs(second[right] - at), np.abs(second[np.maximum(right - 1, 0)] - at))
        near = float(1 / (1 + gap.min()))
    top = np.sort(w[at])[-5:]
    return [float(len(at)), len(at) / n, float(w[at].mean()) if len(at) else 0.0, float(top[-1]) if len(at) else 0.0,
            float(top.sum()), near, upper / max(1, upper + lower), int(c[33] + c[63]) / n,
            int(sum(c[b] for b in b"#$%&*|@^~<>")) / n, sum(map(odd.__contains__, words)) / n if odd else 0.0,
            sum(map(you.__contains__, words)) / n if you else 0.0, math.log1p(len(words))]


def _features(docs: DataFrame, text: str, lexicon: dict[str, float], out: str) -> DataFrame:
    kind = pa.list_(pa.float64())

    def make():
        tokens = _Tokens(lexicon)
        return lambda column: [pa.array([features(t or "", tokens) for t in column.to_pylist()], kind)]

    return append_columns(docs, text, [T.StructField(out, T.ArrayType(T.DoubleType()))], make)


def learn_lexicon(rows: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """The entries of labelled (text, y) rows with the largest log odds for
    toxic texts, by the number of texts that hold them; equal texts count
    once.  Entries are counted by partial aggregates."""
    kind = pa.list_(pa.string())

    def make():
        def of(text: str) -> list[str]:
            return sorted({e for w in set(text.split()) for e in entries(plain(w)[0]) if len(e) > 1})
        return lambda column: [pa.array([of(t or "") for t in column.to_pylist()], kind)]

    once = rows.groupBy("text").agg(F.max("y").alias("y"))
    total, toxic = once.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not toxic or toxic == total:
        return {}
    held = append_columns(once, "text", [T.StructField("entries", T.ArrayType(T.StringType()))], make)
    counts = (held.select(F.explode("entries").alias("e"), "y").groupBy("e")
              .agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).where(F.col("t") >= LEAST_TEXTS))
    odds = F.log((F.col("t") + 0.5) / float(toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / float(total - toxic + 1))
    best = (counts.withColumn("odds", odds).where(F.col("odds") > 2)
            .orderBy((F.col("t") * F.col("odds")).desc(), "e").limit(most))
    return {r["e"]: r["odds"] for r in best.collect()}


class Model:
    """A lexicon, trees and a calibration; or only a constant, where the
    labelled rows are of one kind."""

    def __init__(self, lexicon: dict[str, float], trees: GBTClassificationModel | None = None,
                 steps: Sequence[tuple[float, float]] = (), constant: float = 0.0) -> None:
        self.lexicon, self.trees, self.steps, self.constant = lexicon, trees, list(steps), constant

    def calibrated(self, raw: Column) -> Column:
        """Linear between the steps of the isotonic fit, flat outside."""
        score, (x0, y0) = F.lit(self.steps[0][1]), self.steps[0]
        for x1, y1 in self.steps[1:]:
            score = F.when(raw >= x1, F.lit(y1)).when(
                raw > x0, F.lit(y0) + (raw - x0) * ((y1 - y0) / (x1 - x0))).otherwise(score) if x1 > x0 else F.when(raw >= x1, F.lit(y1)).otherwise(score)
            x0, y0 = x1, y1
        return score


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select("id", "y", array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, by: int = 4, held_out: int = 2, rows: int = TRAIN_ROWS,
        key: str = "doc_id", text: str = "text") -> Model:
    """Learn from at most ``rows`` labelled documents that are not held out."""
    learnt = training_rows(docs, labels, "toxic", by, held_out, key, text, rows)
    fold = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(10))
    one, two = learnt.where(fold % 2 == 0), learnt.where(fold % 2 == 1)
    x = _features(one, "text", learn_lexicon(two), "x").union(_features(two, "text", learn_lexicon(one), "x"))
    x = cut(x.withColumn("fold", fold).drop("text").coalesce(4))
    lexicon = learn_lexicon(learnt)
    share = x.agg(F.avg("y")).first()[0]
    grow, adjust = _vectors(x.where(F.col("fold") < 8)), _vectors(x.where(F.col("fold") >= 8))
    if grow.select("y").distinct().count() < 2 or adjust.select("y").distinct().count() < 2:
        return Model(lexicon, constant=share or 0.0)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=5, maxBins=32).fit(grow)
    raw = trees.transform(adjust).select("label", vector_to_array("probability")[1].alias("raw"))
    iso = IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw)
    steps = list(zip(map(float, iso.boundaries), map(float, iso.predictions)))
    return Model(lexicon, trees, steps)


def score(docs: DataFrame, model: Model, by: int = 4, held_out: int = 2, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``.

    Null texts score as empty ones; a null key is not held out.  Rows that
    repeat are scored each; output columns replace input columns of their
    names.  Texts are read whole, whatever their length; an empty table gives
    no rows; a score of exactly ``CUT`` predicts a toxic document.
    """
    out = without(docs, "held_out", "score", "predicted")
    if model.trees is None:
        scored = out.withColumn("score", F.lit(float(model.constant)))
    else:
        inside = [c for c in out.columns]
        work = _features(out.select(*[col(c).alias(f"_ff_in_{i}") for i, c in enumerate(inside)]),
                         f"_ff_in_{inside.index(text)}", model.lexicon, "_ff_x")
        work = model.trees.transform(work.withColumn("features", array_to_vector("_ff_x")))
        work = work.withColumn("_ff_raw", vector_to_array("probability")[1])
        scored = work.select(*[F.col(f"_ff_in_{i}").alias(c) for i, c in enumerate(inside)],
                             model.calibrated(F.col("_ff_raw")).alias("score"))
    return (scored.withColumn("held_out", F.coalesce(remainder(col(key), by) == held_out, F.lit(False)))
            .withColumn("predicted", (F.col("score") >= CUT).cast("int")))
