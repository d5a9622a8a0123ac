"""The two classifiers' queries against plain Python: features by loops, the
pairwise loss and its gradient, trees walked node by node, an isotonic fit by
pooling."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fleetframe.llm import quality, toxicity
from fleetframe.llm.labelled import training_rows
from fleetframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))


@pytest.fixture(scope="module")
def texts(tables):
    return {r.doc_id: r.text or "" for r in tables[0].collect()}


def learnt_ids(tables, label, by, held_out):
    rows = {}
    for r in tables[1].collect():
        if zlib.crc32(str(r.doc_id).encode()) % by != held_out and r[label] is not None:
            rows.setdefault(r.doc_id, []).append(r[label])
    return {i: int(sum(v) / len(v) >= 0.5) for i, v in rows.items()}


# --- quality ------------------------------------------------------------------------

def plain_quality(text):
    words, raw = text.split(), text.encode("utf-8", "replace")
    n = max(1, len(words))
    upper, lower = sum(b in range(65, 91) for b in raw), sum(b in range(97, 123) for b in raw)
    lines = [x for x in text.split("\n") if x]
    return [len(set(words)) / n if words else 1.0, sum(a == b for a, b in zip(words, words[1:])) / n,
            min(1.0, sum(raw.count(bytes([b])) for b in quality.SYMBOLS) / n), min(1.0, raw.count(b"!") / n),
            min(1.0, 2 * raw.count(b"|") / n), upper / max(1, upper + lower),
            1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
            min(1.0, len(zlib.compress(raw, 1)) / max(1, len(raw))), math.log1p(len(words))]


def pairwise_loss(w, good, bad, partners, ridge=1e-3):
    """The loss of the preference pairs, each of the rarer kind with its partners."""
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    step, total, n = max(1, len(many) // partners), 0.0, 0
    for i, x in enumerate(few):
        for j in range(partners):
            other = many[(i * 7 + j * step) % len(many)]
            d = (other - x) if few is bad else (x - other)
            total += math.log1p(math.exp(-float(d @ w)))
            n += 1
    return total / n + ridge / 2 * float(w @ w)


def test_quality_query_is_plain_python(spark, tables, texts):
    y = learnt_ids(tables, "quality", 5, 0)
    ids = sorted(i for i in y if i in texts)
    x, kind = np.array([plain_quality(texts[i]) for i in ids]), np.array([y[i] for i in ids])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / spread
    good, bad = z[kind == 1], z[kind == 0]
    w = quality.bradley_terry(good, bad)
    at = pairwise_loss(w, good, bad, quality.PARTNERS)
    for k in range(len(w)):  # no direction is better: the fit is at the bottom of the plain loss
        for eps in (1e-3, -1e-3):
            v = w.copy()
            v[k] += eps
            assert pairwise_loss(v, good, bad, quality.PARTNERS) >= at - 1e-9
    raw = {i: float(np.array(plain_quality(t)) @ (w / spread)) for i, t in texts.items()}
    level = float(np.quantile([raw[i] for i in ids], (kind == 0).sum() / len(ids), method="midpoint"))
    for r in QUERIES["op10_quality"](spark, SF).collect():
        s = 1 / (1 + math.exp(-max(-700, min(700, raw[r.doc_id] - level + math.log(0.3 / 0.7)))))
        assert r.score == pytest.approx(s, abs=1e-6)
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


# --- toxicity ------------------------------------------------------------------------

def plain_lexicon(rows):
    once = {}
    for t, y in rows:
        once[t] = max(once.get(t, 0), y)
    toxic, total = sum(once.values()), len(once)
    n, hit = Counter(), Counter()
    for t, y in once.items():
        for e in {e for w in t.split() for e in toxicity.entries(toxicity.plain(w)[0]) if len(e) > 1}:
            n[e] += 1
            hit[e] += y
    odds = {e: math.log((hit[e] + 0.5) / (toxic + 1)) - math.log((n[e] - hit[e] + 0.5) / (total - toxic + 1)) for e in n if hit[e] >= toxicity.LEAST_TEXTS}
    return dict(sorted(((e, o) for e, o in odds.items() if o > 2), key=lambda x: (-hit[x[0]] * x[1], x[0]))[:toxicity.LEXICON])


def plain_toxicity(text, lexicon):
    words, raw = text.split(), text.encode("utf-8", "replace")
    n = max(1, len(words))
    weight, odd, you = [], [], []
    for w in words:
        word, mixed = toxicity.plain(w)
        weight.append(max((lexicon.get(e, 0.0) for e in toxicity.entries(word)), default=0.0) if word else 0.0)
        odd.append(mixed)
        you.append(word in toxicity.SECOND)
    hits = [i for i, w in enumerate(weight) if w]
    gaps = [abs(i - j) for i in hits for j, u in enumerate(you) if u]
    top = sorted(weight[i] for i in hits)[-5:]
    upper, lower = sum(b in range(65, 91) for b in raw), sum(b in range(97, 123) for b in raw)
    return [float(len(hits)), len(hits) / n, sum(weight[i] for i in hits) / len(hits) if hits else 0.0, top[-1] if top else 0.0, sum(top),
            1 / (1 + min(gaps)) if gaps else 0.0, upper / max(1, upper + lower), sum(raw.count(c) for c in (b"!", b"?")) / n,
            sum(raw.count(bytes([c])) for c in b"#$%&*|@^~<>") / n, sum(odd) / n, sum(you) / n, math.log1p(len(words))]


def walked(node, x):
    """The prediction of one tree, node by node."""
    while node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


def pooled(points):
    """Isotonic values at each distinct raw score, by pooling adjacent violators."""
    groups = []
    for raw in sorted({p[0] for p in points}):
        mine = [y for r, y in points if r == raw]
        groups.append([[raw], sum(mine), len(mine)])
        while len(groups) > 1 and groups[-2][1] / groups[-2][2] >= groups[-1][1] / groups[-1][2]:
            last = groups.pop()
            groups[-1] = [groups[-1][0] + last[0], groups[-1][1] + last[1], groups[-1][2] + last[2]]
    return {r: s / n for raws, s, n in groups for r in raws}


def test_toxicity_query_is_plain_python(spark, tables, texts):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    y = learnt_ids(tables, "toxic", 4, 2)
    lexicon = plain_lexicon([(texts[i], y[i]) for i in y if i in texts])
    assert set(model.lexicon) == set(lexicon) and all(model.lexicon[e] == pytest.approx(o) for e, o in lexicon.items())
    trees, weights = model.trees._call_java("trees"), model.trees.treeWeights

    def raw(x):
        margin = sum(w * walked(t.rootNode(), x) for t, w in zip(trees, weights))
        return 1 / (1 + math.exp(-2 * margin))

    def calibrated(r):
        xs, ys = zip(*model.steps)
        return float(np.interp(r, xs, ys))

    out = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, SF).collect()}
    assert set(out) == set(texts)
    for i, t in list(texts.items()):
        want = calibrated(raw(plain_toxicity(t, lexicon)))
        assert out[i].score == pytest.approx(want, abs=1e-6) and out[i].predicted == int(out[i].score >= 0.3)
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_calibration_is_an_isotonic_fit(spark, tables):
    """The steps against pooling by hand, on the rows that the fit adjusted by."""
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    rows = training_rows(docs, labels, "toxic", 4, 2)
    fold = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(10))
    halves = [rows.where(fold % 2 == k) for k in (0, 1)]
    points = []
    for mine, other in ((0, 1), (1, 0)):
        x = toxicity._features(halves[mine].withColumn("fold", fold).where("fold >= 8"), "text", toxicity.learn_lexicon(halves[other]), "x")
        found = model.trees.transform(x.withColumn("features", toxicity.array_to_vector("x")))
        points += [(r.raw, r.y) for r in found.select(vector_to_array("probability")[1].alias("raw"), "y").collect()]
    want = pooled(points)
    xs, ys = zip(*model.steps)
    for raw, value in want.items():
        assert float(np.interp(raw, xs, ys)) == pytest.approx(value, abs=1e-9)
