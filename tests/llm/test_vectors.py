import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetframe.llm import permindex, topk

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, 0.1) for i, v in rows], "vec_id long, embedding array<float>, label int, score double")


def sound(rows, zero):
    out = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or (not zero and not any(v)):
            continue
        v = [float(np.float32(x)) for x in v]
        out[i] = max(out.get(i, v), v)
    return out


def brute(rows, every, k, measure, zero):
    vecs = sound(rows, zero)
    out = []
    for q, x in sorted(vecs.items()):
        if q % every == 0:
            s = sorted(((-measure(x, y), i) for i, y in vecs.items() if i != q and len(y) == len(x)))[:k]
            out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return out


def whole(x, y):
    return sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(x, y))


def cloud(n, dim, seed):
    r = np.random.default_rng(seed)
    return [(i, [float(x) for x in r.standard_normal(dim)]) for i in range(n)]


EDGE = [(0, [1.0, 0.0]), (50, None), (100, []), (1, [0.0, 0.0]), (2, [None, 1.0]), (3, [NAN, 1.0]), (4, [INF, 1.0]),
        (None, [1.0, 1.0]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [0.5, 0.5]), (7, [2.0, 0.5]),
        (8, [1.0, 2.0, 3.0]), (150, [3.0, 1.0, 0.0]), (9, [-1.0, 0.0]), (200, [0.0, 0.0]), (-50, [0.3, -0.2])]


def test_exact_search_edge_rows(spark):
    got = topk.top_k(table(spark, EDGE), 50, 5).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute(EDGE, 50, 5, whole, True)


@pytest.mark.parametrize("dim", [3, 40])
def test_exact_search_matches_brute_force(spark, dim, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    rows = cloud(700, dim, dim) + [(1000 + i, [0.25] * dim) for i in range(30)]  # ties
    got = topk.top_k(table(spark, rows), 50, 5).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute(rows, 50, 5, whole, True)


def test_exact_search_of_huge_components(spark):
    rows = [(i, [x * 1e6, 3e6, -x]) for i, (_, (x,)) in enumerate(cloud(60, 1, 3))]
    rows += [(70, [1e12, 1e12, 1.0]), (71, [1e30, 0.0, 0.0]), (100, [2e12, -1.0, 0.5])]
    clamp = lambda x, y: max(-2 ** 63, min(2 ** 63 - 1, whole(x, y)))
    got = topk.top_k(table(spark, rows), 50, 5).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute(rows, 50, 5, clamp, True)


def test_exact_search_in_small_groups(spark, monkeypatch):
    """Many groups and tiles, bounds that spare pairs, equal vectors over all of them."""
    for name, value in (("BLOCK_ROWS", 64), ("QUERY_ROWS", 5), ("ROW_BYTES", 2_000), ("GROUP_BYTES", 20_000), ("SPARED", 0.2)):
        monkeypatch.setattr(topk, name, value)
    rows = [(i, [x * 4 / (1 + j) for j, x in enumerate(v)]) for i, v in cloud(900, 40, 9)]
    rows += [(2000 + 3 * i, rows[50][1]) for i in range(60)] + [(3000 + i, [0.25] * 40) for i in range(30)]
    rows += [(4000 + i, [200.0 * x for x in rows[i][1]]) for i in range(0, 60, 3)] + [(5000, rows[50][1][:7])]
    got = topk.top_k(table(spark, rows), 50, 5).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute(rows, 50, 5, whole, True)


def test_bound_spares_pairs_and_changes_no_row():
    r = np.random.default_rng(4)
    x = np.floor(256 * r.standard_normal((6000, 48)) / np.arange(1, 49)).astype(np.int16)
    ids = np.arange(6000) * 5
    out, tried = [], []
    for bounds in (True, False):
        q = topk._Queries(ids[::60], x[::60], 5)
        bound = q._bound
        q._bound = lambda *a, bound=bound: (tried.append(bound(*a)), tried[-1])[1]
        q.again = 1 if bounds else 10 ** 9
        for tile in topk._tiles([(ids[a::7], x[a::7]) for a in range(7)]):
            q.meet(tile)
        out.append([q.found.row.tolist(), q.found.ids.tolist(), q.found.scores.tolist()])
    assert out[0] == out[1] and any(tried)


@pytest.mark.parametrize("vectors, queries, most, want", [(0, 0, 12, 12), (1 << 20, 1 << 15, 12, 12), (1 << 31, 1 << 25, 600, 128),
                                                          (1 << 20, 1 << 19, 600, 4), (1 << 36, 1 << 30, 600, 2048)])
def test_groups_fit_a_task_and_copies_do_not_outgrow_the_vectors(vectors, queries, most, want):
    assert topk.groups(vectors, queries, most) == want


def test_tasks_of_exact_search_hold_one_packed_row_of_queries(spark, monkeypatch):
    """Neither a row nor what is held grows with the number of queries."""
    monkeypatch.setattr(topk, "ROW_BYTES", 1_000)
    batches = []
    monkeypatch.setattr(topk, "written", lambda df, *a: batches.append(df) or df)
    rows = cloud(2000, 16, 6)
    assert topk.top_k(table(spark, rows), 2, 1).count() == 1000
    sizes = [r[0] for r in batches[0].select(F.length("data")).collect()]
    assert len(sizes) >= 96 and max(sizes) <= 1_000


def dot(x, y):
    return float((np.array(x) * np.array(y)).sum())


def test_index_edge_rows_are_exact_when_few(spark):
    got = permindex.nearest(table(spark, EDGE), 50, 20).orderBy("query_id", "rank").collect()
    want = brute(EDGE, 50, 20, dot, False)
    assert [(r[0], r[1], r[2], round(r[3], 9)) for r in got] == [(*w[:3], round(w[3], 9)) for w in want]


def test_index_recall(spark):
    rows = cloud(6000, 64, 1)
    rows = [(i, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for i, v in rows]
    got = permindex.nearest(table(spark, rows), 20, 20).collect()
    x = np.array([v for _, v in rows], np.float32).astype(float)
    s = x[::20] @ x.T
    s[np.arange(len(s)), np.arange(0, len(x), 20)] = -9
    best = {(20 * q, int(v)) for q, r in enumerate(np.argsort(-s, axis=1)[:, :20]) for v in r}
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found) == len(best) and len(found & best) >= 0.9 * len(best)
    assert all(abs(r.score - s[r.query_id // 20, r.vec_id]) < 1e-9 for r in got)


def test_index_recall_with_a_third_of_the_rows_equal(spark):
    rows = cloud(6000, 64, 1)
    rows = [(i, rows[1][1] if i % 3 == 1 else v) for i, v in rows]
    rows = [(i, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for i, v in rows]
    x = np.array([v for _, v in rows], np.float32).astype(float)
    s = np.array([(x * q).sum(axis=1) for q in x[::20]])
    s[np.arange(len(s)), np.arange(0, len(x), 20)] = -9
    best = {20 * q: [int(v) for v in np.lexsort((np.arange(len(x)), -r))[:20]] for q, r in enumerate(s)}
    found = {}
    for r in permindex.nearest(table(spark, rows), 20, 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = [len(found[q] & set(v)) / 20 for q, v in best.items()]
    print("recall", sum(recall) / len(recall), min(recall))
    assert sum(recall) >= 0.95 * len(recall)
    # Of the copies, a copy's own neighbours are the smallest other ids.
    for q in (q for q in best if q % 3 == 1):
        assert found[q] == set([i for i in range(1, 6000, 3) if i != q][:20])


def test_index_recall_of_vectors_of_many_lengths(spark):
    rows = [(i, [x * (1 + i % 5) for x in v]) for i, v in cloud(3000, 16, 2)]
    got = permindex.nearest(table(spark, rows), 100, 20)
    want = {(w[0], w[2]) for w in brute(rows, 100, 20, dot, False)}
    assert len({(r.query_id, r.vec_id) for r in got.collect()} & want) >= 0.9 * len(want)


def test_empty_tables(spark):
    assert topk.top_k(table(spark, []), 50, 5).count() == 0
    assert permindex.nearest(table(spark, []), 20, 20).count() == 0
    assert permindex.nearest(table(spark, [(0, [1.0])]), 20, 20).count() == 0
