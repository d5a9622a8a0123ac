"""Approximate nearest neighbours by largest inner product: a permutation
index.

A bounded sample of the vectors serves as pivots.  Every vector is
represented by the list of its nearest pivots in order and posted, with its
place in that order, in the inverted file of each of them.  A query reads
the inverted files of its own nearest pivots, adds up the footrule distance
of the two orders (absolute difference of places; a pivot missing from one
order stands behind its end), and the best share of every block is reranked
by the exact measure.

The index is kept in blocks of vectors, each with its own inverted files, as
search engines keep theirs in segments: it is spread over all tasks, and
each block's candidates are reranked where they lie.  As a list names half
of the pivots, an inverted file holds one byte for every vector of its block,
the pivot's place in that vector's list, which is less than the ids would
take.

Equal vectors are one entry, so copies of one vector take neither pivots nor
places in the reranked share.  An entry carries the smallest ids of its
copies, as many as a query can return, and a found entry stands for these.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetframe.llm.blocks import best, is_query, pack, search, slots, usable
from fleetframe.llm.common import written

PIVOTS = 256  # vectors sampled by a hash of their id; bounds what the driver holds
NEAREST = 128  # length of a vector's list, 255 at most
SHARE = 0.08  # of a block that is reranked
LEAST = 200  # vectors of a block that are reranked at least
BLOCK_ROWS = 4096
QUERY_ROWS = 1024


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors with one more component, whose angles to a query order
    the vectors by their inner product with it."""
    x = x / longest
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x, x)))[:, None]])


def _orders(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The n nearest pivots of each vector, nearest first."""
    near = x @ pivots.T
    first = np.argpartition(-near, n - 1, axis=1)[:, :n]
    return np.take_along_axis(first, np.argsort(-np.take_along_axis(near, first, 1), axis=1, kind="stable"), 1)


def _entries(rows: DataFrame, n: int) -> DataFrame:
    """(vec_id, v, copies) of the different vectors: the smallest id and the
    ``n`` smallest in order.  Spark keeps ``n`` rows of each vector in a task
    before it shuffles them."""
    w = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
    return (few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("copies"))
            .select(F.col("copies")[0].alias("vec_id"), "v", "copies"))


def nearest(vecs: DataFrame, every: int, k: int, key: str = "vec_id", vector: str = "embedding",
            pivots: int = PIVOTS, length: int = NEAREST, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible
    by ``every``, the ``k`` rows found with the largest inner product, in
    doubles on the original vectors, ties to the smaller id.

    Recall is measured against brute force in the tests.  A query meets
    vectors of its own number of components, never its own id.  Rows with
    null ids, null, empty or zero vectors, null or non-finite components
    take no part; rows with equal ids count once.  Fewer than ``k``
    candidates: all of them.  An empty table gives no rows.
    """
    rows = written(usable(vecs, key, vector, zero=False))
    entries = written(_entries(rows, k + 1))  # one more: a query is not its own neighbour
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    top = {r[0]: float(np.sqrt(r[1])) for r in entries.groupBy(F.size("v")).agg(F.max(norm2)).collect()}
    sample: dict[int, np.ndarray] = {}
    for dim in top:
        few = entries.where(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
        sample[dim] = _lifted(np.array([r["v"] for r in few]), top[dim])
    n_slots = slots(vecs)

    def index(x: np.ndarray) -> dict[str, bytes]:
        piv = sample[x.shape[1]]
        n = min(length, len(piv))
        orders = _orders(_lifted(x, top[x.shape[1]]), piv, n)
        files = np.full((len(piv), len(x)), n, np.uint8)
        files[orders, np.arange(len(x))[:, None]] = np.arange(n, dtype=np.uint8)
        return {"files": files.tobytes()}

    def each(pair: dict) -> tuple:
        dim, n_rows = pair["dim"], pair["n"]
        piv = sample[dim]
        n = min(length, len(piv))
        ids, q_ids = np.frombuffer(pair["ids"], np.int64), np.frombuffer(pair["q_ids"], np.int64)
        counts, copies = np.frombuffer(pair["counts"], np.int32), np.frombuffer(pair["copies"], np.int64)
        firsts = np.cumsum(counts) - counts
        x = np.frombuffer(pair["data"]).reshape(-1, dim)
        qs = np.frombuffer(pair["q_data"]).reshape(-1, dim)
        files = np.frombuffer(pair["files"], np.uint8).reshape(len(piv), n_rows)
        own_places = np.arange(n, dtype=np.uint8)[:, None]
        lifted = np.hstack([qs / np.linalg.norm(qs, axis=1)[:, None], np.zeros((len(qs), 1))])
        orders = _orders(lifted, piv, n)
        take = min(n_rows, max(LEAST, 4 * k, int(np.ceil(share * n_rows))))
        out_q, out_v, out_s = [], [], []
        for q_id, q, order in zip(q_ids, qs, orders):
            # |a - b| is 2 max(a, b) - a - b, and the places of every whole list add up to the same.
            footrule = np.maximum(files[order], own_places).sum(axis=0, dtype=np.uint16)
            near = np.argpartition(footrule, take - 1)[:take] if take < n_rows else np.arange(n_rows)
            scores = (x[near] * q).sum(axis=1)
            top_of = np.lexsort((ids[near], -scores))[:k + 1]  # the query's own entry may be among them
            near, scores = near[top_of], scores[top_of]
            sizes = counts[near]
            found = copies[np.repeat(firsts[near] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            scores = np.repeat(scores, sizes)
            found, scores = found[found != q_id], scores[found != q_id]
            top_of = np.lexsort((found, -scores))[:k]
            out_q += [int(q_id)] * len(top_of)
            out_v += found[top_of].tolist()
            out_s += scores[top_of].tolist()
        return out_q, out_v, out_s

    blocks = pack(entries, BLOCK_ROWS, n_slots, "files", index)
    queries = pack(rows.where(is_query(every)), QUERY_ROWS, n_slots)
    return best(search(blocks, queries, n_slots, each, "double"), k)
