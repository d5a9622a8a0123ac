"""Exact top-k by integer inner product: columnar branch and bound.

Vectors are packed into rows of bounded bytes, in the narrowest type that holds
their whole numbers, and dealt to groups of bounded bytes.  A task holds one
group and reads the packed queries, which are copied once for each group, one
row after the other, so its memory follows neither table.

A group is searched in tiles in the order of ids.  A tile's product with the
dimensions of most mass of a row of queries comes first; the others add at most
the product of the remaining Euclidean norms, after Cauchy-Schwarz, which is
one more column of the same product.  Only pairs whose bound beats the query's
k-th best score so far get their exact score.  Where a bound spares too few
pairs, the tile's scores come from one product of all dimensions.  A group
passes on ``k`` rows of each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.llm.blocks import best, is_query, slots, usable
from fleetframe.llm.common import written

SCALE = 256
BLOCK_ROWS = 2048  # vectors of a tile
QUERY_ROWS = 1024  # queries of a packed row at most
ROW_BYTES = 1 << 18  # of a packed row of more than one vector, at most
READ_ROWS = 64  # packed rows that a reader holds at once
GROUP_BYTES = 1 << 25  # of the vectors of a group, about
COPIES = 2  # the queries' copies are at most so many times the vectors' bytes, unless GROUP_BYTES asks for more groups
DIMENSIONS = 16  # left to the bound
SPARED = 1 / 256  # of a tile's pairs that may outlast the bound
SINGLE, EXACT = 2.0 ** 24, 2.0 ** 53
LONG = 2 ** 63 - 1

_PACKED = "asked boolean, place int, dim int, wide boolean, n int, ids binary, data binary"
_PACKED_ARROW = pa.schema([("asked", pa.bool_()), ("place", pa.int32()), ("dim", pa.int32()), ("wide", pa.bool_()),
                           ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of the vectors, and once more of those that are queries,
    from (vec_id, v, asked) rows.  ``place`` counts a task's rows, from a
    number that differs between tasks."""
    place = TaskContext.get().partitionId() * 7919
    kept: dict[tuple, list] = {}  # lists of ids and of vectors that wait for a full row

    def row(key: tuple) -> pa.RecordBatch:
        nonlocal place
        asked, dim, wide = key
        ids, x = (np.concatenate(p) for p in zip(*kept.pop(key)))
        place += 1
        out = (asked, place % (1 << 30), dim, wide, len(ids), ids.tobytes(), x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(out, _PACKED_ARROW)], schema=_PACKED_ARROW)

    for b in batches:
        ids, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        asked = b.column(2).to_numpy(zero_copy_only=False)
        lengths = np.diff(v.offsets.to_numpy())
        flat = np.floor(v.flatten().to_numpy(zero_copy_only=False))
        ends = np.cumsum(lengths)
        for dim in np.unique(lengths).tolist():
            of_dim = np.flatnonzero(lengths == dim)
            x = flat[(ends[of_dim] - dim)[:, None] + np.arange(dim)]
            is_wide = np.abs(x).max(axis=1) >= 2 ** 15
            for wide in (False, True):
                for twice in (False, True):
                    some = np.flatnonzero((is_wide == wide) & (asked[of_dim] | (not twice)))
                    size = max(1, min(QUERY_ROWS if twice else BLOCK_ROWS, ROW_BYTES // (dim * (8 if wide else 2))))
                    for a in range(0, len(some), size):
                        part = some[a:a + size]
                        key = (twice, dim, wide)
                        if key in kept and sum(len(p[0]) for p in kept[key]) + len(part) > size:
                            yield row(key)
                        kept.setdefault(key, []).append((ids[of_dim[part]], x[part].astype(np.float64 if wide else np.int16)))
    for key in list(kept):
        yield row(key)


class _Tile:
    """Vectors of one length, ids ascending."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x, self.most = ids, x, float(np.abs(x, dtype=np.float64).max())


def _tiles(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[_Tile]:
    """Tiles of the (ids, vectors) parts, ids ascending over all of them; the
    list of parts is emptied."""
    ids = np.concatenate([p[0] for p in parts])
    x = np.concatenate([p[1] for p in parts])
    parts.clear()
    order = np.argsort(ids, kind="stable")
    return [_Tile(ids[o], x[o]) for o in (order[a:a + BLOCK_ROWS] for a in range(0, len(order), BLOCK_ROWS))]


class _Best:
    """The ``k`` best (score, id) so far of each of ``n`` queries."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.n = k, n
        self.row, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.least = np.full(n, -np.inf)  # the k-th score; a later, greater id must beat it

    def add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        row, ids, scores = (np.concatenate(x) for x in ((self.row, row), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, ~scores, row))  # ~x falls as x grows, over all of 64 bits
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        order = order[keep]
        self.row, self.ids, self.scores = row[keep], ids[order], scores[order]
        last = rank[keep] == self.k - 1
        self.least[self.row[last]] = self.scores[last]


def _exact(tile: _Tile, q_ids: np.ndarray, q: np.ndarray, found: _Best) -> None:
    """All pairs in Python integers, for numbers beyond those of doubles."""
    own = [[int(x) for x in v] for v in tile.x]
    for i, one in enumerate(q):
        one = [int(x) for x in one]
        scores = np.array([max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(one, v)))) for v in own], np.int64)
        others = tile.ids != q_ids[i]
        found.add(np.full(int(others.sum()), i), tile.ids[others], scores[others])


def _candidates(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the scores that can be among a row's ``k`` best."""
    rows = np.flatnonzero(scores.max(axis=1) > least)
    some = scores[rows]
    above = some > least[rows, None]
    many = np.flatnonzero(above.sum(axis=1) > 4 * k)
    if len(many) and some.shape[1] > k:
        kth = np.partition(some[many], some.shape[1] - k, axis=1)[:, -k]
        above[many] &= some[many] >= kth[:, None]
    at, columns = np.nonzero(above)
    return rows[at], columns


class _Queries:
    """A packed row of queries of one length, ready for tiles."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q.astype(np.float64), k
        self.most = float(np.abs(self.q).max())
        self.found = _Best(len(ids), k)
        self.seen, self.again = 0, 1  # tiles, and the one after which bounds are tried
        self.typed: dict[type, tuple[np.ndarray, np.ndarray]] = {}
        order = np.argsort(-np.einsum("ij,ij->j", self.q, self.q), kind="stable")  # dimensions of most mass first
        self.head, self.rest = order[:-DIMENSIONS], order[-DIMENSIONS:]

    def of(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """The queries in floats or doubles; their first dimensions and the norms of the others."""
        if kind not in self.typed:
            rest = self.q[:, self.rest]
            norms = np.sqrt(np.einsum("ij,ij->i", rest, rest))
            self.typed[kind] = self.q.astype(kind), np.hstack([self.q[:, self.head], norms[:, None]]).astype(kind)
        return self.typed[kind]

    def meet(self, tile: _Tile) -> None:
        dim, found = self.q.shape[1], self.found
        bits = self.most * tile.most * dim
        if bits >= EXACT:
            _exact(tile, self.ids, self.q, found)
            return
        place = np.searchsorted(tile.ids, self.ids).clip(max=len(tile.ids) - 1)
        own = np.flatnonzero(tile.ids[place] == self.ids)
        self.seen += 1
        # Sums of whole numbers below these limits are exact in any order.
        kind = np.float32 if bits < SINGLE else np.float64
        if len(self.head) and self.seen > self.again:
            if self._bound(tile, own, place[own], bits, kind):
                return
            self.again = 2 * self.seen  # bounds spare more when better scores are known
        scores = self.of(kind)[0] @ tile.x.astype(kind).T
        scores[own, place[own]] = -np.inf
        rows, columns = _candidates(scores, found.least.astype(kind), self.k)
        if len(rows):
            found.add(rows, tile.ids[columns], scores[rows, columns].astype(np.int64))

    def _bound(self, tile: _Tile, own: np.ndarray, place: np.ndarray, bits: float, kind: type) -> bool:
        """Adds the tile's scores if the bound spares most of its pairs;
        ``bits`` is what no sum of products exceeds."""
        q, bounded = self.of(kind)
        x = tile.x.astype(kind)
        norms = np.sqrt(np.einsum("ij,ij->i", x[:, self.rest], x[:, self.rest]))
        bounds = bounded @ np.hstack([x[:, self.head], (norms * kind(1.0001))[:, None]]).T
        bounds[own, place] = -np.inf
        # The product rounds once a column, by half an eps of the sum at most; twice that is allowed.
        least = (self.found.least - bits * (bounded.shape[1] + 4) * np.finfo(kind).eps).astype(kind)
        rows = np.flatnonzero(bounds.max(axis=1) > least)
        at, columns = np.nonzero(bounds[rows] > least[rows, None])
        if len(at) > SPARED * bounds.size:
            return False
        rows = rows[at]
        scores = np.einsum("ij,ij->i", q[rows], x[columns])
        better = scores > self.found.least[rows]
        if better.any():
            self.found.add(rows[better], tile.ids[columns[better]], scores[better].astype(np.int64))
        return True


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score) from packed rows that come group by group,
    the vectors of a group before its queries."""
    group, parts, tiles = None, {}, {}
    for b in batches:
        for i in range(b.num_rows):
            slot, asked, dim, wide, ids, data = (b.column(c)[i] for c in ("slot", "asked", "dim", "wide", "ids", "data"))
            if slot.as_py() != group:
                group, parts, tiles = slot.as_py(), {}, {}
            dim = dim.as_py()
            ids = np.frombuffer(ids.as_buffer(), np.int64)
            x = np.frombuffer(data.as_buffer(), np.float64 if wide.as_py() else np.int16).reshape(-1, dim)
            if not asked.as_py():
                parts.setdefault(dim, []).append((ids.copy(), x.copy()))
                continue
            if dim in parts:
                tiles[dim] = _tiles(parts.pop(dim))
            queries = _Queries(ids, x, k)
            for tile in tiles.get(dim, []):
                queries.meet(tile)
            found = queries.found
            yield pa.RecordBatch.from_arrays([pa.array(ids[found.row]), pa.array(found.ids), pa.array(found.scores)],
                                             names=["query_id", "vec_id", "score"])


def groups(vectors: int, queries: int, most: int) -> int:
    """Number of groups for so many bytes of vectors and queries: ``most``,
    fewer where the copies of the queries would outgrow the vectors, more
    where a group would not fit a task."""
    spread = COPIES * vectors // max(1, queries) if queries else most
    return max(1, -(-vectors // GROUP_BYTES), min(most, spread))


def top_k(vecs: DataFrame, every: int, k: int, key: str = "vec_id", vector: str = "embedding",
          scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible
    by ``every``, the ``k`` rows of highest score, ties to the smaller id.

    Components become floor(scale * x) in doubles; scores are exact inner
    products (in floats or doubles while these hold the integers, in Python
    integers beyond; a score outside 64 bits is set to the nearest long).  A
    query meets vectors of its own number of components, never its own id.
    Rows with null ids, null or empty vectors, null or non-finite components
    take no part; rows with equal ids count once.  Fewer than ``k`` candidates:
    all of them.  An empty table gives no rows.
    """
    rows = (usable(vecs, key, vector, zero=True)
            .withColumn("v", F.transform("v", lambda x: F.lit(float(scale)) * x))
            .where(F.forall("v", lambda x: F.abs(x) < float("inf")))
            .withColumn("asked", is_query(every)))
    packed = written(rows.mapInArrow(_pack, _PACKED), READ_ROWS)
    size = F.col("n").cast("bigint") * F.col("dim") * F.when(F.col("wide"), 8).otherwise(2)
    of = {r[0]: r[1] for r in packed.groupBy("asked").agg(F.sum(size)).collect()}
    n = groups(of.get(False, 0), of.get(True, 0), slots(vecs))
    slot = F.when(F.col("asked"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.col("place") % n))
    dealt = (packed.withColumn("slot", F.explode(slot)).repartitionById(n, F.col("slot"))
             .sortWithinPartitions("slot", "asked"))
    found = dealt.mapInArrow(lambda batches: _search(batches, k), "query_id long, vec_id long, score long")
    return best(found, k)
