"""Ranked lexical search in K2-treaps over the term-document grid.

Documents are dealt to blocks of a bounded number of postings.  A block's grid
has a row for each of its terms, most frequent first, and a column for each
of its documents in the order of their ids.  It is stored as a quadtree: a
square splits into four until it is one cell, squares without a posting are not
stored, and each square has the largest impact of its cells.  A level is two
arrays in Morton order: a mask of the four children that exist, and the
maxima, stored as what they are below their parent's (mostly nothing) and
compressed before they leave the task that makes them: a block is megabytes, of
which Spark's reader, join and Arrow batches hold several copies at once.  The
children of a node follow from counting mask bits before it, so no pointers
are stored.

A search descends in the rows of all an item's terms at once.  A range of
documents is bounded by the sum, over the terms, of weight times the maximum
of the square that holds the term's row and the range.  The ranges with the
best bounds are split first, a few hundred together; a range of one document
has its exact score.  It ends when no bound reaches the k-th score found.

Impacts hold the lengths of documents, but no term weight: weights, which
depend on the number of documents that hold a term, come with the items.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetframe.llm.common import col, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
POSTINGS = 1 << 19  # of a block, after which it ends with the document at hand
COLUMNS = 1 << 16  # documents of a block at most
ITEMS = 256  # of one row of the item table
SENT = 200_000  # terms of all items, repeats included, up to which the item table is sent to every task (some MB)
RANGES = 512  # split at once
K = 50
READ_ROWS = 1  # blocks that a reader of the index holds at once
# One byte of UTF-8 after the other: letters in lower case, digits and bytes of longer characters stay, others part.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: Column) -> Column:
    """The terms of a text in order, repeats included; none for null."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


# --- one block -------------------------------------------------------------------

def _spread(x: np.ndarray) -> np.ndarray:
    """The low 32 bits of each number, moved to the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


_ONES = np.array([bin(m).count("1") for m in range(16)], np.int8)


@dataclass(frozen=True)
class Treap:
    """A block's quadtree: for each level from the root the children masks and
    maxima of its nodes, the last level holding single cells (no masks)."""

    masks: list[np.ndarray]
    maxima: list[np.ndarray]

    @staticmethod
    def build(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, depth: int) -> Treap:
        """From distinct cells of a grid of ``2 ** depth`` rows and columns."""
        codes = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(codes, kind="stable")
        codes, top = codes[order], values[order]
        masks, maxima = [], [top]
        for _ in range(depth):
            up = codes >> np.uint64(2)
            starts = np.flatnonzero(np.concatenate(([True], up[1:] != up[:-1])))
            masks.append(np.bitwise_or.reduceat((1 << (codes & np.uint64(3)).astype(np.int64)).astype(np.uint8), starts))
            top = np.maximum.reduceat(top, starts)
            maxima.append(top)
            codes = up[starts]
        return Treap(masks[::-1], maxima[::-1])

    def ranks(self) -> list[np.ndarray]:
        """For each level, where the children of each node begin in the next."""
        out = []
        for m in self.masks:
            ends = np.cumsum(_ONES[m], dtype=np.int32)
            out.append(ends - _ONES[m])
        return out

    def stored(self) -> tuple[list[bytes], list[bytes]]:
        """Masks, and maxima below those of the parents, as bytes."""
        below = [self.maxima[0], *(np.repeat(up, _ONES[m]) - here for m, up, here in
                                   zip(self.masks, self.maxima[:-1], self.maxima[1:], strict=True))]
        return [m.tobytes() for m in self.masks], [x.astype(np.int32).tobytes() for x in below]

    @staticmethod
    def loaded(masks: Sequence[pa.BinaryScalar], below: Sequence[pa.BinaryScalar]) -> Treap:
        """The treap of what :meth:`stored` gave."""
        levels = [np.frombuffer(m.as_buffer(), np.uint8) for m in masks]
        first, *rest = (np.frombuffer(x.as_buffer(), np.int32) for x in below)
        maxima = [first]
        for m, x in zip(levels, rest, strict=True):
            maxima.append(np.repeat(maxima[-1], _ONES[m]) - x)
        return Treap(levels, maxima)


class Searcher:
    """A block's treap, ready for items; ``row`` has the rows of their terms."""

    def __init__(self, treap: Treap, row: dict[str, int]) -> None:
        self.treap, self.first, self.depth, self.row = treap, treap.ranks(), len(treap.masks), row

    def top(self, terms: Sequence[str], weights: Sequence[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(column, score) of the ``k`` best documents with a score above 0,
        best first, equal scores by column."""
        here = [(self.row[t], w) for t, w in zip(terms, weights) if w > 0 and t in self.row]
        if not here:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rows, w = np.array([r for r, _ in here]), np.array([x for _, x in here], np.int64)
        # Pending ranges of each depth: their number, their bound, and each term's square (-1: none).
        ranges = [[] for _ in range(self.depth + 1)]
        ranges[0].append((np.zeros(1, np.int64), np.array([int(w @ np.full(len(w), self.treap.maxima[0][0], np.int64))]),
                          np.zeros((1, len(w)), np.int32)))
        best = np.array([ranges[0][0][1][0]] + [-1] * self.depth)  # best bound of each depth
        columns, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), 1
        while True:
            d = int(np.argmax(best))
            if best[d] < least:
                return columns, scores
            at, bound, squares = (np.concatenate(x) for x in zip(*ranges[d]))
            live = bound >= least
            at, bound, squares = at[live], bound[live], squares[live]
            if len(at) > RANGES:
                order = np.argpartition(-bound, RANGES - 1)
                rest = order[RANGES:]
                ranges[d] = [(at[rest], bound[rest], squares[rest])]
                best[d] = bound[rest].max()
                at, squares = at[order[:RANGES]], squares[order[:RANGES]]
            else:
                ranges[d], best[d] = [], -1
            at, bound, squares = self._split(d, at, squares, rows, w)
            if d + 1 < self.depth:
                live = bound >= least
                if live.any():
                    ranges[d + 1].append((at[live], bound[live], squares[live]))
                    best[d + 1] = max(best[d + 1], int(bound[live].max()))
                continue
            live = bound >= least
            columns, scores = np.concatenate((columns, at[live])), np.concatenate((scores, bound[live]))
            order = np.lexsort((columns, -scores))[:k]
            columns, scores = columns[order], scores[order]
            if len(scores) == k:
                least = int(scores[-1])

    def _split(self, d: int, at: np.ndarray, squares: np.ndarray, rows: np.ndarray, w: np.ndarray):
        """Both halves of each range, their bounds and squares."""
        down = (rows >> (self.depth - 1 - d)) & 1
        known = squares >= 0
        squares = np.where(known, squares, 0)
        mask = np.where(known, self.treap.masks[d][squares], 0).astype(np.int64)
        first = self.first[d][squares]
        numbers, bounds, found = [], [], []
        maxima = self.treap.maxima[d + 1]
        for side in (0, 1):
            child = 2 * down + side
            there = (mask >> child) & 1 == 1
            square = np.where(there, first + _ONES[mask & ((1 << child) - 1)], np.int32(-1))
            bounds.append((np.where(there, maxima[np.where(there, square, 0)], 0).astype(np.int64) * w).sum(axis=1))
            numbers.append(2 * at + side)
            found.append(square)
        return np.concatenate(numbers), np.concatenate(bounds), np.concatenate(found)


def _small(levels: Sequence[bytes]) -> list[bytes]:
    """Each level compressed, after its length."""
    codec = pa.Codec("zstd", compression_level=1)
    return [len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in levels]


def _large(levels: Sequence[pa.BinaryScalar]) -> pa.Array:
    """What :func:`_small` was given."""
    codec = pa.Codec("zstd")
    buffers = [x.as_buffer() for x in levels]
    return pa.array([codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in buffers], pa.binary())


# --- the index -------------------------------------------------------------------

_INDEX = "block string, ids array<long>, terms array<string>, df array<int>, masks array<binary>, maxima array<binary>"
_INDEX_ARROW = pa.schema([("block", pa.string()), ("ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())),
                          ("df", pa.list_(pa.int32())), ("masks", pa.list_(pa.binary())), ("maxima", pa.list_(pa.binary()))])


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and all their terms, repeats included."""

    documents: int
    terms: int


class _Block:
    """Documents of a block that is being filled."""

    def __init__(self) -> None:
        self.number = defaultdict(count().__next__)  # term to its first place in the block
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.numbers: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.postings = 0

    def add(self, key: int | None, text: bytes | None) -> None:
        tokens = (text or b"").translate(_FOLD).split()
        if not tokens:
            return
        found = np.fromiter(map(self.number.__getitem__, tokens), np.int32, len(tokens))
        numbers, counts = np.unique(found, return_counts=True)
        self.ids.append(key)
        self.sizes.append(len(tokens))
        self.numbers.append(numbers)
        self.counts.append(counts)
        self.postings += len(numbers)

    def full(self) -> bool:
        return self.postings >= POSTINGS or len(self.ids) >= COLUMNS

    def batch(self, name: str, corpus: Corpus) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        numbers = np.concatenate([self.numbers[i] for i in order])
        tf = np.concatenate([self.counts[i] for i in order]).astype(np.int64)
        lengths = [len(self.numbers[i]) for i in order]
        # Python's whole numbers: the product may exceed 64 bits before it is divided.
        m = np.array([50 + 50 * self.sizes[i] * corpus.documents // corpus.terms for i in order], np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, lengths))
        df = np.bincount(numbers, minlength=len(self.number))
        terms = np.array(list(self.number), dtype=object)
        by_df = np.argsort(-df, kind="stable")
        row = np.empty(len(by_df), np.int64)
        row[by_df] = np.arange(len(by_df))
        columns = np.repeat(np.arange(len(order)), lengths)
        depth = max(1, (max(len(by_df), len(order)) - 1).bit_length())
        treap = Treap.build(row[numbers], columns, impact.astype(np.int32), depth)
        values = [name, [self.ids[i] for i in order], [t.decode("utf-8", "replace") for t in terms[by_df]], df[by_df],
                  *map(_small, treap.stored())]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _INDEX_ARROW)], schema=_INDEX_ARROW)


def corpus_of(docs: DataFrame, text: str = "text") -> Corpus:
    """The counts that impacts need, over all rows."""
    n = F.coalesce(F.regexp_count(col(text), F.lit(TERM)), F.lit(0)).cast("bigint")
    found = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Corpus(*found)


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", corpus: Corpus | None = None) -> DataFrame:
    """The index of ``docs``: one row a block, written to the shared folder.

    A task deals its documents to blocks as it reads them; nothing is
    shuffled.  Null texts and texts without a term are in no block; rows that
    repeat are documents each; null keys stay, after all others.  An empty
    table has no blocks.
    """
    corpus = corpus or corpus_of(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, block = TaskContext.get().partitionId(), 0, _Block()
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                block.add(k, t.as_py())
                if block.full():
                    yield block.batch(f"{part}-{made}", corpus)
                    made, block = made + 1, _Block()
                    pa.default_memory_pool().release_unused()
        if block.ids:
            yield block.batch(f"{part}-{made}", corpus)

    return written(docs.select(col(key).cast("bigint"), col(text)).mapInArrow(run, _INDEX), READ_ROWS)


# --- searches --------------------------------------------------------------------

def weighted(index: DataFrame, items: DataFrame, corpus: Corpus) -> DataFrame:
    """(item, term, weight) of distinct (item, term) rows; terms that no document
    holds are left out.  How many hold a term is summed over the blocks."""
    wanted = written(items.select("term").distinct())
    held = (index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), "x.df")
            .join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df")))
    ratio = F.lit(2.0 * corpus.documents + 2) / (2 * F.col("df") + 1)
    return items.join(held, "term").select("item", "term", F.floor(1000 * F.log(ratio)).cast("bigint").alias("weight"))


def rank(docs: DataFrame, items: DataFrame, k: int = K, text: str = "text", key: str = "doc_id",
         item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The ``k`` best documents of each item: the item's key, ``rank`` (from 1),
    the document's key and ``score``, by :func:`search` of an index made here."""
    corpus = corpus_of(docs, text)
    index = build_index(docs, text, key, corpus)
    terms = items.select(col(item_key).cast("bigint").alias("item"), F.explode(terms_of(col(item_text))).alias("term")).distinct()
    found = search(index, terms, corpus, k)
    return found.select(F.col("item").alias(item_key), "rank", F.col("id").alias(key), "score")


def search(index: DataFrame, items: DataFrame, corpus: Corpus, k: int = K) -> DataFrame:
    """(item, rank, id, score) of the ``k`` best documents of each item (all that
    score above 0, if fewer) from distinct (item, term) rows.

    Equal scores go by ascending id, null last.  Rows that share an item's key
    are one item; a null key is an item; items without a known term have no
    rows.  Items are packed into rows of about ``ITEMS``, each of which meets
    every block: up to ``SENT`` terms they are sent to the blocks, beyond that
    both sides are dealt by slots.  A block returns its ``k`` best, of which
    each task passes on the ``k`` best again.
    """
    chosen = written(weighted(index, items, corpus))
    n_terms, n_items = chosen.agg(F.count(F.lit(1)), F.count_distinct(F.struct("item"))).first()
    item = F.struct("item", F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    packed = written(chosen.groupBy("item").agg(item.alias("q"))
                     .groupBy(F.pmod(F.xxhash64("item"), F.lit(max(1, -(-n_items // ITEMS)))).alias("pack"))
                     .agg(F.collect_list("q").alias("items")))
    few = n_terms <= SENT
    slots = 4 if few else int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = packed.select("items", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    pairs = (index.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int"))
             .join(F.broadcast(sides) if few else sides, "slot").select("ids", "terms", "masks", "maxima", "items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                ids, terms, masks, maxima, pack = (b.column(c)[j] for c in range(5))
                pack, ids = pack.as_py(), ids.values
                wanted = pa.array(sorted({t["term"] for q in pack for t in q["terms"]}), pa.string())
                rows = pc.index_in(wanted, value_set=terms.values)
                s = Searcher(Treap.loaded(_large(masks), _large(maxima)), {t: r for t, r in zip(wanted.to_pylist(), rows.to_pylist()) if r is not None})
                for q in pack:
                    columns, scores = s.top([t["term"] for t in q["terms"]], [t["weight"] for t in q["terms"]], k)
                    if len(columns):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([q["item"]] * len(columns), pa.int64()), ids.take(pa.array(columns)), pa.array(scores, pa.int64())],
                            names=["item", "id", "score"])

    best = pairs.mapInArrow(run, "item long, id long, score long")
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item", "rank", "id", "score")

