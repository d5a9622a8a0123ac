"""SimHash near-duplicates: a byte-position inverted index with count
filtering.

Two 64-bit fingerprints that differ in at most ``b`` bits agree in at least
``8 - b`` of their 8 bytes, place by place.  Posting single bytes would make
lists of 1/256 of all fingerprints, so the index posts the guaranteed
number of bytes at once: each fingerprint under every choice of ``8 - b``
places with the bytes that stand there, as one 64-bit hash.  Two that share
such a posting thereby share the guaranteed bytes; the tally of a pair's shared
positional bytes drops those that only share a hash.  A pair that stays is
verified by its differing bits, and made once, in the posting of its first
shared places.

Postings are counted first, by partial aggregates that also keep the least
and the greatest fingerprint: a posting of two is its pair.  Only the few
postings of three and more need their rows again.

Equal fingerprints are one entry.  A posting with very many entries is not
paired: its entries post every word within ``b // 2`` bits over the places
that are not fixed (and within the rest of ``b`` on the other side), and two entries meet
in such a word exactly if they differ in at most ``b`` bits; each links to
the smallest entry of the word.  The rows stay in proportion to the entries.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.llm.common import append_columns, col, cut, without, written
from fleetframe.llm.components import connected_components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
# Entries of a posting that are compared pair by pair at most: half the square of so many
# comparisons cost about what 529 words for each entry do, which are shuffled.
HOT = 4096
CHUNK = 1 << 15  # shingles hashed at a time


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed long: a bit is 1 if it is set in over half
    the hashes of the text's word shingles, repeats included."""
    words = text.lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:][:n].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, n, CHUNK):
        h = np.array([digest(whole[s:e], SEED) for s, e in zip(starts[a:a + CHUNK], ends[a:a + CHUNK])], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n)
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, text: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a long."""
    def make():
        def compute(column: pa.Array) -> list[pa.Array]:
            return [pa.array([fingerprint(t or b"", shingle) for t in column.cast(pa.binary()).to_pylist()], pa.int64())]
        return compute
    return append_columns(docs, text, [T.StructField(out, T.LongType())], make)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _choices(max_bits: int) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(8), 8 - max_bits))


def _mask(places: tuple[int, ...]) -> int:
    return _signed(sum(0xFF << (8 * p) for p in places))


def _bits(x: Column) -> Column:
    return F.bit_count(x)


def _hot_links(hot: DataFrame, choices: list[tuple[int, ...]], max_bits: int) -> DataFrame:
    """(a, b) links of the (c, fp) entries of postings that are too large to
    pair.  Two entries within ``max_bits`` meet in a word that is within half
    of them of one and within the rest of the other; only bits outside the
    posting's places are flipped, so a word is of one posting.  Flips are drawn
    in falling order, each set once."""
    free = F.array(*[F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)) for i in range(64) if i // 8 not in p])
                     for p in choices])
    most = 8 * max_bits + 1

    def words(bits: int) -> DataFrame:
        out = hot.select("c", "fp", F.col("fp").alias("w"), F.lit(most).alias("last"))
        for _ in range(bits):  # 0: no further flip
            out = (out.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.col("last") - 1, F.lit(0)))))
                   .select("c", "fp", F.col("w").bitwiseXOR(F.element_at(F.element_at(free, F.col("c") + 1), F.col("i") + 1)).alias("w"),
                           F.col("i").alias("last")))
        return out.drop("last")

    least = words(max_bits // 2).groupBy("c", "w").agg(F.min("fp").alias("b"))
    return (words(max_bits - max_bits // 2).join(least, ["c", "w"])
            .where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b").distinct())


def _postings(prints: DataFrame, choices: list[tuple[int, ...]]) -> DataFrame:
    """(fp, c, h): each fingerprint under the hash of every choice and its bytes."""
    return (prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(p))) for p in choices]))
                          .alias("c", "v")).select("fp", "c", F.xxhash64("c", "v").alias("h")))


def links(prints: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """(a, b) links whose connected components are those of the fingerprints
    (distinct long column ``fp``) within ``max_bits`` of each other."""
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be from 0 to 7: beyond, no shared byte is guaranteed")
    choices = _choices(max_bits)
    counts = written(_postings(prints, choices).groupBy("h")
                     .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where(F.col("n") > 1))
    # A table of its own, whose size in bytes decides how it is joined.
    many = written(counts.where(F.col("n") > 2).select("h", "n"))
    posted = cut(_postings(prints, choices).join(many, "h"))
    cold = posted.where(F.col("n") <= hot)
    paired = cold.select("h", F.col("fp").alias("a")).join(cold.select("h", F.col("fp").alias("b")), "h").where(F.col("a") < F.col("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    same = [F.when(x.bitwiseAND(F.lit(_mask((p,)))) == 0, 1).otherwise(0) for p in range(8)]
    tally = sum(same[1:], same[0])
    # For each set of shared places, the first choice within it: the posting that makes the pair.
    first = [next((c for c, p in enumerate(choices) if all(s >> i & 1 for i in p)), 0) for s in range(256)]
    shared = sum((s * (1 << p) for p, s in list(enumerate(same))[1:]), same[0])
    c = F.element_at(F.array(*[F.lit(k) for k in first]), shared + 1)
    v = F.col("a").bitwiseAND(F.element_at(F.array(*[F.lit(_mask(p)) for p in choices]), c + 1))
    pairs = (counts.where(F.col("n") == 2).select("h", "a", "b").union(paired.select("h", "a", "b"))
             .where((tally >= 8 - max_bits) & (_bits(x) <= max_bits) & (F.xxhash64(c, v) == F.col("h"))).select("a", "b"))
    busy = posted.where(F.col("n") > hot).select("c", "fp")
    if busy.isEmpty():
        return pairs
    return pairs.union(_hot_links(busy, choices, max_bits))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` (the
    smallest key reachable over links) of every row of ``docs``.

    Null and blank texts have fingerprint zero, linked like any other; rows
    with null keys get a component id from the others of their component, or
    null.  Repeated rows count as rows.  An empty table gives no rows.
    """
    rows = cut(with_fingerprints(docs.select(col(key).alias("_ff_id"), col(text).alias("_ff_text")),
                                 "_ff_text", "fp", shingle).select(F.col("_ff_id").alias("id"), "fp"))
    groups = components_of(rows, max_bits, hot)
    return rows.join(groups, "fp").select(
        F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"))


def components_of(rows: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """(fp, group, component): each fingerprint's group (its smallest
    fingerprint) and the smallest id of the group, from (id, fp) rows."""
    # Each row makes 70 postings: as many partitions as a shuffle has, however small the table.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = cut(rows.groupBy("fp").agg(F.min("id").alias("id")).repartition(n, "fp"))
    found = connected_components(cut(links(prints.select("fp"), max_bits, hot)))
    grouped = cut(prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "group", F.coalesce("component", "fp")).drop("component"))
    # Cut off from the join, or its partitioning by group would keep a large group in one task.
    least = cut(grouped.groupBy("group").agg(F.min("id").alias("component")))
    return grouped.select("fp", "group").join(least, "group")


def without_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE,
                            max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest key (null
    last), of those the one with the smallest fingerprint, then text."""
    columns = docs.columns
    rows = written(with_fingerprints(docs, text, "_ff_fp", shingle))
    ids = rows.select(col(key).alias("id"), F.col("_ff_fp").alias("fp"))
    groups = components_of(ids, max_bits)
    kept = (ids.groupBy("fp", "id").agg(F.count(F.lit(1)).alias("n")).join(groups, "fp")
            .groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"),
                                                 F.col("fp").alias("fp"), F.col("n").alias("n"))).alias("r"))
            .select(F.struct("r.id", "r.fp").alias("_ff_row"), F.col("r.n").alias("_ff_n")))
    found = rows.withColumn("_ff_row", F.struct(col(key).alias("id"), F.col("_ff_fp").alias("fp"))).join(
        written(kept), "_ff_row")
    one = found.where(F.col("_ff_n") == 1).select(*[col(c) for c in columns])
    # Rows that repeat both key and fingerprint: partial aggregates leave one.
    many = (found.where(F.col("_ff_n") > 1).groupBy("_ff_row")
            .agg(F.min_by(F.struct(*[col(c) for c in columns]), F.struct(col(text).isNull(), col(text))).alias("_ff_one")))
    return one.union(many.select(*[F.col("_ff_one")[c].alias(c) for c in columns]))
