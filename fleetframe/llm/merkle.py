"""A Merkle manifest of a table, its trees laid out after van Emde Boas.

Every row is a leaf.  The leaves of a group, in order, are cut into aligned
blocks of ``2 ** HEIGHT``; a block is a whole subtree and one row of the
manifest.  The block roots are the leaves of the next round, and so on until
a group has one block; the groups' roots make one more tree by the same
rounds.  So no task holds more than a block, and a group that holds most rows
is as many tasks as it has blocks.

Within a block the digests stand in van Emde Boas order: the tree is split at
half its height, the upper part stored first and then each lower subtree,
each by the same rule.  Where a node stands follows from its depth and
number by arithmetic alone; construction writes and proofs read there, and a
path from leaf to root touches few stretches of the array, whatever the size
of a cache line or page.

Proofs go down again: a block's row gets its siblings on the way up to the
root, once for the block, and each leaf's proof is made from them in the block.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe.llm.common import col, range_prefix, written

HEIGHT = 10  # of a block's tree: 1,024 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WIDTH = 32  # bytes of a digest
TAMPER = 7


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else its UTF-8 byte count, a
    colon, and the value (numbers in decimal)."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """The digest of a row, in hex."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


# --- one tree ------------------------------------------------------------------

@cache
def _offsets(depths: int) -> tuple[np.ndarray, ...]:
    """For each depth of a perfect tree of ``depths`` levels (the root is
    depth 0), where its nodes stand in van Emde Boas order."""
    if depths == 1:
        return (np.zeros(1, np.int64),)
    upper = depths // 2
    lower = depths - upper
    top, bottom = _offsets(upper), _offsets(lower)
    first, size = (1 << upper) - 1, (1 << lower) - 1
    starts = first + size * np.arange(1 << upper, dtype=np.int64)
    return (*top, *((starts[:, None] + b[None, :]).ravel() for b in bottom))


def place(depths: int, depth: int, number: int) -> int:
    """Where node ``number`` of ``depth`` stands in a tree of ``depths`` levels."""
    at = 0
    while depths > 1:
        upper = depths // 2
        if depth < upper:
            depths = upper
            continue
        depth, depths = depth - upper, depths - upper
        at += (1 << upper) - 1 + ((1 << depths) - 1) * (number >> depth)
        number &= (1 << depth) - 1
    return at


def joined(digests: Sequence[bytes]) -> bytes:
    """The digest of a run of digests, which are hashed as hex text."""
    return sha256(b"".join(digests).hex().encode()).digest()


def height_of(n: int) -> int:
    """Rounds of pairing until ``n`` nodes are one."""
    return max(0, (n - 1).bit_length())


def build(leaves: Sequence[bytes], height: int) -> bytes:
    """The tree over ``leaves`` (at most ``2 ** height``), ``height`` rounds high;
    a node without a partner is hashed alone.  Places without a node are zero."""
    at = _offsets(height + 1)
    tree = bytearray(WIDTH * ((2 << height) - 1))
    nodes = list(leaves)
    for depth in range(height, -1, -1):
        for o, x in zip(at[depth].tolist(), nodes):
            tree[WIDTH * o:WIDTH * (o + 1)] = x
        nodes = [joined(nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
    return bytes(tree)


def siblings(tree: bytes, height: int, n: int) -> list[list[bytes]]:
    """For each of the ``n`` leaves, the partners of it and its ancestors, lowest
    first; an empty one where a node has none."""
    at, rows = _offsets(height + 1), []
    for up in range(height):
        here = at[height - up][:((n - 1) >> up) + 1].tolist()
        rows.append([*(tree[WIDTH * o:WIDTH * (o + 1)] for o in here), b""])
    return [[row[min((i >> up) ^ 1, len(row) - 1)] for up, row in enumerate(rows)] for i in range(n)]


def fold(leaf: bytes, path: Sequence[bytes], number: int) -> bytes:
    """The root that follows from a leaf, its partners, and its number, whose
    bits say on which side it and its ancestors stand."""
    for p in path:
        leaf = joined((p, leaf) if number & 1 else (leaf, p))
        number >>= 1
    return leaf


# --- rounds of blocks ------------------------------------------------------------

_BLOCK = "group string, block long, n int, height int, digest binary, tree binary"
_STEP = "group string, pos long, path array<binary>, number long, root binary, subroot binary"


@dataclass(frozen=True)
class Forest:
    """The trees of all groups: rounds of blocks (``group``, ``block``, ``n``
    leaves, ``height``, root ``digest``, ``tree`` in van Emde Boas order), lowest
    first.  The last round has one block for each group."""

    rounds: list[DataFrame]
    height: int


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """One row for each aligned block of (group, pos, digest, size) nodes.  A
    group's only block stops at one node; others go through all rounds."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        digests = table.sort_by("pos").column("digest").to_pylist()
        size = table.column("size")[0].as_py()
        h = height_of(size) if size <= 1 << height else height
        tree = build(digests, h)
        return pa.Table.from_pylist([{"group": key[0].as_py(), "block": key[1].as_py(), "n": len(digests), "height": h,
                                      "digest": tree[:WIDTH], "tree": tree}], schema=_arrow(_BLOCK))

    keyed = nodes.select("group", F.shiftright("pos", height).alias("block"), "pos", "digest", "size")
    return keyed.groupBy("group", "block").applyInArrow(run, _BLOCK)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(),
             "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def build_forest(nodes: DataFrame, height: int = HEIGHT) -> Forest:
    """The trees of all groups from (group, pos, digest) nodes; ``group`` is not
    null and ``pos`` counts from 0 in each.  A round leaves one node of up to
    ``2 ** height``; the number of rounds is the logarithm of the largest group."""
    rounds = []
    while True:
        sizes = written(nodes.groupBy("group").agg((F.max("pos") + 1).alias("size")))
        rounds.append(written(_blocks(nodes.join(sizes, "group"), height)))
        if rounds[-1].where(F.col("block") > 0).isEmpty():
            return Forest(rounds, height)
        nodes = rounds[-1].select("group", F.col("block").alias("pos"), "digest")


def _steps(blocks: DataFrame, height: int) -> DataFrame:
    """Each leaf of ``blocks`` with its whole path: what the next lower round's
    blocks start from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                paths = siblings(r["tree"], r["height"], r["n"])
                yield pa.RecordBatch.from_pylist(
                    [{"group": r["group"], "pos": (r["block"] << height) + i, "path": p + r["path"],
                      "number": i + (r["number"] << r["height"]), "root": r["root"], "subroot": r["subroot"]}
                     for i, p in enumerate(paths)], schema=_arrow(_STEP))

    return blocks.select("group", "block", "n", "height", "tree", "path", "number", "root", "subroot").mapInArrow(run, _STEP)


def climbed(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """The lowest round's blocks with ``path`` (the partners of the block's
    root and its ancestors), ``number`` (their sides), ``root`` and ``subroot``
    (the group's own).  ``above`` has (group, path, number, root) of the groups'
    roots in a higher tree; without it they are roots themselves."""
    found = forest.rounds[-1].withColumn("subroot", F.col("digest"))
    if above is None:
        found = (found.withColumn("path", F.array().cast("array<binary>")).withColumn("number", F.lit(0).cast("bigint"))
                 .withColumn("root", F.col("digest")))
    else:
        found = found.join(above, "group")
    for lower in reversed(forest.rounds[:-1]):
        upper = written(_steps(found, forest.height).withColumnRenamed("pos", "block"))
        found = lower.join(upper, ["group", "block"])
    return found


# --- manifest of a table -----------------------------------------------------------

_AUDIT = ("row_id long, leaf string, subroot string, root string, proof_sha256 string, "
          "folded_root string, verified boolean")


@dataclass(frozen=True)
class Manifest:
    """Leaves (``id``, ``group``, ``pos``, ``digest``, ``changed``), the groups' trees, and
    the tree of their roots, whose leaves are the groups in order (``order``:
    ``group``, ``pos``)."""

    leaves: DataFrame
    forest: Forest
    order: DataFrame
    top: Forest


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS,
             changed: Mapping[str, Column] | None = None, height: int = HEIGHT) -> Manifest:
    """The manifest of ``docs``: a tree for each value of ``group`` over its rows
    by ascending ``key``, and one over their roots by ascending value.

    ``changed`` gives other values of some fields; leaves then also carry the
    digest of the row with those.  Null keys come first, and a null
    group is a group, the first; rows that repeat a key are ordered by
    digest.  Equal rows are counted before they are ordered, so a row that
    repeats very often is one row there.  Columns that are no field are not
    read.  An empty table has no leaves and no trees.
    """
    if docs.schema[key].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError(f"{key} must be an integer")
    now = {f: col(f) for f in fields}
    digest = F.unhex(leaf_digest(*now.values()))
    other = F.unhex(leaf_digest(*{**now, **(changed or {})}.values())) if changed else digest
    units = (docs.select(col(key).cast("bigint").alias("id"), field(col(group)).alias("group"),
                         digest.alias("digest"), other.alias("changed"))
             .groupBy("group", "id", "digest", "changed").agg(F.count(F.lit(1)).alias("rows")))
    units = range_prefix(units, ["group"], ["id", "digest"], F.col("rows"), "before")
    copies = F.explode(F.sequence(F.col("before"), F.col("before") + F.col("rows") - 1)).alias("pos")
    leaves = written(units.select("id", "group", copies, "digest", "changed"))
    forest = build_forest(leaves.select("group", "pos", "digest"), height)
    # A group's name is its field: null, or its value behind a colon.
    value = F.when(F.col("group") != "-", F.expr("substring(group, instr(group, ':') + 1)"))
    roots = forest.rounds[-1].select("group", "digest", value.alias("value"))
    # The one group of the roots is a stored column: joins on a literal would lose their key.
    ordered = written(range_prefix(roots, [], ["value"], F.lit(1).cast("bigint"), "pos").withColumn("all", F.lit("")))
    top = build_forest(ordered.select(F.col("all").alias("group"), "pos", "digest"), height)
    return Manifest(leaves, forest, ordered.select("group", "pos"), top)


def audit(m: Manifest) -> DataFrame:
    """Every leaf of the manifest with its proof, checked: ``id``, ``leaf``,
    ``subroot``, ``root``, ``proof_sha256`` (the digest of its partners up to the
    root), ``folded_root`` (what its changed digest and the partners give) and
    ``verified`` (that is the root).  A block's leaves meet their block, which
    has the way from there to the root, in one task."""
    names = written(_steps(climbed(m.top), m.top.height).drop("group", "subroot"))
    height = m.forest.height
    blocks = climbed(m.forest, m.order.join(names, "pos").select("group", "path", "number", "root"))

    def run(key: tuple, leaves: pa.Table, block: pa.Table) -> pa.Table:
        r = block.to_pylist()[0]
        paths, root = siblings(r["tree"], r["height"], r["n"]), r["root"]
        rows = []
        for x in leaves.select(["id", "pos", "digest", "changed"]).to_pylist():
            i = x["pos"] - (r["block"] << height)
            path = paths[i] + r["path"]
            found = fold(x["changed"], path, i + (r["number"] << r["height"]))
            rows.append({"row_id": x["id"], "leaf": x["digest"].hex(), "subroot": r["subroot"].hex(), "root": root.hex(),
                         "proof_sha256": joined(path).hex(), "folded_root": found.hex(), "verified": found == root})
        return pa.Table.from_pylist(rows, schema=_arrow(_AUDIT))

    rows = m.leaves.withColumn("block", F.shiftright("pos", height)).groupBy("group", "block")
    out = rows.cogroup(blocks.groupBy("group", "block")).applyInArrow(run, _AUDIT)
    return out.withColumnRenamed("row_id", "id")


def audited(docs: DataFrame, key: str = "doc_id", group: str = "lang", height: int = HEIGHT) -> DataFrame:
    """The manifest of ``docs`` audited after tampering: where ``TAMPER`` divides
    the CRC-32 of the key's decimals, ``n_chars`` is one more (nulls stay)."""
    hit = F.crc32(col(key).cast("string").cast("binary")) % TAMPER == 0
    n = F.when(F.coalesce(hit, F.lit(False)), F.try_add(col("n_chars"), F.lit(1))).otherwise(col("n_chars"))
    m = manifest(docs, key, group, changed={"n_chars": n}, height=height)
    return audit(m).withColumnRenamed("id", key)
