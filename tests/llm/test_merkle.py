import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from fleetframe.llm import merkle
from tests.llm.cases import ROWS, documents

H = lambda s: sha256(s.encode()).hexdigest()
OUT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def leaf_of(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def partners(tree, i):
    out = []
    for nodes in tree[:-1]:
        out.append((nodes[i ^ 1] if i ^ 1 < len(nodes) else "", i & 1))
        i //= 2
    return out


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf_of(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: levels([x[1] for x in groups[g]]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, (key, leaf, r) in enumerate(groups[g]):
            path = partners(trees[g], i) + partners(top, at)
            now = leaf
            if key is not None and r[3] is not None and zlib.crc32(str(key).encode()) % 7 == 0:
                now = leaf_of((r[0], r[1], r[2], r[3] + 1, r[4]))
            for s, side in path:
                now = H(s + now if side else now + s)
            out.append((key, leaf, trees[g][-1][0], top[-1][0], H("".join(s for s, _ in path)), now, now == top[-1][0]))
    return Counter(out)


def held(spark, rows, height):
    df = documents(spark, rows)
    want = brute([tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    got = Counter(tuple(r) for r in merkle.audited(df.repartition(3), height=height).select(*OUT).collect())
    assert got == want
    return want


@pytest.mark.parametrize("height", [1, 2, 10])
def test_edge_rows_match_brute_force(spark, height):
    assert held(spark, ROWS + [(-7, "minus", "en", "a"), (49, "x", "", ""), (50, "y", "é", ""), (51, "z", "z", "")], height)


def test_hot_group_over_many_blocks(spark):
    rows = [(i, f"text {i}", "en" if i % 5 else f"l{i % 3}", "s") for i in range(230)] + [(9, "copy", "en", "s")] * 40
    want = held(spark, rows, 3)
    assert 0 < sum(n for r, n in want.items() if not r[-1]) < sum(want.values()) / 2


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_small_tables(spark, n):
    held(spark, [(i, f"t{i}", None, None) for i in range(n)], 2)


def test_many_groups(spark):
    held(spark, [(i, "same", f"g{i:03d}", "s") for i in range(40)], 2)


def test_van_emde_boas_places():
    """Every place is taken once; upper halves stand first; arithmetic and tables agree."""
    for depths in range(1, 12):
        at = merkle._offsets(depths)
        assert sorted(o for level in at for o in level.tolist()) == list(range((1 << depths) - 1))
        assert all(merkle.place(depths, d, i) == o for d, level in enumerate(at) for i, o in enumerate(level.tolist()))
        upper = depths // 2
        assert sorted(o for level in at[:upper] for o in level.tolist()) == list(range((1 << upper) - 1))
        for d in range(upper, depths):  # each lower subtree is one stretch
            for s in range(1 << upper):
                mine = [o for e in range(upper, depths) for i, o in enumerate(at[e].tolist()) if i >> (e - upper) == s]
                assert max(mine) - min(mine) == len(mine) - 1


def test_a_path_touches_few_pages():
    """Pages of 64 digests: a path of 16 levels meets fewer than in level order."""
    def pages(place):
        return [len({place(d, i >> (15 - d)) // 64 for d in range(16)}) for i in range(0, 1 << 15, 97)]

    veb = pages(lambda d, i: merkle.place(16, d, i))
    by_level = pages(lambda d, i: (1 << d) - 1 + i)
    assert sum(veb) < 0.5 * sum(by_level)


def test_change_of_any_field_is_found(spark):
    df = documents(spark, [(i, f"text {i}", "en", "s") for i in range(9)])
    for field in merkle.FIELDS[1:]:
        other = F.when(F.col("doc_id") == 4, F.concat(F.col(field).cast("string"), F.lit("0"))).otherwise(F.col(field).cast("string"))
        rows = merkle.audit(merkle.manifest(df, changed={field: other}, height=2)).collect()
        assert [r.id for r in rows if not r.verified] == [4]


def test_unchanged_table_verifies(spark, edge_docs):
    assert all(r.verified for r in merkle.audit(merkle.manifest(edge_docs, height=2)).collect())


def test_keys_must_be_integers(spark):
    with pytest.raises(TypeError):
        merkle.manifest(spark.createDataFrame([("a",)], "doc_id string"))
