import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from fleetframe.llm import simhash
from fleetframe.llm.components import connected_components
from tests.llm.cases import ROWS, bag, documents


def brute_print(text):
    words = (text or "").encode().lower().split()
    n = len(words)
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, n - 3))] if n else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, most=4):
    """Smallest member of each fingerprint's group."""
    prints, group = sorted(set(prints)), {}
    for p in prints:
        group[p] = p
    find = lambda p: p if group[p] == p else find(group[p])
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= most:
            x, y = sorted((find(a), find(b)))
            group[y] = x
    return {p: find(p) for p in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_edge_rows(spark, edge_docs):
    prints = [brute_print(t) for _, t, _, _ in ROWS]
    group = brute_groups(prints)
    ids = {}
    for (i, *_), p in zip(ROWS, prints):
        if i is not None:
            ids[group[p]] = min(ids.get(group[p], i), i)
    want = bag((i, f"{p:016x}", ids.get(group[p])) for (i, *_), p in zip(ROWS, prints))
    assert bag(simhash.near_duplicates(edge_docs).collect()) == want
    assert f"{0:016x}" in {k[1] for k in want}


def test_hash_is_that_of_spark(spark):
    text = "Some words Über alles"
    low = text.translate({c: c + 32 for c in range(65, 91)})
    got = spark.sql("select 1").select(F.xxhash64(F.lit(low))).first()[0]
    assert signed(xxhash.xxh64_intdigest(low.encode(), 42)) == got


def random_prints(n, seed):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        p = r.getrandbits(64)
        out.add(p)
        for _ in range(r.randint(0, 4)):
            for b in r.sample(range(64), r.randint(1, 6)):
                p ^= 1 << b
            out.add(p)
    return sorted(out)


@pytest.mark.parametrize("most,hot", [(4, 1024), (4, 2), (2, 1024), (2, 1), (6, 1024), (3, 1), (1, 1), (0, 1024)])
def test_links_keep_the_components(spark, most, hot):
    prints = random_prints(150, most)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = connected_components(simhash.links(df, most, hot)).collect()
    want = {}
    for p, g in brute_groups(prints, most).items():
        want.setdefault(g, set()).add(signed(p))
    got = {}
    for node, comp in found:
        got.setdefault(comp, set()).add(node)
    assert bag(map(tuple, map(sorted, got.values()))) == bag(tuple(sorted(g)) for g in want.values() if len(g) > 1)


def test_dense_group_by_the_hot_path(spark):
    base = 0x0123456789ABCDEF
    prints = sorted({base ^ (a << 3) ^ (b << 40) for a in range(16) for b in range(8)})
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = connected_components(simhash.links(df, 4, 20)).collect()
    assert {c for _, c in found} == {min(map(signed, prints))} and len(found) == len(prints)


def test_long_paths(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(n + 5, n + 9)], "a long, b long")
    found = dict(connected_components(links).collect())
    assert all(found[i] == 0 for i in range(n + 1)) and found[n + 9] == n + 5 and len(found) == n + 3


def test_one_row_of_each_group_stays(spark, edge_docs):
    rows = simhash.without_near_duplicates(edge_docs)
    assert rows.columns == edge_docs.columns
    prints = [brute_print(t) for _, t, _, _ in ROWS]
    group = brute_groups(prints)
    first = {}
    for (i, t, *_), p in zip(ROWS, prints):
        k = (i is None, i or 0, signed(p), t is None, t or "")
        first[group[p]] = min(first.get(group[p], k), k)
    want = bag((None if k[0] else k[1], None if k[3] else k[4]) for k in first.values())
    assert bag(rows.select("doc_id", "text").collect()) == want


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.without_near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("bits, left", [(2, [1, 2, 3]), (4, [1, 3]), (6, [1])])
def test_one_row_of_each_group_at_other_distances(spark, monkeypatch, bits, left):
    # Texts that are their fingerprints: 3 and 5 bits from the first, 8 from each other.
    monkeypatch.setattr(simhash, "with_fingerprints", lambda docs, text, out, _: docs.withColumn(out, F.col(text).cast("long")))
    docs = spark.createDataFrame([(1, "0"), (2, "7"), (3, str(0x1F << 32))], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.without_near_duplicates(docs, max_bits=bits).collect()) == left


def test_odd_limits_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), 8)


def test_postings_are_counted_without_a_window(spark, monkeypatch):
    plans, real = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or real(df))
    prints = spark.createDataFrame([(x,) for x in (0, 1, 3, 1 << 40, -1)], "fp long")
    assert {(r.a, r.b) for r in simhash.links(prints).collect()} == {
        (0, 1), (0, 3), (1, 3), (0, 1 << 40), (1, 1 << 40), (3, 1 << 40)}
    assert plans and not any("Window" in p for p in plans)


def test_a_large_family_is_linked_in_seconds(spark):
    """10,000 fingerprints three bits from one base: many large postings."""
    import time
    r = random.Random(11)
    base, prints = r.getrandbits(64), set()
    while len(prints) < 10_000:
        p = base
        for b in r.sample(range(64), 3):
            p ^= 1 << b
        prints.add(signed(p))
    df = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(4)
    t = time.time()
    found = simhash.cut(simhash.links(df))
    assert time.time() - t < 20
    assert found.where("bit_count(a ^ b) > 4").count() == 0
    groups = connected_components(found)
    assert groups.count() == len(prints) and groups.select("component").distinct().count() == 1


def test_hot_words_are_made_once(spark, monkeypatch):
    """1 + 32 + 496 words of an entry, each set of flips once."""
    frame = type(spark.range(0))
    made, real = [], frame.groupBy
    monkeypatch.setattr(frame, "groupBy", lambda self, *c: (made.append(self) if c == ("c", "w") else None, real(self, *c))[1])
    choices = simhash._choices(4)
    hot = spark.createDataFrame([(0, 0), (0, 5)], "c int, fp long")
    assert {(x.a, x.b) for x in simhash._hot_links(hot, choices, 4).collect()} <= {(5, 0)}
    words = made[0].where("fp = 0").select("w").collect()
    assert len(words) == len({w[0] for w in words}) == 529


def test_a_posting_of_two_is_its_pair(spark, monkeypatch):
    """No row is posted again where no posting holds three."""
    seen, real = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: seen.append(real(df)) or seen[-1])
    prints = [signed(x) for x in (0x0123456789ABCDEF, 0x0123456789ABCDEE, 0xFEDCBA9876543210, 0xFEDCBA9876543216)]
    got = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    assert {(x.a, x.b) for x in got.collect()} == {tuple(sorted(prints[:2])), tuple(sorted(prints[2:]))}
    assert sum(s.count() for s in seen) == 0
