import math
import re
from hashlib import md5

import pytest

from fleetframe.llm import mixing
from tests.llm.cases import ROWS, bag, documents

OUT = ("doc_id", "source", "size", "source_size", "target", "taken")


def brute(rows, weights=(3, 1, 2), share=1.5, most=2):
    """(doc_id, source, size, source_size, target, taken) by plain loops."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = {}
    for _, t, _, s in rows:
        sums[s] = sums.get(s, 0) + size(t)
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sums.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= most * sums[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: float(most * sums[s]) for s in over}
        left -= sum(most * sums[s] for s in over)
        free -= over

    def key(i, t):
        h = md5("|".join(["mix-1"] + [str(x) for x in (i, t) if x is not None]).encode()).hexdigest()
        junk = sum((t or "").count(c) for c in "#$%&*|!")
        w = max(0.05, 1 - 4 * junk / len(t)) if t else 0.05
        return -math.log((int(h[:13], 16) + 0.5) / 2 ** 52) / w

    out = []
    for s in order:
        mine = sorted(((key(i, t), -1 if i is None else i, size(t), i) for i, t, _, x in rows if x == s), key=lambda r: r[:3])
        epochs = math.floor(target[s] / sums[s]) if sums[s] else 0
        rest, before, k = target[s] - epochs * sums[s], 0, 0
        while k < len(mine):
            same = [m for m in mine if m[:3] == mine[k][:3]]
            words = sum(m[2] for m in same)
            more = 1 if rest > 0 and before + words / 2 <= rest else 0
            out += [(m[3], s, m[2], sums[s], round(target[s], 6), m[2] * (epochs + more)) for m in same]
            before, k = before + words, k + len(same)
    return out


def got(df):
    return bag((r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.select(*OUT).collect())


def test_edge_rows_match_brute_force(spark, edge_docs):
    mixed = mixing.mix(edge_docs)
    assert got(mixed) == bag(brute(ROWS))
    assert mixed.columns.count("size") == 1 and "a.b" in mixed.columns


def test_hot_source_and_reruns(spark):
    rows = [(i, f"w{i} " * (1 + i * 7 % 40), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    first = got(mixing.mix(documents(spark, rows).repartition(5)))
    assert first == got(mixing.mix(documents(spark, rows).repartition(2, "doc_id"))) == bag(brute(rows))


def test_targets_are_met_within_half_a_document(spark):
    rows = [(i, "w " * (1 + i % 50), "en", f"s{i % 5}") for i in range(400)]
    out = mixing.mix(documents(spark, rows)).collect()
    assert all(r.taken <= 2 * r["size"] for r in out)
    for s in {r.source for r in out}:
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 25


def test_all_sources_stop_or_share(spark):
    rows = [(1, "a a a a", "en", "x"), (2, "b", "en", "y"), (3, "", "en", "z")]
    assert got(mixing.mix(documents(spark, rows))) == bag(brute(rows))


def test_mixed_repeats_whole_rows(spark, edge_docs):
    taken = bag((r.doc_id, r["copies"]) for r in mixing.mix(edge_docs).select("doc_id", "copies").collect())
    rows = mixing.mixed(edge_docs)
    assert rows.columns == edge_docs.columns
    assert rows.count() == sum(n * c for (_, n), c in taken.items())


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "", None, "a"), (2, " ", None, None)]])
def test_tables_without_words(spark, rows):
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(documents(spark, rows)).collect())
