"""Every stage on awkward rows: nulls, blanks, long texts, repeated rows, and
columns that clash with what the operators add."""

from collections import Counter

import pytest

import corpus_pipeline
from fleetframe.llm import pieces
from tests.llm.cases import LONG, ROWS, bag, documents

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
MORE = [*ROWS, (30, LONG, "en", "a"), (30, LONG, "en", "a"), (31, "mail bob@example.org now " * 4000, None, "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, MORE)


def rows_of(df):
    return bag((r.doc_id, r.text, r.lang, r.source, r["size"], r["a.b"]) for r in df.collect())


def test_classifier_drops_rows_only(spark, docs):
    out = STAGES["quality classifier"](spark, docs, SF)
    assert out.columns == docs.columns
    got, given = rows_of(out), rows_of(docs)
    assert got and all(got[r] in (0, n) for r, n in given.items()) and set(got) <= set(given)


def test_one_row_of_each_group(spark, docs):
    out = STAGES["SimHash near-dedup"](spark, docs, SF)
    assert out.columns == docs.columns
    got = rows_of(out)
    assert set(got) <= set(rows_of(docs)) and max(got.values()) == 1
    assert sum(r[0] in (6, 30) for r in got) == 1 and sum(r[1] is None or not r[1].split() for r in got) == 1


def test_masking_keeps_every_row(spark, docs):
    out = STAGES["PII"](spark, docs, SF)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in MORE)
    texts = [r.text for r in out.collect()]
    assert sum(t is None for t in texts) == sum(r[1] is None for r in MORE)
    assert not any("example" in (t or "") for t in texts)
    clean = rows_of(docs.where("text is null or not contains(text, '@')"))
    assert all(rows_of(out)[r] == n for r, n in clean.items())


def test_mix_takes_whole_rows(spark, docs):
    out = STAGES["mixing sources to target weights"](spark, docs, SF)
    assert out.columns == docs.columns
    got, given = rows_of(out), rows_of(docs)
    assert set(got) <= set(given) and all(n <= 2 * given[r] for r, n in got.items())


def test_encoding_gives_the_texts_back(spark, docs):
    out = STAGES["SentencePiece encoding and decoding"](spark, docs, SF)
    assert [c for c in out.columns if c != "pieces"] == [c for c in docs.columns if c != "pieces"]
    back = pieces.decode(out, out="decoded").select("text", "decoded", "pieces").collect()
    assert len(back) == len(MORE)
    assert all(r.text == r.decoded and (r.pieces is None) == (r.text is None) for r in back)


@pytest.mark.parametrize("name", list(STAGES))
@pytest.mark.parametrize("rows", [[], [(None, None, None, None)] * 2])
def test_tables_without_texts(spark, name, rows):
    out = STAGES[name](spark, documents(spark, rows), SF)
    assert out.count() <= len(rows)
