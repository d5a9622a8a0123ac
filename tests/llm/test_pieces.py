import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetframe.llm import pieces
from tests.llm.cases import LONG, ROWS, documents


@pytest.fixture(scope="module")
def v():
    return pieces.load()


def brute(v, text):
    """Best score over all ways to cut a short text."""
    if not text:
        return 0
    out = []
    for k in range(1, len(text) + 1):
        s = v.scores.get(text[:k], v.unknown if k == 1 else None)
        if s is not None:
            out.append(s + brute(v, text[k:]))
    return max(out)


def score(v, text, ids):
    total, done = 0, 0
    byte = set(v.byte_ids)
    k = 0
    while k < len(ids):
        if ids[k] in byte:
            n = len(text[done].encode())
            total, done, k = total + v.unknown, done + 1, k + n
        else:
            p = v.table[ids[k]].decode()
            total, done, k = total + v.scores[p], done + len(p), k + 1
    return total


def test_best_score(v):
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice("the and  in\n✓é") for _ in range(r.randint(1, 11)))
        ids = pieces.encoder(v)(t)
        assert score(v, " " + t, list(ids)) == brute(v, " " + t)


def test_words_do_not_change_the_result(v):
    r = random.Random(2)
    enc = pieces.encoder(v)
    for _ in range(200):
        t = "".join(r.choice(("the", "an", " ", "  ", "\n", "ing", "é", "▁", "語", ".", "\t")) for _ in range(r.randint(0, 60)))
        assert list(enc(t)) == (pieces.cut_text(v, " " + t) if t else [])


UNSPACED = ["0123456789" * 500, "漢字仮名交文" * 500, "\t".join(f"{i}\t{i * 7}" for i in range(5000)), "เธกฎ" * 600,
            "".join(random.Random(4).choice("0123456789abcdef") for _ in range(9000))]


def test_long_texts_without_spaces(v):
    enc = pieces.encoder(v)
    for t in UNSPACED:
        assert 2000 < len(t) < 2 * pieces.CHUNK
        ids = enc(t)
        assert list(ids) == pieces.cut_text(v, " " + t) and pieces.decoder(v)(ids.tolist()) == t


def test_stage_of_long_texts_without_spaces(spark, v):
    df = spark.createDataFrame(list(enumerate(UNSPACED)), "id int, text string")
    got = {r.id: (r.round_trip, r.pieces) for r in pieces.round_trip(df).collect()}
    assert got == {i: (True, pieces.cut_text(v, " " + t)) for i, t in enumerate(UNSPACED)}


def test_matches_the_library_as_a_unigram_model(v):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    m.ParseFromString(open(pieces.MODEL, "rb").read())
    m.trainer_spec.model_type = m.trainer_spec.UNIGRAM
    for p in m.pieces:
        if p.type == p.NORMAL:
            p.score = v.scores[p.piece.replace("▁", " ")] / pieces.SCALE
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    enc = pieces.encoder(v)
    for t in ("The quick brown fox jumps over the lazy dog.", "Übung macht den Meister", "el niño come", "x ✓ y\nz"):
        assert list(enc(t)) == lib.encode(t)


def test_chunks_do_not_change_the_result(spark, v, monkeypatch):
    texts = ["a" * 700, "the quick brown fox " * 60, LONG[:3000], "ab " + "x" * 400 + " cd" * 100, "é語▁" * 150, "short", "", None,
             " " * 300, "the" * 200, "\n" * 200 + "end"]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "id int, text string, pieces string")
    got = {r.id: r.pieces for r in pieces.encode(df, chunk=40).collect()}
    assert {(r.id, tuple(r.pieces or ()), r.round_trip) for r in pieces.round_trip(df, chunk=40).collect()} == {
        (i, tuple(got[i] or ()), True) for i in got}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else pieces.cut_text(v, " " + t) if t else []), i


def test_scan_is_the_running_product():
    r = np.random.default_rng(0)
    m = r.integers(-50, 50, (13, 4, 4)).astype(float)
    got, run = pieces.scan(m), m[0]
    for k in range(1, 13):
        run = pieces.combine(run, m[k])
        assert (got[k] == run).all()
    a, b, c = m[:3]
    assert (pieces.combine(pieces.combine(a, b), c) == pieces.combine(a, pieces.combine(b, c))).all()


def test_edge_rows_round_trip(spark, edge_docs):
    out = pieces.round_trip(edge_docs)
    assert out.columns.count("pieces") == 1
    rows = out.select("doc_id", "text", "pieces", "n_pieces", "round_trip").collect()
    assert len(rows) == len(ROWS) and all(r.round_trip for r in rows)
    assert all((r.pieces is None) == (r.text is None) and r.n_pieces == len(r.pieces or []) for r in rows)
    assert pieces.round_trip(documents(spark, [])).count() == 0


def test_decoding_any_ids(spark):
    df = spark.createDataFrame([([],), (None,), ([0, 1, 2],), ([200, 200],), ([28705],)], "pieces array<int>")
    assert [r.decoded for r in pieces.decode(df).select("decoded").collect()] == ["", None, "⁇", "\ufffd\ufffd", ""]


def test_whole_small_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert pieces.round_trip(docs).where(~F.col("round_trip")).count() == 0
