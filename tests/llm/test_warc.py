import gzip
import hashlib

from fleetframe.llm import warc
from tests.llm.cases import bag

BIG, OTHER = "é" * 500 + "\r\n\r\nWARC/1.1\r\n" + "x" * 300, "y" * 1000
PAGES = [(1, "http://a/", BIG), (2, "http://b/", BIG), (3, None, BIG), (4, "http://c/\r\nX: y", "short"), (5, "", "short"),
         (6, "http://d/", None), (7, "http://e/", ""), (8, "http://f/", OTHER), (8, "http://f/", OTHER), (9, "http://g/", OTHER[:-1]),
         (None, "http://h/", OTHER), (10, "http://i/", "z" * 300_000)]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "d") for i, u, h in rows],
                                 "page_id long, url string, html string, row int, digest string")


def plain(rows):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == body and j is not None] if len(body) >= 1000 else []
        last = max(same, default=None)
        ref = last if last is not None and i != last else None
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if ref is None else "revisit", ref))
    return out


def test_round_trip(spark):
    got = warc.round_trip(pages(spark, PAGES)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert bag(got.collect()) == bag(plain(PAGES))


def test_captures_are_whole(spark):
    rows = warc.round_trip(pages(spark, PAGES)).collect()
    for r in rows:
        assert r.request.id and r.metadata.fields["payloadlength"] == str(r.payload_bytes)
        assert (bytes(r.response.payload) == b"") == (r.record_type == "revisit" or r.payload_bytes == 0)
    by = {r.page_id: r for r in rows}
    assert bytes(by[3].response.payload).decode() == BIG and by[1].response.digest == "sha1:" + by[3].payload_digest
    assert by[4].response.target_uri == "http://c/%0D%0AX: y" and by[3].response.target_uri is None


def test_records_without_partners(spark):
    text = "t string, r string, c string"
    rec = spark.createDataFrame([("response", "a", None), ("request", "q", "a"), ("metadata", "m", "gone"), ("response", "b", None)], text)
    from pyspark.sql import functions as F
    full = rec.selectExpr("t as type", "r as record_id", "c as concurrent_to", "'u' as target_uri", "'d' as digest", "'h' as http_head",
                          "cast('p' as binary) as payload").withColumn("fields", F.create_map(F.lit("k"), F.lit("v")))
    out = {r.record_id: r for r in warc.assemble(full).collect()}
    assert set(out) == {"a", "b"} and out["a"].request.id == "q" and out["a"].metadata is None and out["b"].request is None


def test_parser_reads_plain_archives():
    block = "HTTP/1.1 200 OK\r\n\r\n" + BIG
    raw = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block.encode())}\r\n\r\n{block}\r\n\r\n".encode()
    for content in (raw * 2, gzip.compress(raw) + gzip.compress(raw)):
        got = list(warc.parse_archive(content))
        assert [r["payload"].decode() for r in got] == [BIG, BIG] and got[0]["record_id"] == "<x>"


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_archives_are_bounded_by_bytes(spark, scratch_dir):
    """5 MB payloads of random hex, which gzip halves, among short pages and a bound of 4 MB."""
    import glob
    import os
    import random
    rng = random.Random(5)
    sizes = [5_000_000, 5_000_000, *[300_000] * 12, *[900] * 400, 1_500_000, 0]
    rows = [(i, "http://a/", rng.randbytes(n // 2).hex()) for i, n in enumerate(sizes)]
    path, bound = os.path.join(scratch_dir, "warc"), 4_000_000
    warc.write_archives(warc.captures(pages(spark, rows).coalesce(1)), path, archive_bytes=bound)
    files = glob.glob(path + "/**/*.gz", recursive=True)
    for f in files:
        held = [r for r in warc.parse_archive(open(f, "rb").read())]
        big = [r for r in held if r["type"] == "response"]
        assert sum(len(r["payload"]) for r in big) <= bound or len(big) == 1
    assert len(files) < 20  # short pages share one file
    got = warc.assemble(warc.read_records(spark, path)).selectExpr("response.payload_sha1 h", "response.payload_bytes n").collect()
    assert bag((r.h, r.n) for r in got) == bag((hashlib.sha1(h.encode()).hexdigest(), len(h)) for _, _, h in rows)


def test_revisits_name_their_response(spark):
    rows = {r.page_id: r for r in warc.round_trip(pages(spark, PAGES)).collect()}
    assert rows[1].response.refers_to == rows[2].response.refers_to == rows[3].record_id
    assert rows[3].response.refers_to is None
    # The largest id of this payload repeats, so there is no one record to name.
    assert rows[None].record_type == "revisit" and rows[None].response.refers_to is None


def test_archives_are_parsed_once(spark):
    plan = warc.round_trip(pages(spark, PAGES)).select("page_id", "payload_bytes")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1
    # Lengths and digests move in the shuffle, whole payloads do not.
    below = plan[plan.index("Exchange hashpartitioning"):].splitlines()[1]
    assert "AS payload_bytes#" in below and ", payload#" not in below and "[payload#" not in below


def test_several_records_of_a_kind_make_one_row(spark):
    rec = spark.createDataFrame([("response", "a", None), ("request", "q1", "a"), ("request", "q2", "a"), ("response", None, None),
                                 ("warcinfo", "w", None), (None, "x", "a")], "t string, r string, c string")
    from pyspark.sql import functions as F
    full = rec.selectExpr("t as type", "r as record_id", "c as concurrent_to", "'u' as target_uri", "'d' as digest", "'h' as http_head",
                          "cast('p' as binary) as payload").withColumn("fields", F.create_map(F.lit("k"), F.lit("v")))
    out = warc.assemble(full).collect()
    assert [(r.record_id, r.request.id, r.metadata) for r in out] == [("a", "q2", None)]
