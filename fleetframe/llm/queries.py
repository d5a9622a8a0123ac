"""The registered queries of this folder and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.llm import (
    merkle, mixing, permindex, pieces, pii, quality, rules, simhash, topk, toxicity, treap, urlfilter, warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = urlfilter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return j.select("page_id", "host", "path", "rule", "verdict")


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permindex.nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pieces.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.select("doc_id", "n_pieces", "round_trip", "pieces")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = warc.round_trip(_table(spark, sf_dir, "pages"))
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select("doc_id", "held_out", "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(_table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents")).select("doc_id", *rules.BASE, "base_failed", "kept")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_url_filter": op3_url_filter,
    "op4_permutation_index": op4_permutation_index,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_quality_rules": op12_quality_rules,
    "op13_ranked_search": op13_ranked_search,
}

_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, text,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 0.05::DOUBLE
      ELSE greatest(0.05::DOUBLE, 1 - 4 * ((length(text) - length(translate(text, '#$%&*|!', '')))::DOUBLE / length(text))) END AS w,
    (('0x' || substr(md5(concat_ws('|', 'mix-1', doc_id::VARCHAR, text)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / w AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
-- The level at which the targets share the budget: the largest that any number of stopped sources asks for.
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
        1.5::DOUBLE * sum(source_size) OVER () AS budget,
        coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0 * source_size / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
        sum(weight) OVER (ORDER BY 2.0 * source_size / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free_
      FROM r),
t AS (SELECT source, source_size, least(cap, max((budget - full_) / free_) OVER () * weight) AS target FROM o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
        target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest FROM t),
g AS (SELECT source, key, doc_id, size, sum(size) AS words FROM k GROUP BY ALL),
p AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size) - words AS before FROM g)
SELECT k.doc_id, k.size, e.source_size, e.target,
  (k.size * (e.epochs + CASE WHEN e.rest > 0 AND p.before + p.words / 2 <= e.rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
JOIN p ON k.source IS NOT DISTINCT FROM p.source AND k.key = p.key AND k.doc_id IS NOT DISTINCT FROM p.doc_id AND k.size = p.size
"""

_OP3 = r"""
WITH a AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
l(lhost) AS (SELECT x || '.example.' || y FROM (VALUES ('ads-track'), ('cheap-pills'), ('free-bets'), ('spam-farm')) v(x),
  (VALUES ('org'), ('net')) t(y)),
f AS (SELECT a.host, a.path, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
    max_by(r.verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM a) a JOIN r
  ON (a.host = rhost OR ends_with(a.host, '.' || rhost)) AND starts_with(a.path, rpath) GROUP BY ALL)
SELECT page_id, a.host, a.path, f.rule,
  coalesce(f.verdict, CASE WHEN EXISTS (SELECT 1 FROM l WHERE a.host = lhost OR ends_with(a.host, '.' || lhost))
    THEN 'block' ELSE 'allow' END) AS verdict
FROM a LEFT JOIN f ON a.host = f.host AND a.path = f.path
"""

_OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM m
"""

_OP11 = """
WITH RECURSIVE c(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM c WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM c WHERE k = 8),
d AS (SELECT doc_id, lang, n_chars, xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda a, b: xor(crc.t[(xor(a, b) & 255) + 1], a >> 8))) % 7 = 0 AS hit,
    list_transform([doc_id::VARCHAR, source, lang], lambda x: coalesce(strlen(x) || ':' || x, '-')).array_to_string('') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents, crc),
m AS (SELECT *, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS was,
    coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') AS now FROM d),
h AS (SELECT doc_id, lang, sha256(head || was || tail) AS leaf, sha256(head || now || tail) AS changed FROM m),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n FROM h),
nodes AS (
  SELECT lang, 0 AS lvl, idx, leaf AS h, n FROM l
  UNION ALL
  SELECT lang, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, lvl, idx // 2, n),
s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, idx, h, n FROM s
  UNION ALL
  SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY lvl, idx // 2, n),
-- A step is the side of the node and its partner, if any.
low AS (SELECT l.lang, l.idx, list(((l.idx >> v.lvl) & 1)::VARCHAR || coalesce(o.h, '') ORDER BY v.lvl) AS steps
  FROM l JOIN (SELECT DISTINCT lang, lvl FROM nodes WHERE n > 1) v ON l.lang IS NOT DISTINCT FROM v.lang
  LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM l.lang AND o.lvl = v.lvl AND o.idx = xor(l.idx >> v.lvl, 1) GROUP BY l.lang, l.idx),
high AS (SELECT s.lang, list(((s.idx >> v.lvl) & 1)::VARCHAR || coalesce(o.h, '') ORDER BY v.lvl) AS steps
  FROM s CROSS JOIN (SELECT DISTINCT lvl FROM tops WHERE n > 1) v LEFT JOIN tops o ON o.lvl = v.lvl AND o.idx = xor(s.idx >> v.lvl, 1) GROUP BY s.lang),
a AS (SELECT l.*, s.h AS subroot, r.h AS root, coalesce(low.steps, []) || coalesce(high.steps, []) AS steps
  FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT h FROM tops WHERE n = 1) r
  LEFT JOIN low ON low.lang IS NOT DISTINCT FROM l.lang AND low.idx = l.idx LEFT JOIN high ON high.lang IS NOT DISTINCT FROM l.lang),
f AS (SELECT *, list_reduce(list_prepend(changed, steps),
    lambda x, y: sha256(CASE WHEN y[1] = '1' THEN y[2:] || x ELSE x || y[2:] END)) AS folded_root FROM a)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x[2:]), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM f
"""

# Two accuracies a rule, by the place of its vote in the list.
_EM = ", ".join(
    "greatest(0.01, least(0.99, (sum(n * {w} * (v[{j}] = {x})::INT) + {s}) / (sum(n * {w} * (v[{j}] <> 0)::INT) + 10)))::DOUBLE".format(w=w, j=j, x=x, s=s)
    for w, x, s in (("p", 1, 9.5), ("(1 - p)", -1, 5.0)) for j in range(1, 8))
_POSTERIOR = ("1 / (1 + exp(-(ln(q / (1 - q)) + " + " + ".join(
    f"CASE v[{j}] WHEN 1 THEN ln(a[{j}] / (1 - a[{j + 7}])) WHEN -1 THEN ln((1 - a[{j}]) / a[{j + 7}]) ELSE 0 END"
    for j in range(1, 8)) + ")))")

_OP12 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
k AS (SELECT rid, list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS ws FROM w WHERE len(words) > 2),
x AS (SELECT rid, unnest(ws) AS s, generate_subscripts(ws, 1) AS i FROM k),
y AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, s) AS c FROM x) WHERE c > 1),
z AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM y) GROUP BY rid),
c AS (SELECT w.rid, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(z.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    len(list_intersect(words, ['the','of','and','to','in','is','that','der','die','und','zu','le','la','et','de','les','que','el','y','en','los'])) AS n_common,
    len(regexp_extract_all(text, '[\x21-\x40\x5B-\x60\x7B-\x7E]')) AS n_other
  FROM w LEFT JOIN z USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [
    CASE WHEN n_words < 50 THEN -1 WHEN n_words >= 100 THEN 1 ELSE 0 END,
    CASE WHEN word_chars NOT BETWEEN 2 * n_words AND 10 * n_words THEN -1 WHEN word_chars BETWEEN 3 * n_words AND 7 * n_words THEN 1 ELSE 0 END,
    CASE WHEN 10 * n_symbols > n_words THEN -1 WHEN 100 * n_symbols <= n_words THEN 1 ELSE 0 END,
    CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN -1 WHEN n_dup_lines = 0 THEN 1 ELSE 0 END,
    CASE WHEN 2 * n_repeat_words > n_words THEN -1 WHEN 10 * n_repeat_words <= n_words THEN 1 ELSE 0 END,
    CASE WHEN n_common = 0 THEN -1 WHEN n_common >= 2 THEN 1 ELSE 0 END,
    CASE WHEN 4 * n_other > word_chars THEN -1 WHEN 100 * n_other <= 15 * word_chars THEN 1 ELSE 0 END] AS v FROM c),
g AS (SELECT v, count(*) AS n FROM b GROUP BY v),
em(t, q, a) AS (
  SELECT 0, 0.5::DOUBLE, (list_transform(range(7), lambda i: 0.95) || list_transform(range(7), lambda i: 0.5))::DOUBLE[]
  UNION ALL
  SELECT t + 1, greatest(0.5, least(0.95, sum(n * p) / sum(n)))::DOUBLE, [""" + _EM + r"""]
  FROM (SELECT em.t, g.n, g.v, """ + _POSTERIOR + r""" AS p FROM em, g WHERE em.t < 12) GROUP BY t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND """ + _POSTERIOR + r""" >= 0.5 AS kept
FROM b, em WHERE em.t = 12
"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
c AS (SELECT * FROM d WHERE len(terms) > 0),
k AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM c),
p AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(terms) AS term FROM c) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, k GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT q.item_id, c.rid, c.doc_id,
    sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * len(c.terms) * k.n_docs) // k.n_terms))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN c USING (rid) CROSS JOIN k GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""

ORACLE: dict[str, str] = {
    "op1_mixing": _OP1, "op3_url_filter": _OP3, "op8_exact_top_k": _OP8, "op9_warc": _OP9,
    "op11_merkle_manifest": _OP11, "op12_quality_rules": _OP12, "op13_ranked_search": _OP13,
}
