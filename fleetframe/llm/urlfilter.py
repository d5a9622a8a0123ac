"""URL rules decided through cascades of Bloom filters.

A cascade stores a set of listed keys so that every key of a known universe
(all keys that the corpus holds) is decided without error: level 1 encodes
the listed keys, level 2 the keys of the universe that level 1 takes wrongly,
level 3 the listed keys that level 2 takes wrongly, and so on until no key
is taken wrongly.  A key is listed if the first level that lacks it has an
even number.  Pages are tested by bit look-ups alone, without joins.

The first level's error rate falls with the ratio of listed to other keys,
so the second level is about as large as the list: all levels together
have a few bits for each listed key times the logarithm of that ratio.
Their size follows the list that the caller passes, not the corpus.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.llm.common import col, without, written

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Hosts listed for blocking where no rule fits (their subdomains included).
LISTED_HOSTS = ("ads-track.example.org", "cheap-pills.example.org", "free-bets.example.org",
                "spam-farm.example.org", "ads-track.example.net", "cheap-pills.example.net",
                "free-bets.example.net", "spam-farm.example.net")


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its 64-bit words, number of hashes, and seed."""

    words: tuple[int, ...]
    hashes: int
    seed: int


def _bits(key: Column, n_bits: int, hashes: int, seed: int) -> Column:
    """The key's bit positions: double hashing of two 64-bit hashes."""
    a, b = F.xxhash64(key, F.lit(seed)), F.xxhash64(key, F.lit(-seed - 1))
    return F.array(*[F.pmod(F.pmod(a, F.lit(n_bits)) + i * F.pmod(b, F.lit(n_bits)), F.lit(n_bits))
                     for i in range(hashes)])


def _has(key: Column, level: Level) -> Column:
    """Whether the filter may hold the key.  The words are one literal of
    the plan, however many they are: Spark folds the cast text once."""
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    return F.forall(_bits(key, 64 * len(level.words), level.hashes, level.seed),
                    lambda p: F.getbit(F.element_at(words, (p / 64 + 1).cast("int")), (p % 64).cast("int")) == 1)


def _of(values: dict[int, Column]) -> Column:
    """The value for the row's cascade ``c``; null for others."""
    return F.coalesce(*[F.when(F.col("c") == c, v) for c, v in values.items()])


def _encode(keys: DataFrame, live: dict[int, tuple[int, float]], seed: int) -> dict[int, Level]:
    """A filter for each cascade ``c`` of ``live`` (its number of rows and
    error rate) over the rows of ``keys`` (c, key), built by partial
    aggregates in one job; its words are one bounded row for each 64 bits."""
    shape = {}
    for c, (n, rate) in live.items():
        n_words = max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
        shape[c] = (n_words, min(max(1, round(64 * n_words / max(n, 1) * math.log(2))), 30), seed + 100 * c)
    p = F.col("p")
    bits = _of({c: _bits(F.col("key"), 64 * w, h, x) for c, (w, h, x) in shape.items()})
    rows = (keys.select("c", F.explode(bits).alias("p"))
            .groupBy("c", (p / 64).cast("int").alias("i"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("w")).collect())
    words = {c: [0] * w for c, (w, _, _) in shape.items()}
    for c, i, w in rows:
        words[c][i] = w
    return {c: Level(tuple(words[c]), h, x) for c, (_, h, x) in shape.items()}


def _counts(keys: DataFrame) -> dict[int, int]:
    """The rows of each cascade that has any."""
    return {c: n for c, n in keys.groupBy("c").count().collect()}


def build_cascades(lists: Sequence[DataFrame], universe: DataFrame, seed: int = 1) -> list[list[Level]]:
    """For each of ``lists``, the levels for its distinct ``key`` rows within
    the distinct ``key`` rows of ``universe``.  No levels: nothing is listed.
    The cascades grow together, each round a level of all of them in the same
    jobs, so a round costs what its largest cascade does."""
    named = reduce(DataFrame.unionByName, [x.select(F.lit(c).alias("c"), "key") for c, x in enumerate(lists)])
    inside = written(named.join(universe, "key", "left_semi"))
    n_all = universe.count()
    live = {c: (n, min(0.5, n / math.sqrt(2) / max(n_all - n, 1))) for c, n in _counts(inside).items()}
    levels: list[list[Level]] = [[] for _ in lists]
    current, outside, at = inside, None, 0
    while live:
        made = _encode(current, live, seed + at)
        for c, level in made.items():
            levels[c].append(level)
        at += 1
        # The keys of the other kind that this level takes wrongly.
        if outside is None:
            taken = F.array_compact(F.array(*[F.when(_has(F.col("key"), x), F.lit(c)) for c, x in made.items()]))
            wrong = universe.select("key", F.explode(taken).alias("c")).join(inside, ["c", "key"], "left_anti").select("c", "key")
        else:
            wrong = (outside if at % 2 else inside).where(_of({c: _has(F.col("key"), x) for c, x in made.items()}))
        wrong = written(wrong)
        if at % 2:
            outside = wrong
        else:
            inside = wrong
        current, live = wrong, {c: (n, 0.5) for c, n in _counts(wrong).items()}
    return levels


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 1) -> list[Level]:
    """The levels for one list."""
    return build_cascades([listed], universe, seed)[0]


def listed(key: Column, levels: Sequence[Level]) -> Column:
    """Whether the key is listed; exact for keys of the cascade's universe."""
    answer = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels), 0, -1):
        answer = F.when(_has(key, levels[i - 1]), answer).otherwise(F.lit(i % 2 == 0))
    return answer


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, A-Z lower-cased; empty for null urls and urls without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _keys(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """The host's endings of up to ``labels`` labels, each with every start
    of the path that has one of the lengths, longest host first."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    hosts = F.transform(F.sequence(F.least(n, F.lit(labels)), F.lit(1), F.lit(-1)),
                        lambda k: F.concat_ws(".", F.slice(parts, -k, k)))
    starts = F.array(*[F.substring(path, 1, x) for x in sorted(set(lengths), reverse=True)])
    fits = F.array(*[F.length(path) >= x for x in sorted(set(lengths), reverse=True)])
    starts = F.transform(F.filter(F.arrays_zip(starts.alias("s"), fits.alias("f")), lambda x: x["f"]), lambda x: x["s"])
    return F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda s: F.concat(h, s))))


def _table(spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    """The distinct keys, from one literal of the plan."""
    all_keys = F.from_json(F.lit(json.dumps(sorted(set(keys)))), "array<string>")
    return spark.range(1).select(F.explode(all_keys).alias("key"))


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
          listed_hosts: Sequence[str] = LISTED_HOSTS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are (allow or block, host, start of the path); a rule fits its
    host and all subdomains.  The longest fitting rule (host and path
    together; of equally long ones that with the longer host) gives the
    verdict; a rule listed for both is a block.  Where none fits, ``rule`` is
    null and urls on a listed host or its subdomains are blocked, others
    allowed.  Null, empty and malformed urls have empty host and path and are
    allowed.  Output columns replace input columns of the same name.
    """
    spark = pages.sparkSession
    work = (without(pages, "host", "path", "rule", "verdict")
            .withColumn("host", url_host(col(url))).withColumn("path", url_path(col(url))))
    labels = max([h.count(".") + 1 for _, h, _ in rules] + [h.count(".") + 1 for h in listed_hosts] + [1])
    rule_keys = _keys(F.col("host"), F.col("path"), labels, [len(p) for _, _, p in rules] or [0])
    host_keys = _keys(F.col("host"), F.lit(""), labels, [0])
    universe = written(work.select("host", "path").distinct()
                       .select(F.explode(F.array_union(rule_keys, host_keys)).alias("key")).distinct())
    rule_lists = [[h + p for a, h, p in rules if a == kind] for kind in ("block", "allow")]
    block, allow, hosts = build_cascades([_table(spark, x) for x in (*rule_lists, listed_hosts)], universe)
    hits = F.transform(
        F.filter(rule_keys, lambda k: listed(k, block) | listed(k, allow)),
        lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), listed(k, block).alias("block")))
    # array_max would break ties by text; the keys come longest host first.
    best = F.aggregate(hits, F.lit(None).cast("struct<n:int,key:string,block:boolean>"),
                       lambda a, x: F.when(a.isNull() | (x["n"] > a["n"]), x).otherwise(a))
    by_host = F.exists(host_keys, lambda k: listed(k, hosts))
    return (work.withColumn("_ff_best", best).withColumn("rule", F.col("_ff_best.key"))
            .withColumn("verdict", F.when(F.coalesce(F.col("_ff_best.block"), by_host), "block").otherwise("allow"))
            .drop("_ff_best"))
