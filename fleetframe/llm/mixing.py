"""Mixing sources to target weights.

Each source gets a target number of words.  Whole epochs of a source come
first; the rest of its target is filled by weighted sampling without
replacement after Efraimidis and Spirakis: every document draws an
exponential key scaled by its quality weight, documents are sorted by key
within their source, and the running sum of sizes is cut where it comes
nearest to the rest.

Only DataFrame functions are used.  Tables that grow with the documents
hold a few numbers a row; they are range-partitioned by source and key,
so a hot source is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe.llm.common import col, cut, range_prefix, without, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
# Characters that prose has few of; their share lowers a document's weight.
JUNK = "#$%&*|!"


def text_size(text: Column) -> Column:
    """Number of words (runs of anything but space and ASCII controls 9 to
    13); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """A weight from 0.05 to 1 that falls with the share of junk characters;
    0.05 for null and empty texts."""
    n = F.length(text)
    junk = (n - F.length(F.translate(text, JUNK, ""))) / n
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.05)).otherwise(F.greatest(F.lit(0.05), 1 - 4 * junk))


def uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the values alone."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """(source, source_size) rows with a weight, a target, and its parts.

    Sources in code point order, null last, take the weights in turn.  The
    targets share ``share`` times all sizes by weight; a target stops at
    ``most`` times its source's size and the excess goes to the others by
    weight, until none is above.  Sources without words get target 0.
    """
    w, cap = F.col("weight"), F.col("source_size") * float(most)
    ranked = range_prefix(sizes.withColumn("_ff_null", F.col("source").isNull()), [], ["_ff_null", "source"],
                          F.lit(1).cast("bigint"), "_ff_rank")
    turn = (F.col("_ff_rank") % len(weights) + 1).cast("int")
    s = written(ranked.select("source", "source_size",
                              F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn).alias("weight")))
    total, all_w = s.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level = share * (total or 0), 0.0
    if total:
        level = budget / all_w
        while True:  # each turn stops at least one more source: a few turns of one small sum
            full, free = s.agg(F.sum(F.when(cap <= level * w, cap).otherwise(0.0)),
                               F.sum(F.when(cap > level * w, w).otherwise(0.0))).first()
            new = (budget - full) / free if free else float("inf")
            if new <= level:
                break
            level = new
    target = F.least(cap, F.lit(level) * w) if level != float("inf") else cap
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (s.withColumn("target", target).withColumn("epochs", epochs.cast("bigint"))
            .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
        quality: Column | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` (of the source),
    ``copies`` (times the mix takes the document) and ``taken`` (words).

    A document is taken whole: in every epoch, and once more if the middle
    of its words lies within the rest of the target, so each source ends
    within half a document of its target.  Keys depend on the seed, ``key``
    and the text alone: reruns agree, and rows equal in both (copies of one
    row) are taken or left together.  Null texts have size 0; a null source
    is a source; null keys are drawn by text.  Output columns replace input
    columns of the same name.  An empty table gives no rows.
    """
    out = ("size", "source_size", "target", "copies", "taken")
    drawn = F.struct(
        (-F.log(uniform(seed, col(key), col(text)))
         / (quality if quality is not None else quality_weight(col(text)))).alias("k"),
        col(key).alias("id"), text_size(col(text)).alias("n"))
    rows = without(docs, *out).withColumn("_ff_draw", drawn)
    units = cut(rows.groupBy(col(source).alias("source"), "_ff_draw.k", "_ff_draw.id", "_ff_draw.n")
                .agg(F.count(F.lit(1)).alias("rows"))
                .withColumn("words", F.col("n") * F.col("rows")))
    sources = source_targets(units.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    before = range_prefix(units, ["source"], ["k", "id", "n"], F.col("words"), "before")
    k = F.struct(F.col("source"))
    chosen = (before.withColumn("_ff_s", k)
              .join(sources.select(k.alias("_ff_s"), "rest"), "_ff_s")
              .where((F.col("rest") > 0) & (F.col("before") + F.col("words") / 2 <= F.col("rest")))
              .groupBy("_ff_s").agg(F.max(F.struct("k", "id", "n")).alias("_ff_cut")))
    table = written(sources.withColumn("_ff_s", k).join(chosen, "_ff_s", "left")
                    .select("_ff_s", "source_size", "target", "epochs", "_ff_cut"))
    more = F.when(F.col("_ff_cut").isNotNull() & (F.col("_ff_draw") <= F.col("_ff_cut")), 1).otherwise(0)
    return (rows.withColumn("_ff_s", F.struct(col(source).alias("source"))).join(table, "_ff_s")
            .withColumn("size", F.col("_ff_draw.n"))
            .withColumn("copies", (F.col("epochs") + more).cast("bigint"))
            .withColumn("taken", F.col("size") * F.col("copies"))
            .drop("_ff_s", "_ff_draw", "_ff_cut", "epochs"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each ``copies`` times, with
    all its columns, whatever their names.

    Rows without words (null, empty or blank texts) come once for each whole
    epoch of their source and once more if the draw takes them; null keys and
    sources are treated as in :func:`mix`, rows that repeat are taken or left
    together, long texts are read whole, and an empty table gives no rows.
    """
    columns = docs.columns
    m = mix(docs.select(*[col(c).alias(f"_ff_in_{i}") for i, c in enumerate(columns)],
                        *[col(options.pop(n, d)).alias(d) for n, d in
                          (("text", "text"), ("source", "source"), ("key", "doc_id"))]), **options)
    return (m.withColumn("_ff_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
            .select(*[F.col(f"_ff_in_{i}").alias(c) for i, c in enumerate(columns)]))
