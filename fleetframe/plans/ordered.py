"""Ordered per-entity windows that do not put a hot entity in one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key
to one task.  When one key may hold a large share of the rows, the
helpers below take a ``bucket`` column that is non-decreasing in the
order (for example the day of a timestamp, or ``pos div 65536``):

1. the per-row window runs within ``(key, bucket)``, so a hot key is
   spread over as many tasks as it has buckets;
2. a small table with one row per ``(key, bucket)`` carries what crosses
   bucket borders (running offsets, the first value of the next bucket),
   built with partial aggregates on the input where it can be;
3. the two are joined on ``struct(key, bucket)``, the same column the
   window is partitioned by, so the large side is not shuffled again and
   only the small table moves.

``range_bucket`` derives a bucket from the data: ranges of the full order of
about equal size, however skewed the data is.  ``adaptive_bucket`` cuts a given
coarse bucket where it holds too many rows.  With ``bucket=None`` the helpers fall back
to the plain window, which is right when entities are bounded (a
command's stages, a conversation).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THIN = 32  # bounds of ranges are picked among one row in so many
_BK = "_ff_bucket"
_JK = "_ff_jk"


def join_key(keys: Sequence[str], bucket_col: str = _BK) -> Column:
    """``struct(keys..., bucket)``: one column to partition the row-level
    window by and to join the small table on.  Struct equality treats
    null fields as equal, so null keys join like any other, and because
    the window and the join use the same column, the join reuses the
    window's hash partitioning (the large side moves once)."""
    return F.struct(*[F.col(k) for k in keys], F.col(bucket_col))


def _join_small(big: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of the row-level side with the per-(key, bucket) table."""
    s = small.select(join_key(keys).alias(_JK), *[c for c in small.columns if c not in (_BK, *keys)])
    return big.join(s, _JK, "left").drop(_JK)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                value: str | Column, out: str, bucket: Column | None = None,
                inclusive: bool = True) -> DataFrame:
    """Add ``out`` = sum of ``value`` over earlier rows of the same key
    (and the row itself when ``inclusive``), in ``order``."""
    val = F.col(value) if isinstance(value, str) else value
    end = Window.currentRow if inclusive else -1
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumn(out, F.coalesce(F.sum(val).over(w), F.lit(0)))
    b = df.withColumn(_BK, bucket).withColumn("_ff_v", F.coalesce(val, F.lit(0)))
    b = b.withColumn(_JK, join_key(keys))
    w_local = Window.partitionBy(_JK).orderBy(*order)
    local = b.withColumn("_ff_ls", F.sum("_ff_v").over(w_local.rowsBetween(Window.unboundedPreceding, 0)))
    # Bucket totals from the input with a partial hash aggregate (one row
    # per map task and bucket crosses the shuffle), not from the window
    # output, which would sort and window the data a second time.
    totals = b.groupBy(_JK).agg(F.sum("_ff_v").alias("_ff_bs")).select(
        *[F.col(_JK)[k].alias(k) for k in keys], F.col(_JK)[_BK].alias(_BK), "_ff_bs")
    w_small = Window.partitionBy(*keys).orderBy(_BK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, _BK, F.coalesce(F.sum("_ff_bs").over(w_small), F.lit(0)).alias("_ff_off"))
    joined = _join_small(local, offsets, keys)
    own = F.lit(0) if inclusive else F.col("_ff_v")
    return (joined.withColumn(out, F.col("_ff_ls") - own + F.col("_ff_off"))
            .drop(_BK, "_ff_v", "_ff_ls", "_ff_off"))


def row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str,
               bucket: Column | None = None) -> DataFrame:
    """Add ``out`` = 1-based position within the key, as BIGINT.  ``order``
    must be a full tie-break so reruns give the same numbers."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), out, bucket)


def next_row(df: DataFrame, keys: Sequence[str], order: Sequence[str],
             cols: Sequence[str], prefix: str = "next_",
             bucket: Column | None = None) -> DataFrame:
    """Add ``{prefix}{c}`` = value of ``c`` in the next row of the same key
    (``lead``); null on the key's last row.  ``order`` is ascending column
    names and a full tie-break."""
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[F.lead(c).over(w).alias(prefix + c) for c in cols])
    b = df.withColumn(_BK, bucket)
    b = b.withColumn(_JK, join_key(keys))
    w_local = Window.partitionBy(_JK).orderBy(*order)
    local = b.select("*", F.lead(F.lit(True)).over(w_local).alias("_ff_has"),
                     *[F.lead(c).over(w_local).alias("_ff_n_" + c) for c in cols])
    if list(cols) == [order[0]]:
        # Only the leading order column is carried: a bucket's first value
        # is its minimum, a partial hash aggregate on the input.
        firsts = b.groupBy(_JK).agg(F.struct(F.min(order[0]).alias(order[0])).alias("_ff_first"))
    else:
        # Otherwise a partial min_by on the input: sorted map-side, one row
        # per map task and bucket crosses the shuffle (deriving it from the
        # window output would shuffle and sort the data a second time).
        firsts = b.groupBy(_JK).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_ff_first"))
    firsts = firsts.select(*[F.col(_JK)[k].alias(k) for k in keys], F.col(_JK)[_BK].alias(_BK), "_ff_first")
    w_small = Window.partitionBy(*keys).orderBy(_BK)
    following = firsts.select(*keys, _BK, F.lead("_ff_first").over(w_small).alias("_ff_nb"))
    joined = _join_small(local, following, keys)
    for c in cols:
        joined = joined.withColumn(
            prefix + c,
            F.when(F.col("_ff_has").isNotNull(), F.col("_ff_n_" + c)).otherwise(F.col("_ff_nb")[c]))
    return joined.drop(_BK, "_ff_has", "_ff_nb", *["_ff_n_" + c for c in cols])


def range_bucket(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int,
                 out: str = "_ff_range") -> DataFrame:
    """Add ``out``, a bucket for the helpers above: the number of the range of
    (keys, order) that the row falls into, of up to ``ranges`` of about
    equal size.

    The bounds are a sample of the rows themselves, one for each of ``ranges``
    hash values and thus never more, whatever the table's size, and the same in
    every task (one scalar subquery); they place rows and change no result.  A row finds its range by halving steps.  An entity
    with a share of all rows gets that share of the bounds, on the full
    order, so ties in its first column are cut like any rows; entities with
    few rows are seldom cut, so the per-(key, bucket) tables have about one row
    an entity and one a range.  Nothing runs beforehand.
    """
    d = df.withColumn("_ff_at", F.struct(*keys, *order))
    # Thinned by a sample, not by a filter on the hash, which would be moved below whatever computes the keys.
    few = d.select("_ff_at").sample(1 / THIN, 1).withColumn("_ff_h", F.xxhash64("_ff_at"))
    slot = F.pmod(F.shiftright("_ff_h", 8), F.lit(ranges))
    picked = few.groupBy(slot.alias("_ff_slot")).agg(F.min_by("_ff_at", "_ff_h").alias("at"))
    d = d.withColumn("_ff_bounds", picked.select(F.array_sort(F.collect_list("at"))).scalar()).withColumn("_ff_p", F.lit(0))
    for k in reversed(range(ranges.bit_length())):
        ahead = F.col("_ff_p") + (1 << k)
        d = d.withColumn("_ff_p", F.when(F.get("_ff_bounds", ahead - 1) <= F.col("_ff_at"), ahead).otherwise(F.col("_ff_p")))
    return d.withColumn(out, F.col("_ff_p")).drop("_ff_p", "_ff_at", "_ff_bounds")


def adaptive_bucket(df: DataFrame, keys: Sequence[str], order: Sequence[str], coarse: Column,
                    max_rows: int = 1 << 20, out: str = "_ff_abk") -> DataFrame:
    """Add column ``out``, a bucket for the helpers above that holds about
    ``max_rows`` rows per (key, bucket) at most, however the rows are skewed
    and however many share a value.

    ``coarse`` is a bucket non-decreasing in ``order`` (e.g. the day).  A
    hash of key and order marks one row in ``max_rows / 8`` as a border; the
    fine index is the number of borders of the (key, coarse) group at or
    below the row, found by binary search.  Borders are cut on the full
    order, so ties in its first column are split like any rows; the result
    ``struct(coarse, fine)`` is non-decreasing in the order, so results stay
    exact, and only the balance is left to chance.  Nothing is counted or
    run beforehand, and groups far smaller than ``max_rows`` have no border.
    """
    d = df.withColumn("_ff_c", coarse)
    at = F.struct(*order)
    every = max(max_rows // 8, 1)
    borders = (d.where(F.pmod(F.xxhash64(*keys, *order), F.lit(every)) == 0)
               .groupBy(join_key(keys, "_ff_c").alias(_JK)).agg(F.array_sort(F.collect_set(at)).alias("_ff_cuts")))
    j = d.withColumn(_JK, join_key(keys, "_ff_c")).join(borders, _JK, "left")
    cuts, n = F.col("_ff_cuts"), F.coalesce(F.size("_ff_cuts"), F.lit(0))
    # (lo, hi) close in on the first border above the row.
    turns = F.array_repeat(F.lit(0), F.ceil(F.log2(n + 1)).cast("int") + 1)
    found = F.aggregate(
        F.when(n > 0, turns).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(0).alias("lo"), n.alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).when(
            F.element_at(cuts, F.floor((s["lo"] + s["hi"]) / 2).cast("int") + 1) <= at,
            F.struct((F.floor((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi"))))
    return (j.withColumn(out, F.struct(F.col("_ff_c").alias("c"), found["lo"].alias("f")))
            .drop(_JK, "_ff_cuts", "_ff_c"))
