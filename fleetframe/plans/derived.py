"""Fleet-shaped tables derived from the TPC-H-like test tables.

The operators take column names as parameters; these derivations give
them fleet records built by Spark from the given tables, so every query's
work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.sources.tables import Tables


def part_price_rows(t: Tables, location: str | None = None) -> DataFrame:
    """One row per part and region that ships it (only ``location``, if
    given): hourly net/gross = min/max extended price, monthly net/gross =
    min/max quantity.

    Lines are mapped to regions through their supplier, then aggregated by
    (part, region) with a map-side partial aggregate, so the shuffle
    carries at most one row per (map task, part, region).  The location is
    tested on the region table, before anything is aggregated.
    """
    region = t.region.select("r_regionkey", "r_name")
    if location is not None:
        region = region.where(F.col("r_name") == location)
    lines = t.lineitem.select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    # Fact first, then one dimension per join: each join's size estimate is
    # then that of a real table, so only a dimension can be chosen to
    # broadcast (a joined dimension chain is estimated as a product).
    return (lines
                  .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
                  .join(t.nation.select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
                  .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
                  .groupBy("l_partkey", "r_name")
                  .agg(F.min("l_extendedprice").alias("hourly_net"),
                       F.max("l_extendedprice").alias("hourly_gross"),
                       F.min("l_quantity").alias("monthly_net"),
                       F.max("l_quantity").alias("monthly_gross")))


def part_prices(t: Tables, location: str | None = None) -> DataFrame:
    """Per part, a ``prices`` array like a server type's: one entry per
    region that ships it (bounded by the number of regions)."""
    per_region = part_price_rows(t, location)
    entry = F.struct(
        F.col("r_name").alias("location"),
        F.struct(F.col("hourly_net").alias("net"), F.col("hourly_gross").alias("gross")).alias("price_hourly"),
        F.struct(F.col("monthly_net").alias("net"), F.col("monthly_gross").alias("gross")).alias("price_monthly"))
    return (per_region.groupBy("l_partkey")
            .agg(F.array_sort(F.collect_list(entry)).alias("prices")))


def part_catalog(t: Tables, location: str | None = None) -> DataFrame:
    """Parts as server types: ``prices`` is null for parts never shipped
    (from ``location``, if given)."""
    part = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    prices = part_prices(t, location)
    return (part.join(prices, part["p_partkey"] == prices["l_partkey"], "left")
            .drop("l_partkey"))


def region_datacenters(t: Tables) -> DataFrame:
    """Data-center names ``{REGION}-dc{key}`` (two ``-`` parts)."""
    return t.region.select(
        F.concat(F.col("r_name"), F.lit("-dc"), F.col("r_regionkey").cast("string")).alias("name"))


def supplier_datacenters(t: Tables) -> DataFrame:
    """Suppliers as nested data-center records (S1 shape): ``location`` is
    the supplier's nation with its region, and its ``name``/``description``
    collide with the top-level ones."""
    sup = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    nat = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    reg = t.region.select("r_regionkey", "r_name")
    location = F.struct(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("description"),
        F.concat(F.col("n_name"), F.lit(" city")).alias("city"),
        F.col("n_name").alias("country"),
        F.col("n_nationkey").cast("double").alias("latitude"),
        F.col("n_regionkey").cast("double").alias("longitude"),
        F.lower(F.col("r_name")).alias("network_zone"))
    return (sup.join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(reg, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("id"),
                    F.col("s_name").alias("name"),
                    F.format_string("datacenter of supplier %d", F.col("s_suppkey")).alias("description"),
                    location.alias("location")))
