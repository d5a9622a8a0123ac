from pyspark.sql import functions as F

from fleetframe.plans import derived
from fleetframe.sources.tables import Tables
from tests.conftest import SF_SMALL


def test_price_arrays_are_bounded_by_regions(spark):
    """The per-part collect_list gathers one entry per region, never more."""
    t = Tables(spark, SF_SMALL)
    n_regions = t.region.count()
    prices = derived.part_prices(t)
    worst = prices.select(F.max(F.size("prices")).alias("m")).first()["m"]
    assert 0 < worst <= n_regions
    locs = prices.select(F.transform("prices", lambda p: p["location"]).alias("l")).collect()
    assert all(r["l"] == sorted(set(r["l"])) for r in locs)     # distinct and sorted


def test_supplier_datacenters_collide_on_name(spark):
    dc = derived.supplier_datacenters(Tables(spark, SF_SMALL))
    assert {"name", "description"} <= {f.name for f in dc.schema["location"].dataType.fields}
