from decimal import Decimal

import pytest

from fleetframe.operators import nested
from tests import fixtures as fx


def test_server_types_at_location(spark):
    types = spark.createDataFrame(fx.SERVER_TYPES, nested_schema())
    out = nested.server_types_at(types, "fsn1-dc14")
    rows = out.collect()
    assert out.columns == list(nested.SERVER_TYPE_COLUMNS)
    names = [r["name"] for r in rows]
    # no price at fsn1 (ccx12) and empty prices (cx31) are dropped;
    # order: cpu type, then cores, then name (cx21/cx22 tie on both)
    assert names == ["ccx52", "cx11", "cx21", "cx22", "cx41"]
    by = {r["name"]: r for r in rows}
    assert by["ccx52"]["price_hourly_net"] == Decimal("0.6000000000")   # last price wins
    assert by["ccx52"]["price_monthly_gross"] == Decimal("427.2100000000")
    assert by["cx21"]["deprecated"] is False                            # null defaulted


def test_invalid_datacenter_raises(spark):
    types = spark.createDataFrame(fx.SERVER_TYPES, nested_schema())
    with pytest.raises(ValueError):
        nested.server_types_at(types, "hel1-dc-2")


def test_fill_default_adds_missing_column(spark):
    df = spark.createDataFrame([(1,)], "id int")
    assert nested.fill_default(df, "deprecated", False).first()["deprecated"] is False


def test_flatten_datacenters(spark):
    dcs = spark.createDataFrame(fx.DATACENTERS, fx.S.DATACENTER)
    out = nested.flatten_datacenters(dcs)
    assert out.columns == list(nested.DATACENTER_COLUMNS)
    row = out.where("name = 'fsn1-dc14'").first()
    assert row["location_name"] == "fsn1"
    assert row["location_description"] == "Falkenstein DC Park 1"
    assert row["description"] == "Falkenstein 1 DC14"
    assert row["city"] == "Falkenstein" and row["network_zone"] == "eu-central"


def test_flatten_struct_prefix_and_right_bias(spark):
    df = spark.createDataFrame([(1, "left", (2.0, "right"))], "id int, name string, p struct<net:double,name:string>")
    out = nested.flatten_struct(df, "p")
    assert out.columns == ["id", "name", "net"]
    assert out.first()["name"] == "right"          # the lifted field replaces the clash
    out2 = nested.flatten_struct(df, "p", prefix="price")
    assert out2.columns == ["id", "name", "price_net", "price_name"]


def test_prices_all_locations(spark):
    types = spark.createDataFrame(fx.SERVER_TYPES, nested_schema())
    dcs = spark.createDataFrame(fx.DATACENTERS, fx.S.DATACENTER).select("name")
    out = nested.prices_all_locations(types, dcs).select("datacenter", "name", "price_hourly_net")
    got = sorted((r[0], r[1], str(r[2])) for r in out.collect())
    # hel1-dc-2 has no valid location key; ccx52 keeps one fsn1 row (last price)
    assert ("fsn1-dc14", "ccx52", "0.6000000000") in got
    assert not [g for g in got if g[0] == "hel1-dc-2"]
    assert len([g for g in got if g[1] == "ccx52"]) == 1
    assert len(got) == 5 + 2


def nested_schema():
    return fx.S.SERVER_TYPE


def test_catalog_from_json_snapshot(spark, scratch_dir):
    import json
    import os
    from fleetframe.sources.tables import read_snapshot
    path = os.path.join(scratch_dir, "server_types.json")
    with open(path, "w") as f:
        for t in fx.SERVER_TYPES:
            prices = [{"location": p[0], "price_hourly": {"net": str(p[1][0]), "gross": str(p[1][1])},
                       "price_monthly": {"net": str(p[2][0]), "gross": str(p[2][1])}} for p in t[9]]
            f.write(json.dumps({"id": t[0], "name": t[1], "description": t[2], "cores": t[3], "cpu_type": t[4],
                                "memory": t[5], "disk": t[6], "storage_type": t[7], "deprecated": t[8],
                                "prices": prices, "unlisted": "dropped by the schema"}) + "\n")
    snap = read_snapshot(spark, path, fx.S.SERVER_TYPE, fmt="json")
    rows = nested.server_types_at(snap, "fsn1-dc14").collect()
    assert [r["name"] for r in rows] == ["ccx52", "cx11", "cx21", "cx22", "cx41"]
    assert rows[0]["price_monthly_net"] == Decimal("359.0000000000")
