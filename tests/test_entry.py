import __spark_entry__ as entry_mod


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["p_partkey", "p_name", "p_brand"]


def test_entry_schema_is_stable(spark):
    first = entry_mod.entry(spark).schema
    second = entry_mod.entry(spark).schema
    assert first == second
    assert [f.name for f in first] == ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice",
                                       "price_hourly_net", "price_hourly_gross", "price_monthly_net",
                                       "price_monthly_gross", "deprecated"]
