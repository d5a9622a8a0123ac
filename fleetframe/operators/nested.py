"""Nested catalog records: projection, flattening, price match (P1-P6, F2,
F3, J2).

All work happens inside one row with higher-order functions, so a
catalog read is a single scan-project-filter stage with no shuffle; only
the optional final sort and the all-locations join move data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetframe.functions.text import location_key

# Attributes the reference never publishes.
API_EXCLUDE = ("from_dict", "id", "id_or_name")
DATACENTER_EXCLUDE = API_EXCLUDE + ("server_types",)

# Published column orders.
DATACENTER_COLUMNS = (
    "name", "city", "country", "description", "latitude", "longitude",
    "network_zone", "location_name", "location_description",
)
SERVER_TYPE_COLUMNS = (
    "name", "cores", "cpu_type", "memory", "disk", "storage_type",
    "price_hourly_net", "price_hourly_gross", "price_monthly_net",
    "price_monthly_gross", "deprecated",
)
PRICE_GROUPS = ("price_hourly", "price_monthly")


def project_exclude(df: DataFrame, exclude: Sequence[str] = API_EXCLUDE) -> DataFrame:
    """Keep every column except the excluded ones (absent ones are fine)."""
    return df.drop(*[c for c in exclude if c in df.columns])


def _struct_fields(df: DataFrame, col: str) -> list[str]:
    dtype = df.schema[col].dataType
    if not isinstance(dtype, StructType):
        raise TypeError(f"{col} is {dtype.simpleString()}, not a struct")
    return [f.name for f in dtype.fields]


def flatten_struct(df: DataFrame, col: str, prefix: str | None = None,
                   rename: Mapping[str, str] | None = None,
                   exclude: Sequence[str] = ()) -> DataFrame:
    """Lift the fields of struct column ``col`` to the top level.

    ``rename`` maps a field to its new name (applied before the merge, so
    a renamed field never clashes); otherwise the field keeps its name, or
    becomes ``{prefix}_{field}``.  Lifted fields replace same-named
    columns (right-biased merge, like ``dict.update``).  Field names come
    from the schema at plan time, so dynamic keys need no code change.
    """
    rename = dict(rename or {})
    lifted = {}
    for field in _struct_fields(df, col):
        if field in exclude:
            continue
        name = rename.get(field) or (f"{prefix}_{field}" if prefix else field)
        lifted[name] = F.col(col)[field]
    out = df.withColumns(lifted)
    return out if col in lifted else out.drop(col)


def fill_default(df: DataFrame, column: str, value) -> DataFrame:
    """P5: a missing or null ``column`` takes ``value``."""
    if column in df.columns:
        return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))
    return df.withColumn(column, F.lit(value))


def last_match(array: str | Column, key: str, value: Column) -> Column:
    """F2 + last-wins: the last element of ``array`` whose ``key`` field
    equals ``value``; null when none does."""
    arr = F.col(array) if isinstance(array, str) else array
    return F.try_element_at(F.filter(arr, lambda e: e[key] == value), F.lit(-1))


def dedupe_last(array: str | Column, key: str) -> Column:
    """Keep, per ``key`` value, only the last element of ``array`` (the
    reference builds a dict, so later entries win)."""
    arr = F.col(array) if isinstance(array, str) else array
    return F.filter(
        arr,
        lambda e, i: ~F.exists(F.slice(arr, i + 2, F.greatest(F.size(arr), F.lit(1))),
                               lambda later: later[key] == e[key]))


def validate_datacenter(datacenter: str) -> str:
    """E1 on the driver: the datacenter argument must have exactly two
    ``-`` parts; returns its location token."""
    parts = datacenter.split("-")
    if len(parts) != 2:
        raise ValueError(f"datacenter {datacenter!r} must look like 'location-dc'")
    return parts[0]


def prices_at(df: DataFrame, location: str | Column, prices: str = "prices",
              key: str = "location", groups: Sequence[str] = PRICE_GROUPS) -> DataFrame:
    """S2 price step (F2, F3, P3, P4) for one location.

    Picks the last price whose ``key`` equals ``location``, drops rows
    without one, removes ``prices`` and lifts each price group's fields as
    ``{group}_{field}``.
    """
    loc = F.lit(location) if isinstance(location, str) else location
    out = df.withColumn("_ff_price", last_match(prices, key, loc))
    out = out.where(F.col("_ff_price").isNotNull()).drop(prices)
    return _lift_price(out, "_ff_price", key, groups)


def _lift_price(df: DataFrame, col: str, key: str, groups: Sequence[str]) -> DataFrame:
    price_type = df.schema[col].dataType
    lifted = {}
    for field in price_type.fields:
        if field.name == key:
            continue
        if field.name in groups and isinstance(field.dataType, StructType):
            for sub in field.dataType.fields:
                lifted[f"{field.name}_{sub.name}"] = F.col(col)[field.name][sub.name]
        else:
            lifted[field.name] = F.col(col)[field.name]
    return df.withColumns(lifted).drop(col)


def server_types_at(df: DataFrame, datacenter: str, columns: Sequence[str] | None = SERVER_TYPE_COLUMNS,
                    sort: Sequence[str] | None = ("cpu_type", "cores", "name"),
                    prices: str = "prices") -> DataFrame:
    """S2 end to end: ``get_servertypes(datacenter)`` as one lazy plan.

    Sorting is a range-partitioned ``orderBy`` (the reference's key
    ``cpu_type.ljust(100) + f"{cores:05d}"`` is cpu type, then cores;
    ``name`` breaks ties deterministically).
    """
    location = validate_datacenter(datacenter)
    out = fill_default(project_exclude(df), "deprecated", False)
    out = prices_at(out, location, prices)
    if columns is not None:
        out = out.select(*columns)
    return out.orderBy(*sort) if sort else out


def prices_all_locations(types: DataFrame, datacenters: DataFrame, datacenter_col: str = "name",
                         prices: str = "prices", key: str = "location",
                         groups: Sequence[str] = PRICE_GROUPS) -> DataFrame:
    """Every (server type, data center) pair whose price list has the
    data center's location; one row each, last price wins.

    The price array is de-duplicated inside the row, exploded, and
    equi-joined with the data-center table on the location token.
    """
    exploded = (types.withColumn("_ff_price", F.explode(dedupe_last(prices, key)))
                .drop(prices)
                .withColumn("_ff_loc", F.col("_ff_price")[key]))
    dcs = (datacenters.select(F.col(datacenter_col).alias("datacenter"),
                              location_key(datacenter_col).alias("_ff_dc_loc"))
           .where(F.col("_ff_dc_loc").isNotNull()))
    joined = exploded.join(dcs, exploded["_ff_loc"] == dcs["_ff_dc_loc"]).drop("_ff_loc", "_ff_dc_loc")
    return _lift_price(joined, "_ff_price", key, groups)


def priced_at_datacenters(prices: DataFrame, datacenters: DataFrame, location: str = "location",
                          datacenter_col: str = "name") -> DataFrame:
    """J2 on a long price table (one row per type and location): each price
    with every data center of its location, as column ``datacenter``.  No
    array is built."""
    dcs = (datacenters.select(F.col(datacenter_col).alias("datacenter"), location_key(datacenter_col).alias("_ff_dc_loc"))
           .where(F.col("_ff_dc_loc").isNotNull()))
    return prices.join(dcs, prices[location] == dcs["_ff_dc_loc"]).drop("_ff_dc_loc")


def flatten_datacenters(df: DataFrame, columns: Sequence[str] | None = DATACENTER_COLUMNS,
                        location: str = "location") -> DataFrame:
    """S1 end to end (P1, P2, P4, P6): drop unpublished attributes, lift the
    nested location with its ``name``/``description`` renamed to
    ``location_name``/``location_description``, project the 9 columns."""
    out = project_exclude(df, DATACENTER_EXCLUDE)
    out = flatten_struct(out, location, exclude=API_EXCLUDE,
                         rename={"name": "location_name", "description": "location_description"})
    return out.select(*columns) if columns is not None else out
