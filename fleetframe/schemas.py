"""Explicit schemas of the fleet records.

The reference keeps these as dicts and API objects whose columns are
found by reflection.  Catalyst needs them at analysis time, so they are
spelled out here.  Prices are DECIMAL (the reference passes the API's
decimal strings through untouched).
"""

from pyspark.sql import types as T

PRICE = T.StructType([
    T.StructField("net", T.DecimalType(18, 10)),
    T.StructField("gross", T.DecimalType(18, 10)),
])

LOCATION = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("network_zone", T.StringType()),
])

DATACENTER = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("location", LOCATION),
])

SERVER_TYPE_PRICE = T.StructType([
    T.StructField("location", T.StringType()),
    T.StructField("price_hourly", PRICE),
    T.StructField("price_monthly", PRICE),
])

SERVER_TYPE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("cores", T.IntegerType()),
    T.StructField("cpu_type", T.StringType()),
    T.StructField("memory", T.DoubleType()),
    T.StructField("disk", T.IntegerType()),
    T.StructField("storage_type", T.StringType()),
    T.StructField("deprecated", T.BooleanType()),
    T.StructField("prices", T.ArrayType(SERVER_TYPE_PRICE)),
])

SERVER = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("public_ip4", T.StringType()),
    T.StructField("private_net", T.ArrayType(T.StructType([T.StructField("ip", T.StringType())]))),
])


CLUSTER_CONFIG = T.StructType([
    T.StructField("prefix", T.StringType()),
    T.StructField("workers", T.IntegerType()),
    T.StructField("dask_ipc", T.IntegerType()),
    T.StructField("dask_dash", T.IntegerType()),
    T.StructField("dask_nanny", T.IntegerType()),
    T.StructField("wait", T.DoubleType()),
    T.StructField("scheduler", T.StringType()),
    T.StructField("worker", T.StringType()),
    T.StructField("image", T.StringType()),
    T.StructField("datacenter", T.StringType()),
])

SSH_CONFIG = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("fn_private", T.StringType()),
    T.StructField("port", T.IntegerType()),
    T.StructField("compression", T.BooleanType()),
    T.StructField("cipher", T.StringType()),
])

STAGE = T.StructType([
    T.StructField("pipeline_id", T.LongType()),
    T.StructField("stage", T.IntegerType()),
    T.StructField("out", T.BinaryType()),
    T.StructField("err", T.BinaryType()),
    T.StructField("code", T.IntegerType()),
])

TOKEN = T.StructType([
    T.StructField("seq_id", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("token", T.StringType()),
])

COPY_REQUEST = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("path", T.StringType()),
])

CERTIFICATE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("issued", T.TimestampType()),
    T.StructField("valid_days", T.IntegerType()),
])

# Fixed values that must equal the reference's defaults.
DEFAULT_DASK_IPC = 9753
DEFAULT_DASK_DASH = 9756
DEFAULT_DASK_NANNY = 9759
DEFAULT_WAIT = 1.0
DEFAULT_WORKERS = 1
DEFAULT_DATACENTER = "fsn1-dc14"
DEFAULT_SSH_PORT = 22
DEFAULT_SSH_COMPRESSION = True
DEFAULT_SSH_CIPHER = "aes256-gcm@openssh.com"
