"""Compare a registered query with its DuckDB oracle: column names,
column types and the bag of row values (order-insensitive).

Run as a script to check every query:  python tests/oracle_check.py [sf_dir]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import types as T

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def spark_type(dtype: T.DataType) -> str:
    simple = {
        T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.ShortType: "SMALLINT",
        T.ByteType: "TINYINT", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT",
        T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN", T.BinaryType: "BLOB",
        T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP",
        T.TimestampType: "TIMESTAMP WITH TIME ZONE",
    }
    for cls, name in simple.items():
        if isinstance(dtype, cls):
            return name
    if isinstance(dtype, T.DecimalType):
        return f"DECIMAL({dtype.precision},{dtype.scale})"
    return dtype.simpleString().upper()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if hasattr(v, "as_tuple"):  # Decimal
        return str(v.normalize())
    return v


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from __spark_entry__ import oracle_sql, queries
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = queries()[name](spark, sf_dir)
    s_rows = sdf.collect()
    t_spark = time.time() - t0
    s_cols = sdf.columns
    s_types = {f.name: spark_type(f.dataType) for f in sdf.schema.fields}
    result = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    sql = oracle_sql().get(name)
    if sql is None:
        result["status"] = "rows-only"
        return result
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = {c: str(t) for c, t in zip(d_cols, rel.types)}
    d_rows = rel.fetchall()
    result["oracle_rows"] = len(d_rows)
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={sorted(s_cols)} oracle={sorted(d_cols)}")
    else:
        bad = {c: (s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c]}
        if bad:
            problems.append(f"types {bad}")
        order = sorted(s_cols)
        s_idx = [s_cols.index(c) for c in order]
        d_idx = [d_cols.index(c) for c in order]
        s_bag = Counter(tuple(_norm(r[i]) for i in s_idx) for r in s_rows)
        d_bag = Counter(tuple(_norm(r[i]) for i in d_idx) for r in d_rows)
        if s_bag != d_bag:
            only_s = list((s_bag - d_bag).elements())[:3]
            only_d = list((d_bag - s_bag).elements())[:3]
            problems.append(f"values differ; spark-only {only_s} oracle-only {only_d}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} oracle={len(d_rows)}")
    result["status"] = "ok" if not problems else "FAIL"
    result["problems"] = problems
    return result


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from fleetframe.session import get_session
    from __spark_entry__ import queries
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    failed = 0
    for name in names or sorted(queries()):
        try:
            r = compare(spark, name, sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": name, "status": "ERROR", "problems": [repr(e)[:400]]}
        failed += r["status"] in ("FAIL", "ERROR")
        print(r, flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
