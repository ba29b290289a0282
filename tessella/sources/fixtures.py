"""A table of every type that the driver's tables lack, derived from one of them: for queries over types, row groups and page indexes."""

from __future__ import annotations

import tempfile
import uuid
from datetime import date, time, timedelta
from decimal import Decimal
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in a session without one (tests) a new temporary folder."""
    out = spark.conf.get("spark.checkpoint.dir", None)
    if not out:
        out = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", out)
    return out.rstrip("/")


def put(spark: SparkSession, table: pa.Table, **options) -> str:
    """Writes a table as one file into the folder that driver and executors share; its path."""
    sink = pa.BufferOutputStream()
    pq.write_table(table, sink, **options)
    path = f"{folder(spark)}/fixture-{uuid.uuid4().hex}.parquet"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop)
    try:
        out.write(bytearray(sink.getvalue().to_pybytes()))
    finally:
        out.close()
    return path


def typed(spark: SparkSession, part: DataFrame) -> str:
    """The path of a file in four row groups, with page indexes and checksums, made from rows (p_partkey, p_name, p_size, p_retailprice).

    The rows pass through the driver: a fixture for a table of known size, not a way to write large ones.
    """
    t = part.select("p_partkey", "p_name", "p_size", "p_retailprice").orderBy("p_partkey").toArrow()
    key, size, price, name = (t[c].to_pylist() for c in ("p_partkey", "p_size", "p_retailprice", "p_name"))
    cents = [round(100 * x) for x in price]
    clock = [timedelta(milliseconds=61_007 * n) for n in size]
    at = [time(x.seconds // 3600, x.seconds // 60 % 60, x.seconds % 60, x.microseconds) for x in clock]
    out = pa.table({
        "id": pa.array(key, pa.int64()), "f32": pa.array(price, pa.float32()), "f16": pa.array(np.array(size, np.float16)), "flag": pa.array([n % 2 == 0 for n in size]),
        "day": pa.array([date(1990, 1, 1) + timedelta(days=n) for n in size]), "t_ms": pa.array(at, pa.time32("ms")), "t_us": pa.array(at, pa.time64("us")), "t_ns": pa.array(at, pa.time64("ns")),
        "dec": pa.array([Decimal(c).scaleb(-2) for c in cents], pa.decimal128(12, 2)), "signed": pa.array([Decimal(c - 120_000).scaleb(-2) for c in cents], pa.decimal128(18, 2)),
        "uid": pa.ExtensionArray.from_storage(pa.uuid(), pa.array([md5(str(k).encode()).digest() for k in key], pa.binary(16))), "nul": pa.array([None if n == 7 else n for n in size], pa.int32()),
        "u32": pa.array([4_294_967_295 - n for n in size], pa.uint32()), "ns": pa.array([n * 1_000_000_007 for n in size], pa.timestamp("ns")),
        "s": pa.array([None if n % 5 == 0 else {"a": {"b": n}, "c": x} for n, x in zip(size, name, strict=True)], pa.struct([("a", pa.struct([("b", pa.int32())])), ("c", pa.string())])),
        "l": pa.array([[None, [], [None], [n, None, n + 1]][n % 4] for n in size], pa.list_(pa.int32())), "ll": pa.array([[[n], [], [n + 1, 2]] for n in size], pa.list_(pa.list_(pa.int32()))),
        "m": pa.array([[("n", n), ("m", n + 1), ("n", n + 2)] for n in size], pa.map_(pa.string(), pa.int32())),
    })
    return put(spark, out, row_group_size=max(1, -(-len(key) // 4)), write_page_index=True, write_page_checksum=True, data_page_size=2048, use_dictionary=["nul"])
