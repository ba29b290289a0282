"""Parquet files held in memory, and record iteration."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Row, SparkSession


def from_buffers(spark: SparkSession, *buffers: bytes) -> DataFrame:
    """Rows of Parquet files given as bytes (each up to 2 GB), in their order. Also reads what only Arrow decodes, as Brotli pages."""
    if not buffers:
        raise ValueError("no buffers")
    return spark.createDataFrame(pa.concat_tables([pq.read_table(pa.BufferReader(b)) for b in buffers]))


def records(df: DataFrame) -> Iterator[Row]:
    """Rows one by one; one partition at a time reaches the driver."""
    return df.toLocalIterator(prefetchPartitions=True)
