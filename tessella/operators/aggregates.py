"""Aggregates that readers of column batches compute by hand, as single aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sums(df: DataFrame, *names: str) -> DataFrame:
    """Row count and the sum of each column; nulls are passed over."""
    return df.agg(F.count("*").alias("rows"), *(F.sum(n).alias(f"sum_{n.replace('.', '_')}") for n in names))


def extremes(df: DataFrame, *names: str) -> DataFrame:
    """For each column by its type: least and greatest value, or greatest length of texts, greatest size of lists and maps."""
    out = []
    for n in names:
        kind, flat = df.select(n).schema[0].dataType, n.replace(".", "_")
        if isinstance(kind, T.StringType):
            out.append(F.max(F.length(n)).alias(f"max_length_{flat}"))
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            out.append(F.max(F.size(n)).alias(f"max_size_{flat}"))
        else:
            out += [F.min(n).alias(f"min_{flat}"), F.max(n).alias(f"max_{flat}")]
    return df.agg(*out)


def null_counts(df: DataFrame, *names: str) -> DataFrame:
    return df.agg(*(F.count_if(F.col(n).isNull()).alias(f"nulls_{n.replace('.', '_')}") for n in names))
