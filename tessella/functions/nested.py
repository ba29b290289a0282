"""Access to lists, maps and structs, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def item(c: Column, index: int) -> Column:
    """The 0-based item of a list; an error if it has no such item."""
    return F.when(c.isNull(), None).when((F.size(c) > index) & F.lit(index >= 0), F.get(c, F.lit(index))).otherwise(F.raise_error(F.lit(f"index {index} is out of bounds")))


def map_value(c: Column, key) -> Column:
    """The value of ``key``; of repeated keys the last entry counts."""
    return F.try_element_at(F.filter(F.map_entries(c), lambda e: e["key"] == key), F.lit(-1))["value"]


def map_has(c: Column, key) -> Column:
    return F.map_contains_key(c, key)


def entries(c: Column) -> Column:
    """Entries in file order, repeated keys included."""
    return F.map_entries(c)


def state(c: Column) -> Column:
    """Which of a list's four states: null, empty, first item null, or value."""
    return F.when(c.isNull(), "null").when(F.size(c) == 0, "empty").when(F.get(c, F.lit(0)).isNull(), "null item").otherwise("value")


def total(c: Column, kind: str = "long") -> Column:
    """Sum of a list's items; nulls are passed over."""
    return F.aggregate(c, F.lit(0).cast(kind), lambda s, x: s + F.coalesce(x.cast(kind), F.lit(0).cast(kind)))


def leaf_total(c: Column, depth: int, kind: str = "long") -> Column:
    """Sum of the leaves of lists nested ``depth`` deep."""
    for _ in range(depth - 1):
        c = F.flatten(c)
    return total(c, kind)


def layer_offsets(df: DataFrame, lists: str, part: list[str], order: list[str]) -> DataFrame:
    """Adds ``first`` and ``end``: where a row's items lie among all items of its ``part``, in ``order``.

    Pass a column that names the file (or any unit whose rows one task may hold) as ``part``.
    """
    n = F.greatest(F.size(lists), F.lit(0)).cast("long")
    end = F.sum(n).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("end", end).withColumn("first", F.col("end") - n)


def lockstep(df: DataFrame, c: str) -> DataFrame:
    """One row for each entry of a map: its key and value side by side."""
    return df.select("*", F.explode(F.map_entries(c)).alias("entry")).select(*df.columns, F.col("entry.key").alias("key"), F.col("entry.value").alias("value"))
