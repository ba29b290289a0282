"""What the operators of this subpackage share: saved intermediate tables, word splitting, components."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts name it: space and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"
WORD = re.compile(f"[^{SPACE}]+")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which the session must name.

    Only in a local session, where driver and executors are one process (tests), a new temporary folder stands in.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder and reads it again: lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str) -> DataFrame:
    return save(df, name)[0]


def drop_saved(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def give_back() -> None:
    """Hands memory that Arrow and the C library hold free back to the system, for the JVM and the other workers of the machine."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


_REMEMBERED: dict = {}


def remembered(owner, make: Callable[[], object]):
    """What a Python worker keeps from one task to the next: of one owner at a time, so that an operator's memory goes when the next one starts."""
    if owner not in _REMEMBERED:
        _REMEMBERED.clear()
        give_back()
        _REMEMBERED[owner] = make()
    return _REMEMBERED[owner]


def nothing_remembered(owner) -> None:
    """For tasks of an operator that keeps nothing: what the one before kept goes."""
    remembered(owner, lambda: None)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Names a row by its id and text. Rows that agree in both are the same row repeated and get equal results."""
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))


def with_text(docs: DataFrame, found: DataFrame, text: Callable[[Column], Column]) -> DataFrame:
    """``docs`` with ``text`` of its texts, for which ``found`` has one row for each ``row_key`` in a column ``key``. No column of ``docs`` is shadowed."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key().alias("key")).join(found, "key")
    return rows.select(*((text(F.col("row.text")) if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows that no model learns from: crc32 of the id as text, modulo 4, is 2. Null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the undirected graph with edges (a, b): rows (node, component), the component named by its least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each written to the shared
    folder, until an iteration leaves the edges as they were. Neighbour minima are partial
    aggregations, so a node with very many neighbours is never gathered in one place; the
    following joins are ordinary shuffled joins whose hot keys adaptive execution splits.
    Null ends and self-loops are ignored; nodes without an edge to another are absent.
    """
    spark = edges.sparkSession

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = save(pairs, name)
    before = state(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b"))).distinct()
        after, new_path = save(small, name)
        drop_saved(spark, path)
        now, path = after, new_path
        if (now_state := state(now)) == before:
            break
        before = now_state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
