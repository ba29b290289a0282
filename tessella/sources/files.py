"""Byte access to input files, by any path that Spark can open."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


def _local(path: str) -> str | None:
    plain = path[5:] if path.startswith("file:") else path
    while plain.startswith("//"):
        plain = plain[1:]
    return plain if ":" not in plain.split("/")[0] and os.path.exists(plain) else None


class FileBytes:
    """Random reads of one file: local files directly, others through Hadoop's FileSystem."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._spark, self._plain = path, spark, _local(path)
        if self._plain:
            self.size = os.path.getsize(self._plain)
        else:
            jvm = spark._jvm
            self._hadoop = jvm.org.apache.hadoop.fs.Path(path)
            self._fs = self._hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
            self.size = self._fs.getFileStatus(self._hadoop).getLen()

    def read(self, offset: int, length: int) -> bytes:
        length = max(0, min(length, self.size - offset))
        if self._plain:
            with open(self._plain, "rb") as f:
                f.seek(offset)
                return f.read(length)
        stream = self._fs.open(self._hadoop)
        try:
            stream.seek(offset)
            return bytes(stream.readNBytes(length))
        finally:
            stream.close()


def expand(spark: SparkSession, path: str) -> list[str]:
    """A directory's data files in name order, or the file itself."""
    plain = _local(path)
    hidden = lambda name: name.startswith(("_", "."))
    if plain:
        if not os.path.isdir(plain):
            return [path]
        return [os.path.join(plain, n) for n in sorted(os.listdir(plain)) if not hidden(n) and os.path.isfile(os.path.join(plain, n))]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(hadoop).isDirectory():
        return [path]
    found = [s.getPath() for s in fs.listStatus(hadoop) if s.isFile()]
    return sorted(p.toString() for p in found if not hidden(p.getName()))


def in_parallel(function, items, threads: int = 16) -> list:
    """``function`` of each item, in order; footers of many files are fetched side by side."""
    if len(items) < 2:
        return [function(x) for x in items]
    with ThreadPoolExecutor(min(threads, len(items))) as pool:
        return list(pool.map(function, items))
