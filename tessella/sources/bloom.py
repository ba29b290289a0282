"""Bloom filters of column chunks: whether a row group may hold a value."""

from __future__ import annotations

import struct
from typing import Any

import xxhash
from pyspark.sql import SparkSession

from tessella.sources.compact import read_struct
from tessella.sources.files import FileBytes
from tessella.sources.footer import Node, read_footer
from tessella.sources.schema import find

# The salts of the Parquet format's split-block filter, one for each word of a block.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def plain(node: Node, value: Any) -> bytes:
    """A value as the format's plain encoding has it, without a length."""
    forms = {"INT32": "<i", "INT64": "<q", "FLOAT": "<f", "DOUBLE": "<d"}
    if node.physical in forms:
        return struct.pack(forms[node.physical], value)
    if node.physical == "BOOLEAN":
        raise ValueError(f"{node.dotted}: booleans have no filter")
    return value.encode() if isinstance(value, str) else bytes(value)


def value_hash(raw: bytes) -> int:
    """XXH64 with seed 0."""
    return xxhash.xxh64_intdigest(raw, 0)


def holds(blocks: bytes, h: int) -> bool:
    """Whether the filter with these 32-byte blocks may hold a value with hash ``h``."""
    at = 32 * (((h >> 32) * (len(blocks) // 32)) >> 32)
    words = struct.unpack_from("<8I", blocks, at)
    return all(w >> (((h & 0xFFFFFFFF) * salt & 0xFFFFFFFF) >> 27) & 1 for w, salt in zip(words, SALTS, strict=True))


def probe(spark: SparkSession, path: str, column: str, values: list) -> list[tuple[Any, bool]]:
    """(value, whether some row group may hold it). A row group without a filter may hold anything."""
    footer = read_footer(spark, path)
    node, source = find(footer.root, column), FileBytes(spark, path)
    filters = []
    for group in footer.row_groups:
        meta = group[1][node.index][3]
        if not meta.get(14):
            return [(v, True) for v in values]
        head = source.read(meta[14], 1024)
        fields, used = read_struct(head)
        filters.append(source.read(meta[14] + used, fields[1]))
    return [(v, any(holds(b, value_hash(plain(node, v))) for b in filters)) for v in values]
