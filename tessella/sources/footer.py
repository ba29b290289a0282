"""Parquet footers as typed Python objects (driver side, a few KB a file)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from pyspark.sql import SparkSession

from tessella.sources.compact import read_struct
from tessella.sources.files import FileBytes, expand, in_parallel

# The enumerations of the Parquet format, in the order of their numbers.
PHYSICAL = ("BOOLEAN", "INT32", "INT64", "INT96", "FLOAT", "DOUBLE", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY")
REPETITION = ("REQUIRED", "OPTIONAL", "REPEATED")
CODECS = ("UNCOMPRESSED", "SNAPPY", "GZIP", "LZO", "BROTLI", "LZ4", "ZSTD", "LZ4_RAW")
ENCODINGS = ("PLAIN", "GROUP_VAR_INT", "PLAIN_DICTIONARY", "RLE", "BIT_PACKED", "DELTA_BINARY_PACKED", "DELTA_LENGTH_BYTE_ARRAY", "DELTA_BYTE_ARRAY", "RLE_DICTIONARY", "BYTE_STREAM_SPLIT")
PAGE_TYPES = ("DATA_PAGE", "INDEX_PAGE", "DICTIONARY_PAGE", "DATA_PAGE_V2")
CONVERTED = ("UTF8", "MAP", "MAP_KEY_VALUE", "LIST", "ENUM", "DECIMAL", "DATE", "TIME_MILLIS", "TIME_MICROS", "TIMESTAMP_MILLIS", "TIMESTAMP_MICROS", "UINT_8", "UINT_16", "UINT_32", "UINT_64", "INT_8", "INT_16", "INT_32", "INT_64", "JSON", "BSON", "INTERVAL")
LOGICAL = {1: "STRING", 2: "MAP", 3: "LIST", 4: "ENUM", 5: "DECIMAL", 6: "DATE", 7: "TIME", 8: "TIMESTAMP", 10: "INT", 11: "UNKNOWN", 12: "JSON", 13: "BSON", 14: "UUID", 15: "FLOAT16", 16: "VARIANT", 17: "GEOMETRY", 18: "GEOGRAPHY"}
UNITS = {1: "MILLIS", 2: "MICROS", 3: "NANOS"}
BOUNDARY_ORDERS = ("UNORDERED", "ASCENDING", "DESCENDING")


def named(names, number: int | None) -> str | None:
    if number is None:
        return None
    return names[number] if 0 <= number < len(names) else f"UNKNOWN_{number}"


class BadParquet(OSError):
    """The file isn't a readable Parquet file."""


@dataclass(frozen=True)
class Logical:
    """A logical annotation, promoted from the legacy converted type where only that is given."""

    kind: str
    bits: int | None = None
    signed: bool = True
    unit: str | None = None
    utc: bool = False
    precision: int | None = None
    scale: int = 0
    crs: str | None = None
    algorithm: str | None = None

    def __str__(self) -> str:
        if self.kind == "DECIMAL":
            return f"DECIMAL({self.precision},{self.scale})"
        if self.kind == "INT":
            return f"INTEGER({self.bits},{str(self.signed).lower()})"
        if self.kind in ("TIME", "TIMESTAMP"):
            return f"{self.kind}({self.unit},{str(self.utc).lower()})"
        return self.kind


@dataclass
class Node:
    """A schema element with its place in the tree."""

    name: str
    path: tuple[str, ...]
    repetition: str
    physical: str | None = None
    length: int | None = None
    logical: Logical | None = None
    field_id: int | None = None
    max_def: int = 0
    max_rep: int = 0
    index: int | None = None
    children: list[Node] = field(default_factory=list)

    @property
    def is_leaf(self) -> bool:
        return self.physical is not None

    @property
    def dotted(self) -> str:
        return ".".join(self.path)

    def leaves(self) -> list[Node]:
        return [self] if self.is_leaf else [x for c in self.children for x in c.leaves()]


def _logical(e: dict[int, Any]) -> Logical | None:
    if 10 in e and e[10]:
        number, args = next(iter(e[10].items()))
        kind = LOGICAL.get(number)
        if kind == "DECIMAL":
            return Logical(kind, scale=args.get(1, 0), precision=args.get(2))
        if kind in ("TIME", "TIMESTAMP"):
            return Logical(kind, utc=args.get(1, False), unit=UNITS[next(iter(args[2]))])
        if kind == "INT":
            return Logical(kind, bits=args[1], signed=args.get(2, True))
        if kind in ("GEOMETRY", "GEOGRAPHY"):
            return Logical(kind, crs=args.get(1, b"").decode() or None, algorithm=str(args[2]) if 2 in args else None)
        if kind:
            return Logical(kind)
    kind = named(CONVERTED, e.get(6))
    if kind is None:
        return None
    if kind == "DECIMAL":
        return Logical(kind, scale=e.get(7, 0), precision=e.get(8))
    if kind.startswith(("INT_", "UINT_")):
        return Logical("INT", bits=int(kind.rpartition("_")[2]), signed=kind[0] == "I")
    if kind.startswith("TIME"):
        base, _, unit = kind.partition("_")
        return Logical(base, unit=unit, utc=True)
    return Logical({"UTF8": "STRING", "MAP_KEY_VALUE": "MAP"}.get(kind, kind))


def _tree(elements: list[dict[int, Any]]) -> Node:
    at, leaf = iter(elements), iter(range(len(elements)))

    def build(path: tuple[str, ...], d: int, r: int, root: bool = False) -> Node:
        e = next(at)
        name = e[4].decode()
        repetition = "REQUIRED" if root else named(REPETITION, e.get(3, 0))
        d, r = d + (repetition != "REQUIRED"), r + (repetition == "REPEATED")
        here = () if root else (*path, name)
        node = Node(name, here, repetition, length=e.get(2), logical=_logical(e), field_id=e.get(9), max_def=d, max_rep=r)
        if e.get(5):
            node.children = [build(here, d, r) for _ in range(e[5])]
        elif not root:
            node.physical, node.index = named(PHYSICAL, e[1]), next(leaf)
        return node

    return build((), 0, 0, True)


@dataclass
class Footer:
    """What a file's footer says. ``raw`` keeps all decoded fields by their number."""

    path: str
    size: int
    footer_length: int
    raw: dict[int, Any]
    root: Node

    version = property(lambda self: self.raw.get(1))
    num_rows = property(lambda self: self.raw.get(3, 0))
    created_by = property(lambda self: self.raw[6].decode("utf-8", "replace") if 6 in self.raw else None)

    @property
    def key_values(self) -> list[tuple[str, str | None]]:
        return [(x[1].decode("utf-8", "replace"), x[2].decode("utf-8", "replace") if 2 in x else None) for x in self.raw.get(5, [])]

    @property
    def row_groups(self) -> list[dict[int, Any]]:
        return self.raw.get(4, [])

    @property
    def leaves(self) -> list[Node]:
        return self.root.leaves()

    def group_rows(self) -> list[int]:
        return [g.get(3, 0) for g in self.row_groups]

    def group_span(self, k: int) -> tuple[int, int]:
        """First byte and compressed bytes of row group ``k``."""
        group = self.row_groups[k]
        metas = [c[3] for c in group[1]]
        start = min(m[11] if m.get(11) else m[9] for m in metas) if metas else 0
        return start, group.get(6) or sum(m.get(7, 0) for m in metas)


def parse_footer(source: FileBytes) -> Footer:
    if source.size < 12:
        raise BadParquet(f"{source.path}: too short for a Parquet file")
    tail = source.read(max(0, source.size - 65536), 65536)
    if tail[-4:] == b"PARE":
        raise BadParquet(f"{source.path}: encrypted footers aren't supported")
    if tail[-4:] != b"PAR1":
        raise BadParquet(f"{source.path}: not a Parquet file (bad magic)")
    length = int.from_bytes(tail[-8:-4], "little")
    if length + 12 > source.size:
        raise BadParquet(f"{source.path}: footer length {length} exceeds the file")
    body = tail[-8 - length : -8] if length + 8 <= len(tail) else source.read(source.size - 8 - length, length)
    try:
        raw, _ = read_struct(body)
        root = _tree(raw[2])
    except (IndexError, KeyError, StopIteration, ValueError, EOFError, UnicodeDecodeError) as e:
        raise BadParquet(f"{source.path}: corrupt footer ({e!r})") from e
    return Footer(source.path, source.size, length, raw, root)


@lru_cache(maxsize=4096)
def _cached(path: str, size: int, mtime: float, source_of) -> Footer:
    return parse_footer(source_of())


class _Opener:
    """Hashes alike for all sessions, so that the cache key is the file's state alone."""

    def __init__(self, source: FileBytes):
        self.source = source

    def __call__(self) -> FileBytes:
        return self.source

    def __hash__(self) -> int:
        return 0

    def __eq__(self, other) -> bool:
        return isinstance(other, _Opener)


def read_footer(spark: SparkSession, path: str) -> Footer:
    import os

    source = FileBytes(spark, path)
    mtime = os.path.getmtime(source._plain) if source._plain else float(source._fs.getFileStatus(source._hadoop).getModificationTime())
    return _cached(path, source.size, mtime, _Opener(source))


def read_footers(spark: SparkSession, *paths: str) -> list[Footer]:
    """Footers of all data files below ``paths``, in the order given."""
    files = [f for p in paths for f in expand(spark, p)]
    return in_parallel(lambda f: read_footer(spark, f), files)
