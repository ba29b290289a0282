"""Footers, row groups, column chunks, pages, indexes and dictionaries as relations.

All are read on the driver from a few kilobytes a file; data pages are never decoded for them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.compact import read_struct
from tessella.sources.files import FileBytes, expand
from tessella.sources.footer import BOUNDARY_ORDERS, CODECS, ENCODINGS, PAGE_TYPES, Footer, Node, named, parse_footer, read_footers
from tessella.sources.schema import find, layers, schema_text

_FORMS = {"INT32": "<i", "INT64": "<q", "FLOAT": "<f", "DOUBLE": "<d"}


def stat_text(node: Node, raw: bytes | None) -> str | None:
    """A statistics value as text, by the column's type."""
    if raw is None:
        return None
    kind = node.logical.kind if node.logical else None
    if node.physical == "BOOLEAN":
        return str(bool(raw[0])).lower()
    if node.physical in _FORMS and len(raw) == struct.calcsize(_FORMS[node.physical]):
        v = struct.unpack(_FORMS[node.physical], raw)[0]
        if kind == "INT" and not node.logical.signed:
            v %= 1 << (8 * len(raw))
        if kind == "DECIMAL":
            from decimal import Decimal

            return str(Decimal(v).scaleb(-node.logical.scale))
        return str(v)
    if kind == "DECIMAL":
        from decimal import Decimal

        return str(Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-node.logical.scale))
    if kind == "UUID":
        from uuid import UUID

        return str(UUID(bytes=raw))
    if kind in ("STRING", "ENUM", "JSON"):
        return raw.decode("utf-8", "replace")
    try:
        return raw.decode("utf-8") if kind is None and raw.decode("utf-8").isprintable() else raw.hex()
    except UnicodeDecodeError:
        return raw.hex()


def _order(node: Node) -> Callable[[bytes], Any] | None:
    """What a column's statistics compare by; None where the format orders them in no way."""
    kind = node.logical.kind if node.logical else None
    if node.physical == "INT96" or kind in ("INTERVAL", "GEOMETRY", "GEOGRAPHY", "VARIANT"):
        return None
    if form := "<e" if kind == "FLOAT16" else _FORMS.get(node.physical):
        if kind == "INT" and not node.logical.signed:
            form = form.upper()
        return lambda raw: struct.unpack(form, raw)[0]
    if kind == "DECIMAL":
        return lambda raw: int.from_bytes(raw, "big", signed=True)
    return bytes


def _bound(node: Node, stats: list[dict[int, Any]], value: int, exact: int, pick: Callable) -> tuple[str | None, bool | None]:
    """The least or largest of the chunks' bounds as text, and whether it is exact; unknown where a chunk has none."""
    order = _order(node)
    if order is None or not stats or any(value not in s for s in stats):
        return None, None
    at = [order(s[value]) for s in stats]
    if any(x != x for x in at):  # NaN bounds nothing
        return None, None
    end = pick(at)
    best = [s for x, s in zip(at, stats, strict=True) if x == end]
    return stat_text(node, best[0][value]), any(s.get(exact) for s in best) or best[0].get(exact)


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def files(spark: SparkSession, *paths: str) -> DataFrame:
    rows = [(f.path, f.size, f.footer_length, f.version, f.num_rows, len(f.row_groups), len(f.leaves), f.created_by, dict(f.key_values), len(f.raw.get(7, []))) for f in read_footers(spark, *paths)]
    return _frame(spark, rows, "path string, size long, footer_length long, version int, num_rows long, row_groups int, columns int, created_by string, key_values map<string,string>, column_orders int")


def row_groups(spark: SparkSession, *paths: str) -> DataFrame:
    rows = []
    for f in read_footers(spark, *paths):
        at = 0
        for k, g in enumerate(f.row_groups):
            start, size = f.group_span(k)
            rows.append((f.path, k, g.get(3, 0), at, g.get(2, 0), start, size))
            at += g.get(3, 0)
    return _frame(spark, rows, "path string, row_group int, num_rows long, first_row long, total_byte_size long, start long, compressed_size long")


_CHUNKS = (
    "path string, row_group int, column int, name string, physical string, logical string, codec string, encodings array<string>, num_values long, uncompressed_size long, "
    "compressed_size long, data_page_offset long, dictionary_page_offset long, min string, max string, null_count long, distinct_count long, min_exact boolean, max_exact boolean, nan_count long, "
    "bloom_offset long, bloom_length int, unencoded_bytes long, repetition_histogram array<long>, definition_histogram array<long>, bbox array<double>, geo_types array<int>, "
    "column_index_offset long, offset_index_offset long"
)


def column_chunks(spark: SparkSession, *paths: str) -> DataFrame:
    rows = []
    for f in read_footers(spark, *paths):
        leaves = f.leaves
        for k, g in enumerate(f.row_groups):
            for i, c in enumerate(g[1]):
                m, node = c[3], leaves[i]
                s, z, geo = m.get(12, {}), m.get(16, {}), m.get(17, {})
                box = geo.get(1)
                rows.append((
                    f.path, k, i, node.dotted, node.physical, str(node.logical) if node.logical else None, named(CODECS, m[4]), [named(ENCODINGS, e) for e in m[2]], m[5], m[6],
                    m[7], m[9], m.get(11), stat_text(node, s.get(6)), stat_text(node, s.get(5)), s.get(3), s.get(4), s.get(8), s.get(7), s.get(9),
                    m.get(14), m.get(15), z.get(1), z.get(2), z.get(3), [float(box[n]) for n in sorted(box)] if box else None, geo.get(2),
                    c.get(6), c.get(4),
                ))
    return _frame(spark, rows, _CHUNKS)


def columns(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per column, over all row groups of all files, numbered as in the first file that has it.

    ``null_count`` is null where a chunk with values doesn't tell its own, ``min`` and ``max`` where one with values other
    than null doesn't, or where the type has no order. Bounds compare as values of the column's type, not as text.
    """
    found: dict[tuple, tuple[Node, list[dict[int, Any]]]] = {}
    for f in read_footers(spark, *paths):
        for node in f.leaves:
            metas = found.setdefault((node.dotted, node.physical, node.logical), (node, []))[1]
            metas.extend(g[1][node.index][3] for g in f.row_groups)
    rows = []
    for node, metas in found.values():
        chunks = [(m[5], m.get(12, {})) for m in metas if m[5]]
        nulls = sum(s[3] for _, s in chunks) if all(3 in s for _, s in chunks) else None
        filled = [s for n, s in chunks if s.get(3) != n]
        rows.append((node.index, node.dotted, node.physical, str(node.logical) if node.logical else None, len(metas), sum(n for n, _ in chunks), nulls, *_bound(node, filled, 6, 8, min), *_bound(node, filled, 5, 7, max)))
    return _frame(spark, rows, "column int, name string, physical string, logical string, chunks int, num_values long, null_count long, min string, min_exact boolean, max string, max_exact boolean")


def leaf_schema(spark: SparkSession, *paths: str) -> DataFrame:
    rows = [
        (f.path, n.index, n.dotted, n.physical, n.length, str(n.logical) if n.logical else None, n.repetition, n.max_def, n.max_rep, n.field_id)
        for f in read_footers(spark, *paths)
        for n in f.leaves
    ]
    return _frame(spark, rows, "path string, column int, name string, physical string, length int, logical string, repetition string, max_definition int, max_repetition int, field_id int")


def layer_shape(footer: Footer, column: str) -> list[str]:
    """The containers above a leaf, outermost first."""
    node = find(footer.root, column)
    chain, at = [], footer.root
    for part in node.path:
        at = next(c for c in at.children if c.name == part)
        chain.append(at)
    top = Node("", (), "REQUIRED")
    tail = top
    for n in chain:
        copy = Node(n.name, n.path, n.repetition, n.physical, n.length, n.logical)
        tail.children, tail = [copy], copy
    return layers(top)


def _pages(source: FileBytes, footer: Footer, k: int, i: int):
    """(offset, header, header's size) of each page of a chunk; only headers are read."""
    m = footer.row_groups[k][1][i][3]
    at = min(x for x in (m.get(11), m[9]) if x)
    end, left = at + m[7], m[5]
    while at < end and left > 0:
        size = 512
        while True:
            try:
                header, used = read_struct(source.read(at, min(size, end - at)))
                break
            except (IndexError, EOFError, struct.error):
                if size > 1 << 24:
                    raise
                size *= 8
        yield at, header, used
        left -= header.get(5, {}).get(1, 0) + header.get(8, {}).get(1, 0)
        at += used + header[3]


def pages(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """One row per page, from page headers."""
    rows = []
    for f in read_footers(spark, *paths):
        source = FileBytes(spark, f.path)
        for k in range(len(f.row_groups)):
            for node in f.leaves:
                if columns is None or node.dotted in columns:
                    for n, (at, h, used) in enumerate(_pages(source, f, k, node.index)):
                        body = h.get(5) or h.get(7) or h.get(8) or {}
                        v2 = 8 in h
                        encoding = body.get(4) if v2 else body.get(2)
                        stats = body.get(8 if v2 else 5, {})
                        rows.append((f.path, k, node.dotted, n, named(PAGE_TYPES, h[1]), named(ENCODINGS, encoding), at, used, h[3], h[2], body.get(1), body.get(2) if v2 else stats.get(3), body.get(3) if v2 else None, stat_text(node, stats.get(6)), stat_text(node, stats.get(5)), 4 in h))
    return _frame(spark, rows, "path string, row_group int, name string, page int, type string, encoding string, offset long, header_size int, compressed_size int, uncompressed_size int, num_values int, null_count long, num_rows int, min string, max string, has_crc boolean")


class _Bytes:
    """A file's content in memory, for ``_pages``."""

    def __init__(self, path: str, content: bytes):
        self.path, self.content, self.size = path, content, len(content)

    def read(self, offset: int, length: int) -> bytes:
        return bytes(self.content[offset : offset + length])


def checksums(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, row_group, name, page, offset, right): whether each page that has a checksum (CRC-32 of its body as stored) fits it.

    Tasks read whole files, one file at a time (each up to 2 GB), wherever Spark can read them.
    """

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                source = _Bytes(path, content)
                footer = parse_footer(source)
                for k in range(len(footer.row_groups)):
                    for node in footer.leaves:
                        for n, (at, h, used) in enumerate(_pages(source, footer, k, node.index)):
                            if 4 in h:
                                rows.append({"path": path, "row_group": k, "name": node.dotted, "page": n, "offset": at, "right": zlib.crc32(source.read(at + used, h[3])) == h[4] % (1 << 32)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("row_group", pa.int32()), ("name", pa.string()), ("page", pa.int32()), ("offset", pa.int64()), ("right", pa.bool_())]))

    files = [f for p in paths for f in expand(spark, p)]
    return spark.read.format("binaryFile").load(files).select("path", "content").mapInArrow(run, "path string, row_group int, name string, page int, offset long, right boolean")


def page_index(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per data page of the chunks that have column and offset indexes."""
    rows = []
    for f in read_footers(spark, *paths):
        source = FileBytes(spark, f.path)
        for k, g in enumerate(f.row_groups):
            for node in f.leaves:
                c = g[1][node.index]
                if 4 not in c:
                    continue
                places = read_struct(source.read(c[4], c[5]))[0][1]
                ci: dict[int, Any] = read_struct(source.read(c[6], c[7]))[0] if 6 in c else {}
                for n, place in enumerate(places):
                    empty = ci[1][n] if 1 in ci else None
                    value = lambda field, n=n, empty=empty, ci=ci, node=node: None if empty or field not in ci else stat_text(node, ci[field][n])
                    rows.append((f.path, k, node.dotted, n, place[1], place[2], place[3], empty, value(2), value(3), ci[5][n] if 5 in ci else None, named(BOUNDARY_ORDERS, ci.get(4))))
    return _frame(spark, rows, "path string, row_group int, name string, page int, offset long, compressed_size int, first_row long, null_page boolean, min string, max string, null_count long, boundary_order string")


_ARROW_CODECS = {"SNAPPY": "snappy", "GZIP": "gzip", "BROTLI": "brotli", "ZSTD": "zstd", "LZ4_RAW": "lz4_raw", "LZ4": "lz4_raw"}


def dictionary(spark: SparkSession, path: str, column: str, limit: int | None = None) -> DataFrame:
    """(row_group, index, value): the entries of a column's dictionary pages."""
    rows = []
    for f in read_footers(spark, path):
        source, node = FileBytes(spark, f.path), find(f.root, column)
        for k, g in enumerate(f.row_groups):
            m = g[1][node.index][3]
            if not m.get(11) or not m[5]:
                continue
            at, header, used = next(_pages(source, f, k, node.index))
            if 7 not in header:
                continue
            body = source.read(at + used, header[3])
            codec = named(CODECS, m[4])
            if codec != "UNCOMPRESSED":
                body = pa.decompress(body, header[2], codec=_ARROW_CODECS[codec], asbytes=True)
            place = 0
            for n in range(min(header[7][1], limit if limit is not None else header[7][1])):
                if node.physical == "BYTE_ARRAY":
                    size = int.from_bytes(body[place : place + 4], "little")
                    place += 4
                else:
                    size = {"INT32": 4, "FLOAT": 4, "INT64": 8, "DOUBLE": 8, "INT96": 12}.get(node.physical, node.length)
                rows.append((k, n, stat_text(node, body[place : place + size])))
                place += size
    return _frame(spark, rows, "row_group int, index int, value string")


def column_summary(spark: SparkSession, *paths: str) -> DataFrame:
    """Columns by their share of the compressed bytes."""
    per = column_chunks(spark, *paths).groupBy("name", "physical").agg(
        F.sum("compressed_size").alias("compressed"), F.sum("uncompressed_size").alias("uncompressed"), F.sum("num_values").alias("num_values"),
        F.sum("null_count").alias("nulls"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("encodings")))).alias("encodings"),
    )
    total = per.agg(F.sum("compressed").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("*", (F.col("compressed") / F.col("total")).alias("share"), (F.col("uncompressed") / F.col("compressed")).alias("ratio")).drop("total").orderBy(F.desc("compressed"), "name")


def schema_of(spark: SparkSession, path: str) -> str:
    return schema_text(read_footers(spark, path)[0])
