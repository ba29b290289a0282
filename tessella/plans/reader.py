"""Datasets of one file or an ordered list of files, and scans over them.

A scan is a description; ``dataframe()`` checks it against the footers and returns one lazy
DataFrame, in which projection and predicates are ordinary expressions that reach the Parquet
scan. Only ``head`` and ``tail`` order rows: by file and position, which Spark doesn't
keep by itself. ``skip`` behind a predicate counts matches when ``dataframe()`` is called.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans import predicate as P
from tessella.plans.lower import lower
from tessella.sources.footer import BadParquet, Footer, Node, read_footers
from tessella.sources.schema import SchemaError, find, fits, read_schema

OPTIONS = {"metadata-filtering": ("true", "false"), "vectorized": ("auto", "true", "false"), "verify-checksums": ("false", "true")}
_FILE, _ROW = "__file_ordinal", "__row_index"
#: Rows of a file whose matches are counted together to skip matches.
STRETCH = 1 << 20


class BadOptions(ValueError):
    """Scan options that exclude each other."""


@dataclass(frozen=True)
class ByteRange:
    """Row groups whose middle byte lies in [start, end)."""

    start: int
    end: int

    def keeps(self, footer: Footer, k: int) -> bool:
        first, size = footer.group_span(k)
        return self.start <= first + size // 2 < self.end


def byte_range(start: int, end: int) -> ByteRange:
    return ByteRange(start, end)


@dataclass(frozen=True)
class Both:
    parts: tuple

    def keeps(self, footer: Footer, k: int) -> bool:
        return all(p.keeps(footer, k) for p in self.parts)


def both(*parts) -> Both:
    if not parts:
        raise ValueError("needs a row-group predicate")
    return Both(parts)


def _boxes(p: P.Predicate, footer: Footer, k: int) -> bool:
    """Whether the row group may hold matches, as far as bounding boxes tell."""
    if isinstance(p, P.All):
        return all(_boxes(x, footer, k) for x in p.parts)
    if isinstance(p, P.Any_):
        return any(_boxes(x, footer, k) for x in p.parts)
    if not isinstance(p, P.Intersects):
        return True
    leaf = find(footer.root, p.column)
    box = footer.row_groups[k][1][leaf.index][3].get(17, {}).get(1)
    if not box:
        return True
    xmin, xmax, ymin, ymax = (box[i] for i in (1, 2, 3, 4))
    if ymax < p.ymin or ymin > p.ymax:
        return False
    spans = lambda lo, hi: [(lo, hi)] if lo <= hi else [(lo, 180.0), (-180.0, hi)]
    return any(a <= d and c <= b for a, b in spans(xmin, xmax) for c, d in spans(p.xmin, p.xmax))


@dataclass(frozen=True)
class Scan:
    """One read of a dataset. Each method returns a changed copy."""

    dataset: Dataset
    columns: tuple[str, ...] | None = None
    predicate: P.Predicate | None = None
    groups: ByteRange | Both | None = None
    first: int | None = None
    last: int | None = None
    offset: int | None = None

    def projection(self, *names: str) -> Scan:
        if not names:
            raise ValueError("a projection names a column at least")
        return replace(self, columns=tuple(dict.fromkeys(names)))

    def filter(self, predicate: P.Predicate) -> Scan:
        return replace(self, predicate=predicate)

    def row_groups(self, groups: ByteRange | Both) -> Scan:
        return replace(self, groups=groups)

    def head(self, n: int) -> Scan:
        if n <= 0:
            raise BadOptions("head takes a positive number")
        return replace(self, first=n)

    def tail(self, n: int) -> Scan:
        if n <= 0:
            raise BadOptions("tail takes a positive number")
        return replace(self, last=n)

    def skip(self, n: int) -> Scan:
        if n < 0:
            raise BadOptions("skip takes no negative number")
        return replace(self, offset=n)

    def _check(self) -> None:
        if self.last is not None:
            for what, there in (("head", self.first), ("skip", self.offset), ("filter", self.predicate), ("row_groups", self.groups)):
                if there is not None:
                    raise BadOptions(f"tail doesn't go with {what}")
            if len(self.dataset.footers) > 1:
                raise BadOptions("tail reads a single file")

    def _kept(self) -> list[list[tuple[int, int]]]:
        """For each file the row intervals [start, end) that row-group predicates keep."""
        p = P.without_not(self.predicate) if self.predicate is not None else None
        out = []
        for footer in self.dataset.footers:
            at, spans = 0, []
            for k, n in enumerate(footer.group_rows()):
                if (self.groups is None or self.groups.keeps(footer, k)) and (p is None or not self.dataset.metadata_filtering or _boxes(p, footer, k)):
                    spans = [*spans[:-1], (spans[-1][0], at + n)] if spans and spans[-1][1] == at else [*spans, (at, at + n)]
                at += n
            out.append(spans)
        return out

    @staticmethod
    def _cut(kept: list[list[tuple[int, int]]], skip: int, take: int | None) -> list[list[tuple[int, int]]]:
        """Rows ``skip`` to ``skip + take`` of the kept intervals, counted through all files."""
        out = []
        for spans in kept:
            mine = []
            for a, b in spans:
                drop = min(skip, b - a)
                skip -= drop
                n = b - a - drop if take is None else min(take, b - a - drop)
                if n > 0:
                    mine.append((a + drop, a + drop + n))
                    take = None if take is None else take - n
            out.append(mine)
        return out

    def dataframe(self) -> DataFrame:
        self._check()
        d = self.dataset
        names = list(self.columns) if self.columns is not None else None
        used = (names if names is not None else [c.name for c in d.root.children]) + (P.columns_of(self.predicate) if self.predicate is not None else [])
        for footer in d.footers[1:]:
            fits(d.footers[0], footer, used)
        condition = lower(d.root, self.predicate) if self.predicate is not None else None
        wanted = d.output(names)

        kept, ordered = self._kept(), False
        whole = [[(0, n)] if (n := f.num_rows) else [] for f in d.footers]
        if condition is None:
            rows = sum(b - a for spans in kept for a, b in spans)
            if self.last is not None:
                kept = self._cut(kept, max(0, rows - self.last), None)
            elif self.offset or self.first is not None:
                kept = self._cut(kept, self.offset or 0, self.first)
            ordered = self.last is not None or self.first is not None
        else:
            ordered = self.first is not None
        if condition is not None and self.offset:
            kept = self._behind(kept, whole, condition)
        df = self._rows(kept, whole, condition)
        if ordered:
            df = df.orderBy(_FILE, _ROW)
            if condition is not None and self.first is not None:
                df = df.limit(self.first)
        return df.select(*wanted)

    def _rows(self, kept: list[list[tuple[int, int]]], whole: list[list[tuple[int, int]]], condition: Column | None) -> DataFrame:
        """Undecoded rows in the kept intervals that match; files without an interval aren't read."""
        df = self.dataset.raw(files=[k for k, spans in enumerate(kept) if spans])
        part = [k for k, (spans, w) in enumerate(zip(kept, whole, strict=True)) if spans and spans != w]
        if part:
            inside = ~F.col(_FILE).isin(part)
            for k in part:
                for a, b in kept[k]:
                    inside = inside | ((F.col(_FILE) == k) & (F.col(_ROW) >= a) & (F.col(_ROW) < b))
            df = df.where(inside)
        return df if condition is None else df.where(condition)

    def _behind(self, kept: list[list[tuple[int, int]]], whole: list[list[tuple[int, int]]], condition: Column) -> list[list[tuple[int, int]]]:
        """The kept intervals behind the first ``offset`` matches.

        Matches are counted by file and stretch of ``STRETCH`` rows, in one job with partial sums; the
        stretch that the last skipped match lies in is then looked through. So no row is sorted or
        gathered, and files before that match are not read again.
        """
        matches = self._rows(kept, whole, condition).select(_FILE, _ROW)
        stretch = F.floor(F.col(_ROW) / STRETCH).alias("stretch")
        left = self.offset
        for file, at, n in sorted(tuple(r) for r in matches.groupBy(_FILE, stretch).count().collect()):
            if n >= left:
                inside = matches.where((F.col(_FILE) == file) & (F.col(_ROW) >= at * STRETCH) & (F.col(_ROW) < (at + 1) * STRETCH))
                last = inside.orderBy(_ROW).limit(left).agg(F.max(_ROW)).first()[0]
                return [[] if k < file else spans if k > file else [(max(a, last + 1), b) for a, b in spans if b > last + 1] for k, spans in enumerate(kept)]
            left -= n
        return [[] for _ in kept]

    def batches(self, function, schema: str, size: int | None = None) -> DataFrame:
        """``function`` of an iterator of Arrow record batches of the result; ``size`` bounds a batch's rows."""
        if size is not None:
            if size <= 0:
                raise BadOptions("a batch has rows")

            def cut(batches):
                return function(b.slice(at, size) for b in batches for at in range(0, b.num_rows, size))

            return self.dataframe().mapInArrow(cut, schema)
        return self.dataframe().mapInArrow(function, schema)

    def column(self, name: str | int) -> DataFrame:
        """A single column by name, or by its number among the leaves; of one file only."""
        if len(self.dataset.footers) > 1:
            raise BadOptions("a single column is read from a single file")
        if isinstance(name, int):
            name = self.dataset.footers[0].leaves[name].dotted
        return self.projection(name).dataframe()

    def selection(self) -> DataFrame:
        """(path, row_group, rows, kept): what row-group predicates and boxes keep, from footers alone."""
        kept, rows = self._kept(), []
        for footer, spans in zip(self.dataset.footers, kept, strict=True):
            at = 0
            for k, n in enumerate(footer.group_rows()):
                rows.append((footer.path, k, n, any(a <= at and at + n <= b for a, b in spans)))
                at += n
        return self.dataset.spark.createDataFrame(rows, "path string, row_group int, rows long, kept boolean")


@dataclass
class Dataset:
    """An ordered list of Parquet files under the first one's schema."""

    spark: SparkSession
    footers: list[Footer]
    metadata_filtering: bool = True
    raw_values: bool = False
    vectorized: str = "auto"

    @property
    def root(self) -> Node:
        return self.footers[0].root

    @cached_property
    def _schema(self):
        return read_schema(self.footers[0], self.raw_values)

    def scan(self) -> Scan:
        return Scan(self)

    def count(self) -> int:
        """Rows by the footers."""
        return sum(f.num_rows for f in self.footers)

    def output(self, names: list[str] | None) -> list[Column]:
        """Decoded columns in the order of the file, whatever the order of ``names``. A dotted name keeps the structs around it."""
        decoders, tree = self._schema[1], {}
        if names is None:
            tree = {c.name: None for c in self.root.children}
        for name in names or ():
            at, node = tree, find(self.root, name)
            for part in node.path[:-1]:
                if at.get(part, {}) is None:
                    break
                at = at.setdefault(part, {})
            else:
                at[node.path[-1]] = None

        def pick(c: Column, n: Node, sub: dict | None, decode) -> Column:
            inner = n.children[0] if len(n.children) == 1 else None
            if sub is None or (n.logical and n.logical.kind in ("MAP", "VARIANT")) or n.is_leaf:
                return decode(c) if decode else c
            from tessella.sources.schema import spark_type

            if n.logical and n.logical.kind == "LIST":
                item = inner.children[0] if inner.children and len(inner.children) == 1 else inner
                below = sub.get(inner.name)
                below = below.get(item.name) if below and item is not inner else below
                return F.transform(c, lambda x: pick(x, item, below, spark_type(item, self.raw_values)[1]))
            fields = [pick(c.getField(x.name), x, sub[x.name], spark_type(x, self.raw_values)[1]).alias(x.name) for x in n.children if x.name in sub]
            return F.when(c.isNotNull(), F.struct(*fields))

        return [pick(F.col(f"`{c.name}`"), c, tree[c.name], decoders[c.name]).alias(c.name) for c in self.root.children if c.name in tree]

    def raw(self, files: list[int]) -> DataFrame:
        """Undecoded rows of some files, with their file's number and their position in it."""
        schema, spark = self._schema[0], self.spark
        if not files:
            return spark.createDataFrame([], schema).withColumn(_FILE, F.lit(0)).withColumn(_ROW, F.lit(0).cast("long"))
        if len({self.footers[k].path for k in files}) < len(files):  # a file that is listed twice is read twice
            return reduce(DataFrame.union, [self.raw([k]) for k in files])
        df = self._session.read.option("mergeSchema", "false").schema(schema).parquet(*(self.footers[k].path for k in files))
        if len(files) == 1:
            number = F.lit(files[0])
        else:
            tails = [_tail(self.footers[k].path) for k in files]
            number = F.element_at(F.lit(files), F.array_position(F.lit(tails), F.regexp_replace(F.col("_metadata.file_path"), "^[a-zA-Z0-9+.-]*:/*(?=/)", "")).cast("int"))
        return df.withColumn(_FILE, number).withColumn(_ROW, F.col("_metadata.row_index"))

    @cached_property
    def _session(self) -> SparkSession:
        """The user's session, or a copy with settings that this dataset's encodings and types need: a scan keeps those of its own session, and no other dataset is touched."""
        leaves, needs = self.footers[0].leaves, {}
        if any(x.logical and x.logical.kind == "TIMESTAMP" and x.logical.unit == "NANOS" for x in leaves):
            needs["spark.sql.legacy.parquet.nanosAsLong"] = "true"
        split = any(9 in c[3].get(2, ()) for f in self.footers for g in f.row_groups for c in g[1])
        if self.vectorized != "auto" or split:  # Spark's vectorised reader lacks byte-stream split
            needs["spark.sql.parquet.enableVectorizedReader"] = "false" if self.vectorized == "auto" else self.vectorized
        if not self.metadata_filtering:
            needs["spark.sql.parquet.filterPushdown"] = "false"
        needs = {k: v for k, v in needs.items() if self.spark.conf.get(k, None) != v}
        return copied(self.spark, needs) if needs else self.spark


def copied(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session like ``spark`` with other settings, for relations that are read under them."""
    other = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if other.conf.get(k, None) != v and other.conf.isModifiable(k):
            other.conf.set(k, v)
    for k, v in settings.items():
        other.conf.set(k, v)
    return other


def _tail(path: str) -> str:
    """The path without its scheme, percent-encoded as Spark reports it."""
    import re
    from urllib.parse import quote

    return quote(re.sub("^[a-zA-Z0-9+.-]*:/*(?=/)", "", path), safe="/:=+,~@!$&'()*;-._")


def open_dataset(spark: SparkSession, *paths: str, options: dict[str, str] | None = None, raw_values: bool = False) -> Dataset:
    """Opens files, or directories of files in name order, as one dataset.

    ``raw_values`` keeps physical values: unsigned integers as their signed bit pattern, dates and
    times as numbers, strings as bytes. ``verify-checksums`` reads all pages that have a checksum first, in
    tasks, and raises ``BadParquet`` if one doesn't fit. Unknown options are warned of and ignored.
    """
    if not paths:
        raise ValueError("no files to open")
    options = dict(options or {})
    for key in set(options) - set(OPTIONS):
        warnings.warn(f"unknown option {key!r} is ignored", stacklevel=2)
    footers = read_footers(spark, *paths)
    if not footers:
        raise FileNotFoundError(f"no data files below {paths}")
    if options.get("verify-checksums", "false") == "true":
        from tessella.operators.metadata import checksums

        bad = checksums(spark, *paths).where("not right").first()
        if bad:
            raise BadParquet(f"{bad['path']}: row group {bad['row_group']}, {bad['name']}, page {bad['page']}: wrong checksum")
    return Dataset(spark, footers, options.get("metadata-filtering", "true") != "false", raw_values, options.get("vectorized", "auto"))


def concat(scans: list[DataFrame]) -> DataFrame:
    """Rows of several results, one after the other."""
    return reduce(DataFrame.unionByName, scans)


__all__ = ["BadOptions", "ByteRange", "Dataset", "Scan", "SchemaError", "both", "byte_range", "concat", "open_dataset"]
