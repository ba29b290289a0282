"""Writing Parquet under explicit policies."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODECS = {"UNCOMPRESSED": "none", "GZIP": "gzip", "SNAPPY": "snappy", "ZSTD": "zstd", "LZ4_RAW": "lz4_raw"}
#: Encodings by the types that they take.
ENCODINGS = {
    "AUTO": None, "PLAIN": None,
    "DELTA_BINARY_PACKED": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType),
    "DELTA_LENGTH_BYTE_ARRAY": (T.StringType, T.BinaryType), "DELTA_BYTE_ARRAY": (T.StringType, T.BinaryType),
    "BYTE_STREAM_SPLIT": (T.FloatType, T.DoubleType, T.IntegerType, T.LongType),
}
REJECT, TRUNCATE = "reject", "truncate"


@dataclass(frozen=True)
class WriterConfig:
    """How to write. ``encodings`` maps columns to encodings; ``encoding`` holds for the others that it fits.

    ``types`` maps columns to what they are stored as: ``decimal(p,s)``, ``timestamp(MILLIS)``, ``timestamp(SECONDS)``,
    ``int8`` to ``int64`` or ``uint8`` to ``uint32``. Values out of range are errors; digits that don't fit are so
    too, or are cut off, by ``precision_loss``.
    """

    codec: str = "ZSTD"
    encoding: str = "AUTO"
    encodings: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    page_size: int = 1 << 20
    row_group_size: int = 128 << 20
    truncate_statistics: int = 64
    precision_loss: str = REJECT
    bloom: tuple[str, ...] = ()

    def check(self, schema: T.StructType) -> None:
        if self.codec not in CODECS:
            raise ValueError(f"codec {self.codec} can't be written; there are {sorted(CODECS)}")
        if self.precision_loss not in (REJECT, TRUNCATE):
            raise ValueError(f"unknown policy {self.precision_loss!r}")
        if min(self.page_size, self.row_group_size, self.truncate_statistics) <= 0:
            raise ValueError("sizes are positive")
        for name, encoding in [*((f.name, self.encoding) for f in schema.fields if f.name not in self.encodings), *self.encodings.items()]:
            if encoding not in ENCODINGS:
                raise ValueError(f"unknown encoding {encoding}")
            if name not in schema.names:
                raise ValueError(f"no column {name!r}")
            kinds = ENCODINGS[encoding]
            if kinds and name in self.encodings and not isinstance(schema[name].dataType, kinds):
                raise ValueError(f"{name}: {encoding} doesn't take {schema[name].dataType.simpleString()}")


def decimal_to(c: Column, source: T.DecimalType, precision: int, scale: int, policy: str = REJECT) -> Column:
    """A decimal at another scale: digits that would be lost are an error, or are cut off towards zero."""
    factor = F.lit(10**scale)
    wide = c.cast(f"decimal(38,{source.scale})")
    cut = (F.when(wide < 0, F.ceil(wide * factor)).otherwise(F.floor(wide * factor)) / factor).cast(f"decimal({precision},{scale})")
    if policy == TRUNCATE:
        return cut
    return F.when(c.isNull() | (cut == c), cut).otherwise(F.raise_error(F.concat(F.lit("loses digits: "), c.cast("string"))))


def timestamp_to(c: Column, unit: str, policy: str = REJECT) -> Column:
    """A timestamp in whole ``unit``: a rest is an error, or is dropped downwards."""
    step = {"MILLIS": 1000, "MICROS": 1, "SECONDS": 1_000_000}[unit]
    micros = F.unix_micros(c)
    cut = F.timestamp_micros(micros - F.pmod(micros, F.lit(step)))
    if policy == TRUNCATE:
        return cut
    return F.when(c.isNull() | (F.pmod(micros, F.lit(step)) == 0), cut).otherwise(F.raise_error(F.concat(F.lit("loses precision: "), c.cast("string"))))


def ranged(c: Column, bits: int, signed: bool) -> Column:
    """An integer that must fit a width; else an error."""
    low, high = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)
    wide = c.cast("decimal(20,0)")
    fits = wide.between(F.lit(low).cast("decimal(20,0)"), F.lit(high).cast("decimal(20,0)"))
    return F.when(c.isNull() | fits, c).otherwise(F.raise_error(F.concat(F.lit(f"out of range for {bits} bits: "), c.cast("string"))))


def nulls_only(c: Column) -> Column:
    """A column that may hold nothing but nulls."""
    return F.when(c.isNull(), c).otherwise(F.raise_error(F.lit("a column of unknown type holds nulls only")))


_KEPT_AS = re.compile(r"(?:(decimal)\((\d+),\s*(\d+)\)|(timestamp)\((MILLIS|MICROS|SECONDS)\)|(u?int)(8|16|32|64))$")


def prepared(df: DataFrame, config: WriterConfig) -> DataFrame:
    """``df`` as ``config.types`` has it stored, under the policies. Columns of unknown type may hold nulls only."""
    out = {f.name: F.col(f"`{f.name}`") for f in df.schema.fields}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NullType):
            out[f.name] = nulls_only(out[f.name]).cast("int")
    for name, kept in config.types.items():
        if name not in out:
            raise ValueError(f"no column {name!r}")
        found, source, c = _KEPT_AS.match(kept), df.schema[name].dataType, out[name]
        if not found:
            raise ValueError(f"{name}: can't be kept as {kept!r}")
        decimal, precision, scale, timestamp, unit, integer, bits = found.groups()
        if decimal and isinstance(source, T.DecimalType):
            fits = F.when(c.isNull() | (F.abs(c.cast(f"decimal(38,{source.scale})")) < F.lit(10) ** (int(precision) - int(scale))), c).otherwise(F.raise_error(F.concat(F.lit(f"out of range for {kept}: "), c.cast("string"))))
            out[name] = decimal_to(fits.cast(source), source, int(precision), int(scale), config.precision_loss)
        elif timestamp and isinstance(source, T.TimestampType):
            out[name] = timestamp_to(c, unit, config.precision_loss)
        elif integer and isinstance(source, T.IntegralType):
            width = {("int", "8"): "byte", ("int", "16"): "short", ("uint", "8"): "short", ("int", "32"): "int", ("uint", "16"): "int"}
            out[name] = ranged(c, int(bits), integer == "int").cast(width.get((integer, bits), "long"))
        else:
            raise ValueError(f"{name}: {source.simpleString()} can't be kept as {kept}")
    return df.select(*(c.alias(name) for name, c in out.items()))


def _options(config: WriterConfig, schema: T.StructType) -> dict[str, str]:
    out = {
        "compression": CODECS[config.codec], "parquet.page.size": config.page_size, "parquet.block.size": config.row_group_size,
        "parquet.statistics.truncate.length": config.truncate_statistics, "parquet.columnindex.truncate.length": config.truncate_statistics,
    }
    for name in config.bloom:
        out[f"parquet.bloom.filter.enabled#{name}"] = "true"
    return {k: str(v) for k, v in out.items()}


def _chosen(config: WriterConfig, schema: T.StructType) -> dict[str, str]:
    """The encodings that were asked for by name, of the columns that they fit."""
    out = {}
    for f in schema.fields:
        encoding = config.encodings.get(f.name, config.encoding)
        kinds, flat = ENCODINGS[encoding], not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        if encoding != "AUTO" and flat and (kinds is None or isinstance(f.dataType, kinds)) and not isinstance(f.dataType, T.BooleanType):
            out[f.name] = encoding
    return out


def _arrow_options(config: WriterConfig, names: list[str], chosen: dict[str, str]) -> dict:
    return {"compression": CODECS[config.codec].replace("lz4_raw", "lz4"), "use_dictionary": [n for n in names if n not in chosen], "column_encoding": chosen or None, "data_page_size": config.page_size, "write_page_index": True}


def _write_encoded(df: DataFrame, path: str, config: WriterConfig, chosen: dict[str, str]) -> None:
    """One file a task, written by Arrow with exactly the encodings asked for, which Spark's writer can't choose by column.

    Each attempt of a task writes a file of its own below ``_temporary``; only those that the finished
    tasks name are moved into place, so a lost executor leaves nothing behind that is read.
    """
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    uri, options, most = str(fs.makeQualified(target).toUri().toString()), _arrow_options(config, df.columns, chosen), config.row_group_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pa.fs.FileSystem.from_uri(uri)
        name, out, held, rows = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet", None, [], 0
        store.create_dir(f"{base}/_temporary", recursive=True)
        for b in batches:
            out = out or pq.ParquetWriter(store.open_output_stream(f"{base}/_temporary/{name}"), b.schema, **options)
            held.append(b)
            rows += b.num_rows
            if sum(x.nbytes for x in held) >= most:
                out.write_table(pa.Table.from_batches(held))
                held = []
        if held:
            out.write_table(pa.Table.from_batches(held))
        if out:
            out.close()
            out.file_handle = None
            yield pa.record_batch({"name": [name], "n": [rows]})

    made = df.mapInArrow(run, "name string, n long").collect()  # a row a task
    for r in made:
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(f"{path}/_temporary/{r['name']}"), jvm.org.apache.hadoop.fs.Path(f"{path}/{r['name']}")):
            raise OSError(f"can't move {r['name']} into {path}")
    if not made:  # no rows: a file with the schema alone
        df.limit(0).write.mode("append").parquet(path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/_temporary"), True)


def write(df: DataFrame, path: str, config: WriterConfig | None = None, mode: str = "errorifexists") -> None:
    """Writes a directory of files under the config's policies; a failed job leaves none behind that would be read.

    Encodings asked for by name are written exactly, by Arrow, in the tasks; so the path must be one that Arrow's file systems reach. Bloom filters are
    Spark's writer's, so a config has one or the other.
    """
    config = config or WriterConfig()
    df = prepared(df, config)
    config.check(df.schema)
    chosen = _chosen(config, df.schema)
    if not chosen:
        df.write.mode(mode).options(**_options(config, df.schema)).parquet(path)
        return
    if config.bloom:
        raise ValueError("named encodings and filters don't go together")
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        if mode in ("error", "errorifexists"):
            raise FileExistsError(path)
        if mode == "ignore":
            return
        if mode == "overwrite":
            fs.delete(target, True)
    _write_encoded(df, path, config, chosen)


def write_file(df: DataFrame, path: str, config: WriterConfig | None = None) -> None:
    """Writes one file. One task writes it all, so this is for results, not for large tables."""
    spark = df.sparkSession
    work = f"{path}.{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(df.coalesce(1), work, config)
        made = [s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(work)) if s.getPath().getName().endswith(".parquet")]
        fs.delete(target, False)
        if not fs.rename(made[0], target):
            raise OSError(f"can't move the file to {path}")
    finally:
        fs.delete(jvm.org.apache.hadoop.fs.Path(work), True)


class FileWriter:
    """Builds one file from rows or column batches in the calling process, under an Arrow schema, and closes it on leaving a ``with`` block.

    Rows are dictionaries; a batch maps every column to its values. A row group is written when about
    ``row_group_size`` bytes are held. A failed block leaves no file.
    """

    def __init__(self, path: str, schema: pa.Schema, config: WriterConfig | None = None):
        self.config, self.schema, self.path = config or WriterConfig(), schema, path
        if self.config.codec not in CODECS:
            raise ValueError(f"codec {self.config.codec} can't be written; there are {sorted(CODECS)}")
        unknown = set(self.config.encodings) - set(schema.names)
        if unknown:
            raise ValueError(f"no column {sorted(unknown)[0]!r}")
        chosen = {n: e for n in schema.names if (e := self.config.encodings.get(n, self.config.encoding)) != "AUTO"}
        self._rows: list[dict] = []
        self._held: list[pa.RecordBatch] = []
        self._out = pq.ParquetWriter(path, schema, **_arrow_options(self.config, schema.names, chosen))

    def row(self, **values) -> None:
        extra = set(values) - set(self.schema.names)
        if extra:
            raise ValueError(f"no column {sorted(extra)[0]!r}")
        self._rows.append(values)
        if len(self._rows) >= 4096:
            self._take()

    def batch(self, columns: dict) -> None:
        if set(columns) != set(self.schema.names):
            raise ValueError(f"a batch has the columns {self.schema.names}")
        self._take()
        self._hold(pa.record_batch([pa.array(columns[f.name], f.type) for f in self.schema], schema=self.schema))

    def _take(self) -> None:
        if self._rows:
            rows, self._rows = self._rows, []
            self._hold(pa.RecordBatch.from_pylist([{n: r.get(n) for n in self.schema.names} for r in rows], self.schema))

    def _hold(self, b: pa.RecordBatch) -> None:
        for f in self.schema:
            if not f.nullable and b.column(f.name).null_count:
                raise ValueError(f"{f.name}: null in a required column")
        self._held.append(b)
        if sum(x.nbytes for x in self._held) >= self.config.row_group_size:
            self._flush()

    def _flush(self) -> None:
        if self._held:
            self._out.write_table(pa.Table.from_batches(self._held))
            self._held = []

    def __enter__(self) -> FileWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self._take()
            self._flush()
        self._out.close()
        if kind is not None:
            os.remove(self.path)
