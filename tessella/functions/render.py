"""Text of values, for tables, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_of(c: Column, kind: T.DataType) -> Column:
    """A value's text: plain decimals, ISO times, bytes as UTF-8 where they are such and else in hexadecimal; null stays null."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.BinaryType):
        return F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(c))))
    if isinstance(kind, T.TimestampType):
        return F.concat(F.regexp_replace(F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz")).cast("string"), " ", "T"), F.lit("Z"))
    if isinstance(kind, T.TimestampNTZType):
        return F.regexp_replace(c.cast("string"), " ", "T")
    if isinstance(kind, T.StructType) and kind.names == ["months", "days", "milliseconds"]:
        return F.when(c.isNotNull(), F.concat(c["months"], F.lit("mo "), c["days"], F.lit("d "), c["milliseconds"], F.lit("ms")))
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(json_of(c, kind))
    return c.cast("string")


def flat_columns(schema: T.StructType) -> list[tuple[str, Column, T.DataType]]:
    """(dotted name, column, type) of a schema's fields, with structs opened."""
    out = []

    def walk(path: list[str], c: Column, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType) and kind.names != ["months", "days", "milliseconds"]:
            for f in kind.fields:
                walk([*path, f.name], c.getField(f.name), f.dataType)
        else:
            out.append((".".join(path), c, kind))

    for f in schema.fields:
        walk([f.name], F.col(f"`{f.name}`"), f.dataType)
    return out


def csv_rows(df: DataFrame) -> DataFrame:
    """Texts under dotted headers; null is ``null``."""
    return df.select(*(F.coalesce(text_of(c, k), F.lit("null")).alias(n) for n, c, k in flat_columns(df.schema)))


def csv_line(values: list[str]) -> str:
    """A line in which values with a comma, quote or line break are quoted."""
    quote = lambda v: '"' + v.replace('"', '""') + '"' if any(ch in v for ch in ',"\n\r') else v
    return ",".join(map(quote, values))


def json_of(c: Column, kind: T.DataType) -> Column:
    """A value with all scalars as text, and containers kept."""
    if isinstance(kind, T.StructType) and kind.names != ["months", "days", "milliseconds"]:
        return F.when(c.isNotNull(), F.struct(*(json_of(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: json_of(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.transform_keys(c, lambda k, _: text_of(k, kind.keyType)), lambda _, v: json_of(v, kind.valueType))
    return c if isinstance(kind, T.VariantType) else text_of(c, kind)


def json_rows(df: DataFrame) -> DataFrame:
    """One column, ``json``: an object for each row."""
    parts = [json_of(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("json"))
