"""Access to semi-structured values, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = {
    "boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "string": "string", "binary": "binary",
    "decimal": "decimal(38,9)", "date": "date", "timestamp": "timestamp", "local_timestamp": "timestamp_ntz",
}


def get(v: Column, path: str, kind: str) -> Column:
    """The value at a JSON path such as ``$.a[0].b``; an error if it isn't of ``kind``."""
    return F.variant_get(v, path, TYPES.get(kind, kind))


def try_get(v: Column, path: str, kind: str) -> Column:
    """As ``get``, with null for what isn't of ``kind``."""
    return F.try_variant_get(v, path, TYPES.get(kind, kind))


def kind_of(v: Column) -> Column:
    """The type of a value, as a type's text."""
    return F.schema_of_variant(v)


def is_null_value(v: Column) -> Column:
    """Whether it holds the variant null, which differs from a missing value."""
    return F.is_variant_null(v)


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def to_text(v: Column) -> Column:
    return F.to_json(v)
