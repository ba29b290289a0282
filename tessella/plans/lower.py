"""Checks a predicate against a Parquet schema and turns it into a Column that Spark can push down."""

from __future__ import annotations

import math
from datetime import date, datetime, time, timedelta, timezone
from decimal import Decimal
from functools import reduce
from typing import Any
from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import convert
from tessella.plans import predicate as P
from tessella.sources.footer import Node
from tessella.sources.schema import SchemaError, find

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def reference(node: Node) -> Column:
    return F.col(".".join(f"`{part}`" for part in node.path))


def _ordered(c: Column, op: str, v: Any) -> Column:
    return {"eq": c == v, "ne": c != v, "lt": c < v, "le": c <= v, "gt": c > v, "ge": c >= v}[op]


def total_order(c: Column, op: str, v: float, kind: str) -> Column:
    """Comparison in the total order of floats: -0.0 below 0.0, all NaN equal and above infinity.

    Written so that min/max pruning, which knows neither NaN nor the zeros' signs, can't drop a match:
    what NaN satisfies is OR-ed with isnan, which isn't pushed down; and the zeros are told
    apart by text, never together with an equality that constant propagation could use.
    """
    nan, text = F.isnan(c), c.cast("string")
    lit = F.lit(v).cast(kind)
    if math.isnan(v):
        real = c.isNotNull() & ~nan
        return {"eq": nan, "ge": nan, "gt": F.lit(False), "lt": real, "ne": real, "le": c.isNotNull()}[op]
    if op == "ne":
        return (c.isNotNull() & ~total_order(c, "eq", v, kind)) | nan
    if v == 0:
        negative = math.copysign(1, v) < 0
        zero = text == ("-0.0" if negative else "0.0")
        if op == "eq":
            return zero
        if op == ("le" if negative else "lt"):
            return (c < lit) | (text == "-0.0")
        if op == ("gt" if negative else "ge"):
            return (c > lit) | (text == "0.0") | nan
    plain = _ordered(c, op, lit)
    return plain | nan if op in ("gt", "ge") else plain


def _integer(v: Any, bits: int, column: str) -> int:
    if not -(1 << (bits - 1)) <= v < 1 << (bits - 1):
        raise ValueError(f"{column}: {v} doesn't fit {bits} bits")
    return v


def _units(v: datetime, unit: str) -> int:
    """Whole units since 1970, what is smaller dropped downwards. A time without zone counts as UTC."""
    v = v if v.tzinfo else v.replace(tzinfo=timezone.utc)
    micros = (v - _EPOCH) // timedelta(microseconds=1)
    return {"MILLIS": micros // 1000, "MICROS": micros, "NANOS": micros * 1000}[unit]


def _instant(node: Node, v: datetime) -> tuple[Column, Column]:
    lo = node.logical
    if node.physical != "INT64" or not lo or lo.kind != "TIMESTAMP":
        raise ValueError(f"{node.dotted}: an instant compares with 64-bit timestamps only")
    units = _units(v, lo.unit)
    if lo.unit == "NANOS":
        return reference(node), F.lit(_integer(units, 64, node.dotted)).cast("long")
    moment = _EPOCH + timedelta(microseconds=units * (1000 if lo.unit == "MILLIS" else 1))
    text = moment.strftime("%Y-%m-%d %H:%M:%S.%f")
    return reference(node), F.expr(f"TIMESTAMP '{text} UTC'" if lo.utc else f"TIMESTAMP_NTZ '{text}'")


def _pair(node: Node, v: Any) -> tuple[Column, Column]:
    """The column and the literal to compare with it, of one type, for all but floats."""
    c, lo, kind = reference(node), node.logical, node.logical.kind if node.logical else None
    wrong = ValueError(f"{node.dotted}: a {type(v).__name__} literal doesn't compare with {node.physical}{f' ({lo})' if lo else ''}")
    if isinstance(v, P.Typed):
        if v.physical != node.physical:
            raise ValueError(f"{node.dotted}: is {node.physical}, the literal {v.physical}")
        v = v.value
    if isinstance(v, bool):
        if node.physical != "BOOLEAN":
            raise wrong
        return c, F.lit(v)
    if isinstance(v, int):
        if node.physical not in ("INT32", "INT64") or kind == "DECIMAL":
            raise wrong
        bits = 32 if node.physical == "INT32" else 64
        if kind == "DATE":
            return F.unix_date(c), F.lit(_integer(v, bits, node.dotted))
        if kind == "TIMESTAMP" and lo.unit != "NANOS":
            return convert.epoch(lo.unit, lo.utc)(c), F.lit(_integer(v, bits, node.dotted)).cast("long")
        unsigned = kind == "INT" and not lo.signed
        return c, F.lit(v if unsigned else _integer(v, bits, node.dotted)).cast("decimal(20,0)" if unsigned and bits == 64 else "long" if bits == 64 or unsigned else "int")
    if isinstance(v, datetime):
        return _instant(node, v)
    if isinstance(v, date):
        if node.physical != "INT32":
            raise wrong
        return (c, F.lit(v)) if kind == "DATE" else (c, F.lit((v - date(1970, 1, 1)).days))
    if isinstance(v, time):
        if kind != "TIME":
            raise wrong
        micros = ((v.hour * 60 + v.minute) * 60 + v.second) * 1_000_000 + v.microsecond
        units = {"MILLIS": micros // 1000, "MICROS": micros, "NANOS": micros * 1000}[lo.unit]
        return c, F.lit(units).cast("int" if node.physical == "INT32" else "long")
    if isinstance(v, Decimal):
        if kind != "DECIMAL":
            raise wrong
        if v != v.quantize(Decimal(1).scaleb(-lo.scale)):
            raise ValueError(f"{node.dotted}: {v} has more than {lo.scale} decimal places")
        if abs(v) >= Decimal(10) ** (lo.precision - lo.scale):
            raise ValueError(f"{node.dotted}: {v} exceeds {lo}")
        return c, F.lit(str(v)).cast(f"decimal({lo.precision},{lo.scale})")
    if isinstance(v, UUID):
        if kind != "UUID":
            raise wrong
        return c, F.unhex(F.lit(v.hex))
    if isinstance(v, (str, bytes)):
        if node.physical not in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY") or kind in ("DECIMAL", "FLOAT16"):
            raise wrong
        text = kind in ("STRING", "ENUM", "JSON")
        raw = v.encode() if isinstance(v, str) else v
        return c, F.lit(raw.decode()) if text else F.lit(bytearray(raw))
    raise wrong


def _leaf(root: Node, column: str) -> Node:
    node = find(root, column)
    if not node.is_leaf:
        raise SchemaError(f"{column} is a group; predicates take leaf columns")
    if node.max_rep:
        raise SchemaError(f"{column} is repeated; predicates take columns with one value a row")
    return node


def _compare(root: Node, p: P.Compare) -> Column:
    node, v = _leaf(root, p.column), p.value
    half = node.logical is not None and node.logical.kind == "FLOAT16"
    typed = v.physical if isinstance(v, P.Typed) else None
    value = v.value if typed else v
    if isinstance(value, float):
        kinds = {"FLOAT": "float", "DOUBLE": "double"}
        actual = "FLOAT" if half else node.physical
        if actual not in kinds or typed not in (None, actual):
            raise ValueError(f"{p.column}: a float literal doesn't compare with {node.physical}")
        c = reference(node)
        return total_order(convert.float16(c) if half else c, p.op, value, kinds[actual])
    if isinstance(value, bool) and p.op not in ("eq", "ne"):
        raise NotImplementedError(f"{p.column}: booleans compare by eq and ne only")
    c, lit = _pair(node, v)
    return _ordered(c, p.op, lit)


def lower(root: Node, p: P.Predicate) -> Column:
    """The Column of a predicate; its negations go into the leaves first."""

    def walk(p: P.Predicate) -> Column:
        if isinstance(p, P.All):
            return reduce(Column.__and__, map(walk, p.parts))
        if isinstance(p, P.Any_):
            return reduce(Column.__or__, map(walk, p.parts))
        if isinstance(p, P.Compare):
            return _compare(root, p)
        if isinstance(p, P.In):
            node = _leaf(root, p.column)
            if isinstance(p.values[0], (float, bool)):
                raise ValueError("is_in takes integers and strings")
            pairs = [_pair(node, v) for v in p.values]
            return pairs[0][0].isin(*(x for _, x in pairs))
        if isinstance(p, P.Null):
            c = reference(_leaf(root, p.column))
            return c.isNotNull() if p.negated else c.isNull()
        node = _leaf(root, p.column)
        if not node.logical or node.logical.kind not in ("GEOMETRY", "GEOGRAPHY"):
            raise ValueError(f"{p.column} isn't a geometry")
        return F.lit(True)  # the row groups' boxes decide

    return walk(P.without_not(p))
