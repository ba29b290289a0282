"""From a Parquet schema tree to the types that Spark reads, and the decoders of those that it doesn't."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import convert
from tessella.sources.footer import Footer, Node

Decoder = Callable[[Column], Column] | None


class SchemaError(ValueError):
    """A column that doesn't exist, or files that don't fit together."""


def find(root: Node, path: str) -> Node:
    """The node at a dotted path. Names may hold dots themselves: the longest name that fits is taken first, with a way back."""
    if not path:
        raise SchemaError("empty column name")

    def walk(node: Node, rest: str) -> Node | None:
        for child in sorted(node.children, key=lambda c: -len(c.name)):
            if rest == child.name:
                return child
            if rest.startswith(child.name + ".") and (found := walk(child, rest[len(child.name) + 1 :])):
                return found
        return None

    node = walk(root, path)
    if node is None:
        raise SchemaError(f"no column {path!r}; there are {[c.name for c in root.children]}")
    return node


def _leaf(n: Node, raw: bool) -> tuple[T.DataType, Decoder]:
    lo, kind = n.logical, n.logical.kind if n.logical else None
    if n.physical == "BOOLEAN":
        return T.BooleanType(), None
    if n.physical in ("INT32", "INT64"):
        wide = n.physical == "INT64"
        plain = T.LongType() if wide else T.IntegerType()
        if kind == "INT" and lo.bits < 64 and not (lo.bits == 32 and lo.signed):
            types = {(8, True): T.ByteType(), (16, True): T.ShortType(), (8, False): T.ShortType(), (16, False): T.IntegerType(), (32, False): T.LongType()}
            return types[lo.bits, lo.signed], (convert.as_signed(32) if raw and not lo.signed and lo.bits == 32 else None)
        if kind == "INT" and not lo.signed:
            return T.DecimalType(20, 0), (convert.as_signed(64) if raw else None)
        if kind == "DECIMAL":
            return T.DecimalType(lo.precision, lo.scale), (convert.unscaled(lo.scale) if raw else None)
        if kind == "DATE":
            return T.DateType(), ((lambda c: F.unix_date(c)) if raw else None)
        if kind == "TIME":
            factor = {"MILLIS": 1_000_000, "MICROS": 1_000, "NANOS": 1}[lo.unit]
            return plain, (None if raw else lambda c: c.cast("long") * factor)
        if kind == "TIMESTAMP" and lo.unit != "NANOS":
            return (T.TimestampType() if lo.utc else T.TimestampNTZType()), (convert.epoch(lo.unit, lo.utc) if raw else None)
        return plain, None
    if n.physical == "INT96":
        return T.TimestampType(), None
    if n.physical == "FLOAT":
        return T.FloatType(), None
    if n.physical == "DOUBLE":
        return T.DoubleType(), None
    if kind in ("STRING", "ENUM", "JSON"):
        return (T.BinaryType() if raw else T.StringType()), None
    if kind == "DECIMAL" and lo.precision <= 38 and not raw:
        return T.DecimalType(lo.precision, lo.scale), None
    decoders = {"FLOAT16": convert.float16, "UUID": convert.uuid, "INTERVAL": convert.interval}
    return T.BinaryType(), (None if raw else decoders.get(kind))


def spark_type(n: Node, raw: bool = False) -> tuple[T.DataType, Decoder]:
    """The type to read ``n`` with, and what turns it into the logical value. ``raw``: physical values are kept."""

    def once(n: Node) -> tuple[T.DataType, Decoder]:
        kind = n.logical.kind if n.logical else None
        if n.is_leaf:
            return _leaf(n, raw)
        if kind == "LIST" and len(n.children) == 1 and n.children[0].repetition == "REPEATED":
            r = n.children[0]
            bare = r.is_leaf or len(r.children) > 1 or r.name == "array" or r.name == n.name + "_tuple"
            element, decode = once(r) if bare else spark_type(r.children[0], raw)
            return T.ArrayType(element), (None if decode is None else lambda c: F.transform(c, decode))
        if kind == "MAP" and len(n.children) == 1 and len(n.children[0].children) in (1, 2):
            pair = [spark_type(c, raw) for c in n.children[0].children]
            if len(pair) == 2:
                (kt, kd), (vt, vd) = pair

                def decode(c: Column) -> Column:
                    c = c if kd is None else F.transform_keys(c, lambda k, _: kd(k))
                    return c if vd is None else F.transform_values(c, lambda _, v: vd(v))

                return T.MapType(kt, vt), (None if kd is None and vd is None else decode)
        if kind == "VARIANT":
            return T.VariantType(), None
        fields = [(c.name, *spark_type(c, raw)) for c in n.children]

        def rebuild(c: Column) -> Column:
            return F.when(c.isNotNull(), F.struct(*((d(c.getField(name)) if d else c.getField(name)).alias(name) for name, _, d in fields)))

        return T.StructType([T.StructField(name, t) for name, t, _ in fields]), (rebuild if any(d for *_, d in fields) else None)

    base, decode = once(n)
    if n.repetition == "REPEATED":
        return T.ArrayType(base), (None if decode is None else lambda c: F.transform(c, decode))
    return base, decode


def read_schema(footer: Footer, raw: bool = False) -> tuple[T.StructType, dict[str, Decoder]]:
    parts = {c.name: spark_type(c, raw) for c in footer.root.children}
    return T.StructType([T.StructField(k, t) for k, (t, _) in parts.items()]), {k: d for k, (_, d) in parts.items()}


def same_shape(a: Node, b: Node) -> str | None:
    """Why two leaves can't be read as one column, or nothing."""
    for what in ("physical", "logical", "repetition", "length", "max_def", "max_rep"):
        x, y = getattr(a, what), getattr(b, what)
        if x != y and not (what == "length" and a.physical != "FIXED_LEN_BYTE_ARRAY"):
            return f"{what} is {x} there and {y} here"
    return None


def fits(first: Footer, other: Footer, paths: list[str]) -> None:
    """Raises unless the leaves below ``paths`` agree in both files; other columns may differ."""
    there = {x.path: x for x in other.leaves}
    for path in paths:
        for leaf in find(first.root, path).leaves():
            if leaf.path not in there:
                raise SchemaError(f"{other.path} lacks {leaf.dotted}")
            if why := same_shape(leaf, there[leaf.path]):
                raise SchemaError(f"{other.path}: {leaf.dotted}: {why}")


def layers(n: Node) -> list[str]:
    """The kinds of containers above a leaf, from the top: STRUCT (nullable ones), REPEATED. ``n`` is the root."""
    out: list[str] = []
    while n.children:
        n = n.children[0]
        if n.repetition == "REPEATED":
            out.append("REPEATED")
        elif not n.is_leaf and n.repetition == "OPTIONAL" and not n.logical:
            out.append("STRUCT")
    return out


def schema_text(footer: Footer) -> str:
    """The schema in Parquet's own notation."""

    def show(n: Node, depth: int) -> list[str]:
        pad, note = "  " * depth, f" ({n.logical})" if n.logical else ""
        if n.is_leaf:
            size = f"({n.length})" if n.physical == "FIXED_LEN_BYTE_ARRAY" else ""
            return [f"{pad}{n.repetition.lower()} {n.physical.lower()}{size} {n.name}{note};"]
        return [f"{pad}{n.repetition.lower()} group {n.name}{note} {{", *(x for c in n.children for x in show(c, depth + 1)), pad + "}"]

    return "\n".join([f"message {footer.root.name} {{", *(x for c in footer.root.children for x in show(c, 1)), "}"])
