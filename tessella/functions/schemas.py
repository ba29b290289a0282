"""A Parquet schema in the notations of Avro and Protocol Buffers."""

from __future__ import annotations

import json
import re

from tessella.sources.footer import Footer, Node


def safe(name: str) -> str:
    """A name of letters, digits and underscores that starts with no digit."""
    out = re.sub(r"\W", "_", name, flags=re.ASCII)
    return f"_{out}" if not out or out[0].isdigit() else out


def _avro_leaf(n: Node, used: set[str]):
    lo, kind = n.logical, n.logical.kind if n.logical else None
    with_logical = lambda base, logical, **more: {"type": base, "logicalType": logical, **more}
    if n.physical == "BOOLEAN":
        return "boolean"
    if kind == "DECIMAL":
        return with_logical("bytes", "decimal", precision=lo.precision, scale=lo.scale)
    if n.physical == "INT32":
        if kind == "DATE":
            return with_logical("int", "date")
        if kind == "TIME":
            return with_logical("int", "time-millis")
        return "long" if kind == "INT" and not lo.signed and lo.bits == 32 else "int"
    if n.physical == "INT64":
        if kind == "TIME":
            return with_logical("long", "time-micros") if lo.unit == "MICROS" else "long"
        if kind == "TIMESTAMP" and lo.unit != "NANOS":
            return with_logical("long", f"{'' if lo.utc else 'local-'}timestamp-{lo.unit.lower()}")
        return "long"
    if n.physical in ("FLOAT", "DOUBLE"):
        return n.physical.lower()
    if kind in ("STRING", "ENUM", "JSON"):
        return "string"
    if kind == "UUID":
        return with_logical("string", "uuid")
    if n.physical in ("FIXED_LEN_BYTE_ARRAY", "INT96"):
        return {"type": "fixed", "name": _unique(safe(n.name), used), "size": n.length or 12}
    return "bytes"


def _unique(name: str, used: set[str]) -> str:
    out, k = name, 1
    while out in used:
        k += 1
        out = f"{name}_{k}"
    used.add(out)
    return out


def avro(footer: Footer) -> str:
    """Avro's JSON; nullable columns are unions with null."""
    used: set[str] = set()

    def kind(n: Node):
        logical = n.logical.kind if n.logical else None
        if n.is_leaf:
            return _avro_leaf(n, used)
        if logical == "LIST" and n.children:
            r = n.children[0]
            bare = r.is_leaf or len(r.children) > 1 or r.name == "array" or r.name == n.name + "_tuple"
            return {"type": "array", "items": kind(r) if bare else maybe(r.children[0])}
        if logical == "MAP" and n.children:
            pair = n.children[0].children
            if not (pair[0].logical and pair[0].logical.kind in ("STRING", "ENUM")):
                raise ValueError(f"{n.dotted}: map keys must be text")
            return {"type": "map", "values": maybe(pair[1]) if len(pair) > 1 else "null"}
        return {"type": "record", "name": _unique(safe(n.name), used), "fields": [field(c) for c in n.children]}

    def maybe(n: Node):
        if n.repetition == "REPEATED":
            return {"type": "array", "items": kind(n)}
        return ["null", kind(n)] if n.repetition == "OPTIONAL" else kind(n)

    def field(n: Node):
        return {"name": safe(n.name), "type": maybe(n)} | ({"default": None} if n.repetition == "OPTIONAL" else {})

    return json.dumps({"type": "record", "name": safe(footer.root.name), "fields": [field(c) for c in footer.root.children]}, indent=2)


def proto(footer: Footer) -> str:
    """Protocol Buffers' language, version 3."""
    scalars = {"BOOLEAN": "bool", "INT32": "int32", "INT64": "int64", "INT96": "bytes", "FLOAT": "float", "DOUBLE": "double", "BYTE_ARRAY": "bytes", "FIXED_LEN_BYTE_ARRAY": "bytes"}

    def scalar(n: Node) -> str:
        kind = n.logical.kind if n.logical else None
        if kind in ("STRING", "ENUM", "JSON"):
            return "string"
        return ("u" if kind == "INT" and not n.logical.signed else "") + scalars[n.physical]

    def message(name: str, nodes: list[Node], depth: int) -> list[str]:
        pad, out = "  " * depth, []
        inner = pad + "  "
        for k, n in enumerate(nodes, 1):
            kind, label, at = n.logical.kind if n.logical else None, "optional " if n.repetition == "OPTIONAL" else "", n
            if kind == "MAP" and n.children and len(n.children[0].children) == 2 and all(c.is_leaf for c in n.children[0].children):
                a, b = n.children[0].children
                out.append(f"{inner}map<{scalar(a)}, {scalar(b)}> {safe(n.name)} = {k};")
                continue
            if kind in ("LIST", "MAP") and n.children:
                r = n.children[0]
                at, label = (r.children[0] if kind == "LIST" and len(r.children) == 1 else r), "repeated "
            if n.repetition == "REPEATED":
                label = "repeated "
            if at.is_leaf:
                out.append(f"{inner}{label}{scalar(at)} {safe(n.name)} = {k};")
            else:
                title = "".join(p.capitalize() for p in safe(n.name).split("_")) or "Group"
                out += message(title, at.children, depth + 1)
                out.append(f"{inner}{label}{title} {safe(n.name)} = {k};")
        return [f"{pad}message {name} {{", *out, pad + "}"]

    return "\n".join(['syntax = "proto3";', "", *message(safe(footer.root.name), footer.root.children, 0)])
