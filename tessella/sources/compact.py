"""Decoder for the Thrift compact protocol, into plain dictionaries keyed by field id.

Parquet keeps its footer, page headers and page indexes in this encoding. Decoding
generically means that a field is available as soon as it has a number in the format.
"""

from __future__ import annotations

import struct
from typing import Any


class CompactReader:
    """Reads values at ``pos`` of ``data`` and moves on."""

    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def varint(self) -> int:
        value = shift = 0
        while True:
            byte = self.data[self.pos]
            self.pos += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    def zigzag(self) -> int:
        raw = self.varint()
        return (raw >> 1) ^ -(raw & 1)

    def value(self, kind: int) -> Any:
        if kind in (1, 2):  # a boolean inside a list takes a byte of its own
            self.pos += 1
            return self.data[self.pos - 1] == 1
        if kind == 3:
            self.pos += 1
            return struct.unpack_from("b", self.data, self.pos - 1)[0]
        if kind in (4, 5, 6):
            return self.zigzag()
        if kind == 7:
            self.pos += 8
            return struct.unpack_from("<d", self.data, self.pos - 8)[0]
        if kind == 8:
            size = self.varint()
            self.pos += size
            if self.pos > len(self.data):
                raise EOFError("binary field runs past the end")
            return self.data[self.pos - size : self.pos]
        if kind in (9, 10):
            head = self.data[self.pos]
            self.pos += 1
            size = head >> 4 if head >> 4 != 15 else self.varint()
            return [self.value(head & 15) for _ in range(size)]
        if kind == 11:
            size = self.varint()
            if not size:
                return {}
            kinds = self.data[self.pos]
            self.pos += 1
            return {self.value(kinds >> 4): self.value(kinds & 15) for _ in range(size)}
        if kind == 12:
            return self.struct()
        raise ValueError(f"unknown compact type {kind}")

    def struct(self) -> dict[int, Any]:
        fields: dict[int, Any] = {}
        last = 0
        while True:
            head = self.data[self.pos]
            self.pos += 1
            if head == 0:
                return fields
            last = last + (head >> 4) if head >> 4 else self.zigzag()
            kind = head & 15
            fields[last] = kind == 1 if kind in (1, 2) else self.value(kind)


def read_struct(data: bytes, pos: int = 0) -> tuple[dict[int, Any], int]:
    """The struct at ``pos`` and the position after it."""
    reader = CompactReader(data, pos)
    return reader.struct(), reader.pos
