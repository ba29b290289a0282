"""Typed row predicates: an immutable tree, built by the functions below.

Literals are typed. A plain ``int`` or ``float`` takes the width of its column; ``i32``, ``i64``,
``f32`` and ``f64`` insist on theirs, and a column of another width is an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

OPERATORS = ("eq", "ne", "lt", "le", "gt", "ge")
INVERSE = {"eq": "ne", "ne": "eq", "lt": "ge", "ge": "lt", "gt": "le", "le": "gt"}


@dataclass(frozen=True)
class Typed:
    """A literal that insists on its physical type."""

    physical: str
    value: Any


class Predicate:
    """Base class. ``&``, ``|`` and ``~`` combine predicates."""

    def __and__(self, other: Predicate) -> Predicate:
        return all_of(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return any_of(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Compare(Predicate):
    op: str
    column: str
    value: Any


@dataclass(frozen=True)
class In(Predicate):
    column: str
    values: tuple


@dataclass(frozen=True)
class Null(Predicate):
    column: str
    negated: bool = False


@dataclass(frozen=True)
class Intersects(Predicate):
    column: str
    xmin: float
    ymin: float
    xmax: float
    ymax: float


@dataclass(frozen=True)
class All(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Any_(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


def i32(v: int) -> Typed:
    if not -(2**31) <= v < 2**31:
        raise ValueError(f"{v} doesn't fit 32 bits")
    return Typed("INT32", v)


def i64(v: int) -> Typed:
    if not -(2**63) <= v < 2**63:
        raise ValueError(f"{v} doesn't fit 64 bits")
    return Typed("INT64", v)


def f32(v: float) -> Typed:
    return Typed("FLOAT", float(v))


def f64(v: float) -> Typed:
    return Typed("DOUBLE", float(v))


def _compare(op: str):
    def build(column: str, value: Any) -> Predicate:
        if value is None:
            raise ValueError("a null literal compares with nothing; use is_null")
        return Compare(op, column, value)

    build.__name__, build.__doc__ = op, f"``column`` {op} ``value``; rows where the column is null don't match."
    return build


eq, ne, lt, le, gt, ge = map(_compare, OPERATORS)


def is_in(column: str, *values: Any) -> Predicate:
    if not values:
        raise ValueError("is_in needs a value")
    return In(column, values)


def is_null(column: str) -> Predicate:
    """Also true where a struct around the column is null."""
    return Null(column)


def is_not_null(column: str) -> Predicate:
    return Null(column, True)


def between(column: str, low: Any, high: Any) -> Predicate:
    return all_of(ge(column, low), le(column, high))


def intersects(column: str, xmin: float, ymin: float, xmax: float, ymax: float) -> Predicate:
    """Row groups whose bounding box meets the query's; ``xmin > xmax`` wraps round the antimeridian."""
    return Intersects(column, xmin, ymin, xmax, ymax)


def _flat(kind: type, parts: tuple[Predicate, ...]) -> Predicate:
    if not parts:
        raise ValueError("needs a predicate")
    flat = tuple(x for p in parts for x in (p.parts if isinstance(p, kind) else (p,)))
    return flat[0] if len(flat) == 1 else kind(flat)


def all_of(*parts: Predicate) -> Predicate:
    return _flat(All, parts)


def any_of(*parts: Predicate) -> Predicate:
    return _flat(Any_, parts)


def not_(part: Predicate) -> Predicate:
    return Not(part)


def without_not(p: Predicate, negate: bool = False) -> Predicate:
    """The same predicate with negations pushed into the leaves; nulls match neither way."""
    if isinstance(p, Not):
        return without_not(p.part, not negate)
    if isinstance(p, (All, Any_)):
        parts = tuple(without_not(x, negate) for x in p.parts)
        return (any_of if isinstance(p, All) == negate else all_of)(*parts)
    if not negate:
        return p
    if isinstance(p, Compare):
        return Compare(INVERSE[p.op], p.column, p.value)
    if isinstance(p, Null):
        return Null(p.column, not p.negated)
    if isinstance(p, In):
        return all_of(*(Compare("ne", p.column, v) for v in p.values))
    raise NotImplementedError("intersects can't be negated: it holds for row groups, not rows")


def columns_of(p: Predicate) -> list[str]:
    if isinstance(p, (All, Any_)):
        return [c for x in p.parts for c in columns_of(x)]
    return columns_of(p.part) if isinstance(p, Not) else [p.column]
