"""Predicates under the names that users of the Java Parquet library know."""

from __future__ import annotations

from dataclasses import dataclass

from tessella.plans import predicate as P


@dataclass(frozen=True)
class Column:
    path: str
    physical: str | None

    def literal(self, v):
        if v is None:
            raise ValueError("a null literal compares with nothing")
        return {"INT32": P.i32, "INT64": P.i64, "FLOAT": P.f32, "DOUBLE": P.f64}[self.physical](v) if self.physical else v


def int_column(path: str) -> Column:
    return Column(path, "INT32")


def long_column(path: str) -> Column:
    return Column(path, "INT64")


def float_column(path: str) -> Column:
    return Column(path, "FLOAT")


def double_column(path: str) -> Column:
    return Column(path, "DOUBLE")


def boolean_column(path: str) -> Column:
    return Column(path, None)


def binary_column(path: str) -> Column:
    return Column(path, None)


def _named(build):
    return lambda column, value: build(column.path, column.literal(value))


eq, not_eq, lt, lt_eq, gt, gt_eq = map(_named, (P.eq, P.ne, P.lt, P.le, P.gt, P.ge))
and_, or_, not_ = P.all_of, P.any_of, P.not_
