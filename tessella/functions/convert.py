"""Decoders of Parquet values that Spark reads as bytes or integers, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _little_endian(c: Column, start: int, size: int) -> Column:
    """Unsigned integer of ``size`` bytes at the 1-based byte ``start``."""
    back = (F.lpad(F.hex(F.substring(c, start + size - 1 - k, 1)), 2, "0") for k in range(size))
    return F.conv(F.concat(*back), 16, 10).cast("long")


def float16(c: Column) -> Column:
    """IEEE half precision, two bytes little-endian, to float."""
    bits = _little_endian(c, 1, 2)
    sign = F.when(bits >= 32768, -1.0).otherwise(1.0)
    exponent, part = F.floor(bits % 32768 / 1024), bits % 1024
    special = F.when(part == 0, sign * float("inf")).otherwise(F.lit(float("nan")))
    small = sign * part * 2.0**-24
    normal = sign * F.pow(F.lit(2.0), exponent - 15) * (1 + part / 1024.0)
    return F.when(c.isNotNull(), F.when(exponent == 31, special).when(exponent == 0, small).otherwise(normal)).cast("float")


def uuid(c: Column) -> Column:
    """Sixteen bytes, big-endian, to the canonical text."""
    return F.regexp_replace(F.lower(F.hex(c)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def interval(c: Column) -> Column:
    """Twelve bytes to (months, days, milliseconds), each an unsigned 32-bit integer."""
    parts = F.struct(*(_little_endian(c, 1 + 4 * k, 4).alias(n) for k, n in enumerate(("months", "days", "milliseconds"))))
    return F.when(c.isNotNull(), parts)


def as_signed(bits: int):
    """The signed integer with the bit pattern of an unsigned one."""
    half, whole = 1 << (bits - 1), 1 << bits
    kind = "int" if bits == 32 else "long"
    return lambda c: F.when(c >= half, c - F.lit(whole).cast("decimal(20,0)")).otherwise(c).cast(kind)


def unscaled(scale: int):
    return lambda c: (c * F.lit(10**scale)).cast("long")


def epoch(unit: str, utc: bool):
    """Units since 1970 of a timestamp."""

    def run(c: Column) -> Column:
        micros = F.unix_micros(c if utc else F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp"))
        return F.floor(micros / 1000).cast("long") if unit == "MILLIS" else micros

    return run


def int96_from_parts(julian_day: Column, nanos: Column) -> Column:
    """A timestamp from a Julian day and nanoseconds of the day."""
    return F.timestamp_micros((julian_day.cast("long") - 2440588) * 86_400_000_000 + F.floor(nanos / 1000).cast("long"))
