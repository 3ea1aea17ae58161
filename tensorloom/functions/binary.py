"""Little-endian integers in binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _swapped(digits: Column, n: int) -> Column:
    """Hex digits of n bytes, last byte first.  (``reverse`` would go by characters, not by bytes.)"""
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))])


def little_endian(data: Column, at: int, n: int) -> Column:
    """Unsigned integer of n bytes at a 0-based offset; null if the data is shorter."""
    digits = F.hex(F.substring(data, at + 1, n))
    return F.when(F.length(digits) == 2 * n, F.conv(_swapped(digits, n), 16, 10).cast("decimal(20,0)"))


def to_little_endian(value: Column) -> Column:
    """Eight bytes of a long."""
    return F.unhex(_swapped(F.lpad(F.hex(value.cast("long")), 16, "0"), 8))
