"""Group-quantized integers to floats, scale * (q - zero), in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "0123456789ABCDEF"


def _digit(digits: Column, i: Column) -> Column:
    """Value of hex digit i, from 0."""
    return F.instr(F.lit(DIGITS), F.substr(digits, i + 1, F.lit(1))) - 1


def integers(data: Column, bits: int) -> Column:
    """Unsigned integers of 1, 2, 4 or 8 bits, the lowest bits of each byte first."""
    if bits not in (1, 2, 4, 8):
        raise ValueError(f"{bits} bits")
    digits, per = F.hex(data), 8 // bits
    n = F.octet_length(data) * per

    def one(i: Column) -> Column:
        at = F.floor(i / per).cast("int")
        byte = _digit(digits, at * 2) * 16 + _digit(digits, at * 2 + 1)
        return F.floor(byte / F.pow(F.lit(2.0), (i % per) * bits)).cast("int") % (1 << bits)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).when(n == 0, F.array().cast("array<int>"))


def dequantize(data: Column, bits: int, order: str, block: int, scales: Column, zeros: Column) -> Column:
    """Floats of a binary column; null for null.

    ``order`` is ``block`` or ``sequential`` (group i // block; a missing scale is 1, a missing zero
    point 0) or ``interleaved`` (nibbles; only as many groups as there are scales).
    """
    if order not in ("block", "sequential", "interleaved") or (order == "block" and bits not in (4, 8)):
        raise ValueError(f"{order} with {bits} bits")
    q = integers(data, 4 if order == "interleaved" else bits)
    if order == "interleaved":
        q = F.slice(q, F.lit(1), F.size(scales) * block)

    def real(v: Column, i: Column) -> Column:
        g = F.floor(i / block).cast("int")
        return F.coalesce(F.get(scales, g), F.lit(1.0)) * (v - F.coalesce(F.get(zeros, g), F.lit(0.0)))

    return F.transform(q, real)
