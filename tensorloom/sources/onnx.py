"""ONNX models' initializers as tensors; the protobuf is walked field by field."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from tensorloom.sources.walked import Tensor

# Data type codes of the public format.
TYPES = {1: "F32", 2: "U8", 3: "I8", 4: "U16", 5: "I16", 6: "I32", 7: "I64", 9: "Bool", 10: "F16", 11: "F64", 12: "U32", 13: "U64", 16: "BF16", 17: "F8E4M3", 19: "F8E5M2"}
CODES = {v: k for k, v in TYPES.items()}
#: What the typed fields hold: field number -> struct code of an element, or None for varints.
TYPED = {4: "f", 10: "d", 5: None, 7: None, 11: None}
#: Bytes of an element of a typed field of whole numbers, by type; other types have no such form.
INT_BYTES = {"Bool": 1, "I8": 1, "U8": 1, "I16": 2, "U16": 2, "F16": 2, "BF16": 2, "I32": 4, "I64": 8, "U64": 8}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(field, wire type, value or begin, end) of a message in data[at:end]."""
    while at < end:
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
            yield key >> 3, 0, value, at
        else:
            n = {1: 8, 5: 4}.get(wire)
            if n is None:
                if wire != 2:
                    raise ValueError(f"wire type {wire}")
                n, at = _varint(data, at)
            if at + n > end:
                raise ValueError("a field runs over its message")
            yield key >> 3, wire, at, at + n
            at += n


def _numbers(data: bytes, wire: int, a: int, b: int, code: str | None) -> list:
    if code:
        return [v[0] for v in struct.iter_unpack("<" + code, data[a:b])]
    if wire == 0:
        return [a]
    out = []
    while a < b:
        v, a = _varint(data, a)
        out.append(v)
    return out


def _tensor(data: bytes, at: int, end: int) -> Tensor | None:
    shape, kind, name, raw, typed = [], 0, "", None, []
    for field, wire, a, b in fields(data, at, end):
        if field == 1:
            shape += _numbers(data, wire, a, b, None)
        elif field == 2:
            kind = a
        elif field == 8:
            name = data[a:b].decode("utf-8", "replace")
        elif field == 9:
            raw = a, b - a
        elif field in TYPED:
            typed += [(TYPED[field], v) for v in _numbers(data, wire, a, b, TYPED[field])]
    dtype = TYPES.get(kind)
    if dtype is None or not name:
        return None
    if raw and raw[1]:
        return name, dtype, shape, raw[0], raw[1], None
    size = INT_BYTES.get(dtype, 0)
    inline = b"".join(struct.pack("<" + code, v) if code else (v & (1 << 8 * size) - 1).to_bytes(size, "little") for code, v in typed)
    return name, dtype, shape, None, len(inline), inline


def walk(data: bytes) -> Iterator[Tensor]:
    """Initializers in order; those without a name or of another type are passed over."""
    for field, wire, a, b in fields(data, 0, len(data)):
        if field == 7 and wire == 2:
            for inner, kind, c, d in fields(data, a, b):
                if inner == 5 and kind == 2 and (found := _tensor(data, c, d)):
                    yield found


def _field(n: int, value: int | bytes) -> bytes:
    def varint(v: int) -> bytes:
        out = bytearray()
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        return bytes([*out, v])

    return varint(n << 3) + varint(value) if isinstance(value, int) else varint(n << 3 | 2) + varint(len(value)) + value


def write(entries: list[tuple[str, list[int], str, bytes]], props: dict[str, str] | None = None) -> bytes:
    """A model without nodes: every (name, shape, type, bytes) is an initializer."""
    graph = b"".join(_field(5, b"".join(_field(1, d) for d in shape) + _field(2, CODES[dtype]) + _field(8, name.encode()) + _field(9, data)) for name, shape, dtype, data in entries)
    meta = b"".join(_field(14, _field(1, k.encode()) + _field(2, v.encode())) for k, v in (props or {}).items())
    return _field(1, 8) + _field(8, _field(2, 21)) + _field(7, graph) + meta
