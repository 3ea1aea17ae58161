"""TFLite models' constant tensors; the flat buffer is walked from its root table."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from math import prod

from tensorloom.sources.walked import Tensor

# Tensor type codes of the public schema, and bytes of an element.
TYPES = {0: ("F32", 4), 1: ("F16", 2), 2: ("I32", 4), 3: ("U8", 1), 4: ("I64", 8), 6: ("Bool", 1), 7: ("I16", 2), 9: ("I8", 1), 10: ("F64", 8)}


class Table:
    """A table of a flat buffer: fields are found through its vtable."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at
        self.vtable = at - struct.unpack_from("<i", data, at)[0]
        self.size = struct.unpack_from("<H", data, self.vtable)[0]

    def place(self, field: int) -> int | None:
        slot = 4 + 2 * field
        offset = struct.unpack_from("<H", self.data, self.vtable + slot)[0] if slot < self.size else 0
        return self.at + offset if offset else None

    def scalar(self, field: int, code: str, default: int = 0) -> int:
        at = self.place(field)
        return default if at is None else struct.unpack_from("<" + code, self.data, at)[0]

    def vector(self, field: int) -> tuple[int, int]:
        """Where a vector's (or string's) elements begin, and how many there are."""
        at = self.place(field)
        if at is None:
            return 0, 0
        at += struct.unpack_from("<I", self.data, at)[0]
        return at + 4, struct.unpack_from("<I", self.data, at)[0]

    def tables(self, field: int) -> Iterator[Table]:
        begin, n = self.vector(field)
        for at in range(begin, begin + 4 * n, 4):
            yield Table(self.data, at + struct.unpack_from("<I", self.data, at)[0])


def walk(data: bytes) -> Iterator[Tensor]:
    """Tensors of the first subgraph whose buffers hold data, cut to the size of their shapes; an unknown type counts as F32.

    A shape without elements needs no data: such tensors are constants as well.
    """
    root = Table(data, struct.unpack_from("<I", data)[0])
    buffers = [b.vector(0) for b in root.tables(4)]
    for graph in list(root.tables(2))[:1]:
        for t in graph.tables(0):
            begin, n = t.vector(0)
            shape = [struct.unpack_from("<i", data, begin + 4 * k)[0] for k in range(n)]
            dtype, size = TYPES.get(t.scalar(1, "b"), TYPES[0])
            at, length = buffers[t.scalar(2, "I")]
            name, letters = t.vector(3)
            elements = prod(shape)
            if length or not elements:
                yield data[name : name + letters].decode("utf-8", "replace"), dtype, shape, at, min(length, elements * size), None


def write(entries: list[tuple[str, list[int], str, bytes]]) -> bytes:
    """A model of one subgraph; buffer 0 is empty, as the format wants it. Everything lies behind what points to it."""
    codes = {v[0]: k for k, v in TYPES.items()}
    out = bytearray(b"\0\0\0\0TFL3")

    def pad(to: int) -> None:
        out.extend(b"\0" * (-len(out) % to))

    def table(kinds: str) -> list[int]:
        """A table of fields (I an offset or number, b a byte), with the places of its fields."""
        pad(4)
        places, at = [], 4
        for k in kinds:
            places.append(at)
            at += 4
        vtable = struct.pack(f"<HH{len(kinds)}H", 4 + 2 * len(kinds), at, *places)
        out.extend(vtable)
        pad(4)
        begin = len(out)
        out.extend(struct.pack("<i", begin - (begin - len(vtable) - (-len(vtable) % 4))) + b"\0" * (at - 4))
        return [begin, *(begin + p for p in places)]

    def point(at: int, target: int) -> None:
        struct.pack_into("<I", out, at, target - at)

    def vector(at: int, n: int, body: bytes, align: int = 4) -> int:
        pad(align)
        out.extend(b"\0" * (align - 4))
        point(at, len(out))
        out.extend(struct.pack("<I", n) + body)
        return len(out) - len(body)

    root = table("IIIII")
    struct.pack_into("<I", out, 0, root[0])
    struct.pack_into("<I", out, root[1], 3)
    graphs = vector(root[3], 1, b"\0" * 4)
    graph = table("I")
    point(graphs, graph[0])
    slots = vector(graph[1], len(entries), b"\0" * 4 * len(entries))
    for i, (name, shape, dtype, _) in enumerate(entries):
        t = table("IbII")
        point(slots + 4 * i, t[0])
        struct.pack_into("<b", out, t[2], codes[dtype])
        struct.pack_into("<I", out, t[3], i + 1)
        vector(t[1], len(shape), struct.pack(f"<{len(shape)}i", *shape))
        vector(t[4], len(name.encode()), name.encode() + b"\0")
    slots = vector(root[5], len(entries) + 1, b"\0" * 4 * (len(entries) + 1))
    for i, data in enumerate([b"", *(e[3] for e in entries)]):
        b = table("I" if data else "")
        point(slots + 4 * i, b[0])
        if data:
            vector(b[1], len(data), data, 16)
    return bytes(out)
