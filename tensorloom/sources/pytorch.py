"""PyTorch checkpoints as tensors.

The pickle is never loaded: its opcodes are read as data and only as far as they place tensors in
the archive's stored entries.
"""

from __future__ import annotations

import io
import pickletools
import struct
import zipfile
from collections.abc import Iterator
from math import prod

from tensorloom.sources.walked import Tensor

# Storage class -> type and bytes of an element.
STORAGES = {"FloatStorage": ("F32", 4), "DoubleStorage": ("F64", 8), "HalfStorage": ("F16", 2), "BFloat16Storage": ("BF16", 2), "LongStorage": ("I64", 8), "IntStorage": ("I32", 4), "ShortStorage": ("I16", 2), "CharStorage": ("I8", 1), "ByteStorage": ("U8", 1), "BoolStorage": ("Bool", 1)}
MARK = object()


class Call:
    """Something that the pickle would have called, with what it would have got."""

    def __init__(self, name, args) -> None:
        self.name, self.args, self.items = name, args, {}


def _until_mark(stack: list) -> list:
    at = len(stack) - 1 - stack[::-1].index(MARK)
    out = stack[at + 1 :]
    del stack[at:]
    return out


def _read(pickled: bytes):
    """The pickle's value with calls left undone."""
    stack, memo = [], {}
    for op, arg, _ in pickletools.genops(pickled):
        name = op.name
        if name in ("BINPUT", "LONG_BINPUT", "PUT"):
            memo[int(arg)] = stack[-1]
        elif name == "MEMOIZE":
            memo[len(memo)] = stack[-1]
        elif name in ("BINGET", "LONG_BINGET", "GET"):
            stack.append(memo[int(arg)])
        elif name == "GLOBAL":
            stack.append(arg.replace(" ", "."))
        elif name == "STACK_GLOBAL":
            stack[-2:] = [f"{stack[-2]}.{stack[-1]}"]
        elif name == "MARK":
            stack.append(MARK)
        elif name in ("EMPTY_DICT", "EMPTY_LIST", "EMPTY_TUPLE", "EMPTY_SET"):
            stack.append({"EMPTY_DICT": {}, "EMPTY_TUPLE": ()}.get(name, []))
        elif name in ("TUPLE", "LIST"):
            stack.append(tuple(_until_mark(stack)))
        elif name in ("TUPLE1", "TUPLE2", "TUPLE3"):
            n = int(name[-1])
            stack[-n:] = [tuple(stack[-n:])]
        elif name == "DICT":
            items = _until_mark(stack)
            stack.append(dict(zip(items[::2], items[1::2], strict=True)))
        elif name in ("SETITEM", "SETITEMS"):
            items = [stack.pop(-2), stack.pop()] if name == "SETITEM" else _until_mark(stack)
            target = stack[-1].items if isinstance(stack[-1], Call) else stack[-1]
            target.update(zip(items[::2], items[1::2], strict=True))
        elif name in ("APPEND", "APPENDS"):
            items = [stack.pop()] if name == "APPEND" else _until_mark(stack)
            if isinstance(stack[-1], list):
                stack[-1].extend(items)
        elif name == "BINPERSID":
            stack.append(Call("persistent", stack.pop()))
        elif name in ("REDUCE", "NEWOBJ"):
            args = stack.pop()
            stack.append(Call(stack.pop(), args))
        elif name == "BUILD":
            stack.pop()
        elif name == "POP":
            stack.pop()
        elif name == "STOP":
            return stack[-1]
        elif name not in ("PROTO", "FRAME"):
            stack.append({"NONE": None, "NEWTRUE": True, "NEWFALSE": False}.get(name, arg))
    raise ValueError("the pickle has no end")


def _tensors(value, prefix: str = "") -> Iterator[tuple[str, Call]]:
    """Dotted names of all tensors in nested dictionaries."""
    if isinstance(value, Call):
        call = str(value.name)
        if call.endswith("_rebuild_tensor_v2"):
            yield prefix, value
        elif call.endswith("_rebuild_parameter"):
            yield from _tensors(value.args[0], prefix)
        else:
            yield from _tensors(value.items, prefix)
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from _tensors(v, f"{prefix}.{k}" if prefix else str(k))


def walk(data: bytes) -> Iterator[Tensor]:
    """Tensors of the archive's pickle in its order; strides are taken to be those of rows in sequence."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    names = archive.namelist()
    pickled = next(n for n in names if n.endswith("data.pkl"))
    root = pickled[: -len("data.pkl")]
    for name, call in _tensors(_read(archive.read(pickled))):
        storage, offset, shape = call.args[0].args, call.args[1], list(call.args[2])
        dtype, size = STORAGES[str(storage[1]).rsplit(".", 1)[-1]]
        info = archive.getinfo(f"{root}data/{storage[2]}")
        if info.compress_type != zipfile.ZIP_STORED:
            raise ValueError("compressed entry")
        head = info.header_offset
        begin = head + 30 + sum(struct.unpack_from("<HH", data, head + 26))
        yield name, dtype, shape, begin + offset * size, prod(shape) * size, None


def write(entries: list[tuple[str, list[int], str, bytes]]) -> bytes:
    """An archive of (name, shape, type, bytes): a dictionary of tensors, entries stored, names in order."""
    by_type = {v: (k, n) for k, (v, n) in STORAGES.items()}

    def text(s: str) -> bytes:
        b = s.encode()
        return b"X" + struct.pack("<I", len(b)) + b

    def number(n: int) -> bytes:
        if -(1 << 31) <= n < 1 << 31:
            return b"J" + struct.pack("<i", n)
        b = n.to_bytes(9, "little", signed=True)
        return b"\x8a" + bytes([len(b)]) + b

    def sizes(values: list[int]) -> bytes:
        return b"(" + b"".join(map(number, values)) + b"t"

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        body = b"\x80\x02}("
        for i, (name, shape, dtype, data) in enumerate(sorted(entries)):
            storage, size = by_type[dtype]
            strides = [prod(shape[k + 1 :]) for k in range(len(shape))]
            persistent = b"(" + text("storage") + f"ctorch\n{storage}\n".encode() + text(str(i)) + text("cpu") + number(len(data) // size) + b"tQ"
            body += text(name) + b"ctorch._utils\n_rebuild_tensor_v2\n(" + persistent + number(0) + sizes(shape) + sizes(strides) + b"\x89ccollections\nOrderedDict\n)RtR"
            archive.writestr(f"archive/data/{i}", data)
        archive.writestr("archive/data.pkl", body + b"u.")
        archive.writestr("archive/byteorder", "little")
    return out.getvalue()
