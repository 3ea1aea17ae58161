"""GGUF files as tables of tensors and metadata.

The header is a sequence of variable-length fields, so it is walked in Python, one file at a time;
what leaves the walk is rows: of metadata, or of tensors with their bytes.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.dtypes import GGML
from tensorloom.shared import bounded_batches
from tensorloom.sources import walked

# Metadata value types and their struct codes; 8 is a string, 9 an array.
SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
LIMITS = {"tensors": 1_000_000, "metadata": 10_000, "string": 1 << 20, "array": 100_000, "rank": 8}


class Walk:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0
        if data[:4] != b"GGUF":
            raise ValueError("no GGUF magic")
        self.at = 4
        self.version = self.one("I")
        if self.version not in (1, 2, 3):
            raise ValueError(f"version {self.version}")
        self.count = "I" if self.version == 1 else "Q"

    def one(self, code: str):
        value = struct.unpack_from("<" + code, self.data, self.at)[0]
        self.at += struct.calcsize("<" + code)
        return value

    def bounded(self, what: str) -> int:
        n = self.one("I" if what == "rank" else self.count)
        if n > LIMITS[what]:
            raise ValueError(f"{what}: {n}")
        return n

    def text(self) -> str:
        n = self.bounded("string")
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8", "replace")

    def value(self, kind: int):
        if kind == 8:
            return self.text()
        if kind == 9:
            inner = self.one("I")
            return [self.value(inner) for _ in range(self.bounded("array"))]
        return self.one(SCALARS[kind])


def walk(data: bytes) -> Iterator[tuple]:
    """('meta', key, JSON value) and ('tensor', name, shape outer-first, type id, offset in file) of a file."""
    w = Walk(data)
    tensors, entries = w.bounded("tensors"), w.bounded("metadata")
    meta = {}
    for _ in range(entries):
        key = w.text()
        meta[key] = w.value(w.one("I"))
        yield "meta", key, json.dumps(meta[key]), None, None, None
    infos = [(w.text(), [w.one(w.count) for _ in range(w.bounded("rank"))][::-1], w.one("I"), w.one("Q")) for _ in range(tensors)]
    align = meta.get("general.alignment", 32)
    if isinstance(align, bool) or not isinstance(align, int) or align < 1:
        raise ValueError(f"general.alignment: {align}")
    base = -(-w.at // align) * align
    for name, shape, kind, offset in infos:
        yield "tensor", name, None, shape, kind, base + offset


def rows(files: DataFrame) -> DataFrame:
    """(path, ordinal, row, name, value, shape, type_id, start) of (path, content) files; a broken file gives one row ``error``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    found = list(walk(bytes(content)))
                except (ValueError, KeyError, TypeError, struct.error) as e:
                    found = [("error", None, str(e), None, None, None)]
                out = pd.DataFrame(found, columns=["row", "name", "value", "shape", "type_id", "start"], dtype=object)
                yield out.assign(path=path, ordinal=range(len(out)))[["path", "ordinal", "row", "name", "value", "shape", "type_id", "start"]]

    bounded_batches(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, ordinal long, row string, name string, value string, shape array<bigint>, type_id int, start long")


def _tensors(data: bytes) -> Iterator[walked.Tensor]:
    for row, name, _, shape, kind, start in walk(data):
        if row == "tensor":
            dtype, elements, size = GGML.get(kind, (None, 1, None))
            n = math.prod(shape)
            yield name, dtype, shape, start, None if size is None or n % elements else n // elements * size, None


def tensors(files: DataFrame) -> DataFrame:
    """A row per tensor with its bytes; a tensor beyond the file, or of unknown type or size, has ``in_bounds`` false and null data.

    Columns and broken files as in :func:`walked.tensors`.
    """
    return walked.tensors(files, _tensors)


def metadata(files: DataFrame) -> DataFrame:
    return rows(files).filter("row = 'meta'").select("path", "ordinal", F.col("name").alias("key"), "value")


def write(meta: dict, entries: list[tuple[str, list[int], str, bytes]], align: int = 32) -> bytes:
    """A version 3 file of (name, shape, type, bytes); every tensor begins at a multiple of ``align``."""
    ids = {v[0]: k for k, v in reversed(GGML.items())}

    def text(s: str) -> bytes:
        b = s.encode()
        return struct.pack("<Q", len(b)) + b

    def value(v) -> bytes:
        if isinstance(v, str):
            return struct.pack("<I", 8) + text(v)
        if isinstance(v, bool):
            return struct.pack("<I?", 7, v)
        if isinstance(v, int):
            return struct.pack("<II", 4, v) if 0 <= v < 1 << 32 else struct.pack("<Iq", 11, v)
        return struct.pack("<If", 6, v) if abs(struct.unpack("<f", struct.pack("<f", v))[0] - v) < 1e-7 * max(abs(v), 1) else struct.pack("<Id", 12, v)

    head = b"GGUF" + struct.pack("<IQQ", 3, len(entries), len(meta)) + b"".join(text(k) + value(v) for k, v in meta.items())
    body = b""
    for name, shape, kind, data in entries:
        body += b"\0" * (-len(body) % align)
        head += text(name) + struct.pack("<I", len(shape)) + b"".join(struct.pack("<Q", d) for d in reversed(shape)) + struct.pack("<IQ", ids[kind], len(body))
        body += data
    return head + b"\0" * (-len(head) % align) + body
