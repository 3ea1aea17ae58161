"""Decoding of block-quantized and half-precision bytes, vectorised over all blocks of a batch.

Catalyst has no reinterpretation of bytes as floats, so this is an Arrow function; each kernel takes
an array [block, byte] and gives [block, element].
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType, StringType

from tensorloom.shared import bounded_batches

#: Bytes of blocks decoded at once: a kernel's intermediate arrays are up to 60 times as large.
LOT_BYTES = 1 << 20


def _half(b: np.ndarray, at: int) -> np.ndarray:
    return b[:, at : at + 2].copy().view("<f2").astype(np.float32)


def _nibbles(b: np.ndarray) -> np.ndarray:
    """Low, then high half of each byte."""
    return np.stack([b & 15, b >> 4], axis=2).reshape(len(b), -1).astype(np.float32)


def _fifth(b: np.ndarray, at: int) -> np.ndarray:
    return np.unpackbits(b[:, at : at + 4], axis=1, bitorder="little").astype(np.float32) * 16


def q4_0(b: np.ndarray) -> np.ndarray:
    return (_nibbles(b[:, 2:18]) - 8) * _half(b, 0)


def q4_1(b: np.ndarray) -> np.ndarray:
    return _nibbles(b[:, 4:20]) * _half(b, 0) + _half(b, 2)


def q5_0(b: np.ndarray) -> np.ndarray:
    return (_nibbles(b[:, 6:22]) + _fifth(b, 2) - 16) * _half(b, 0)


def q5_1(b: np.ndarray) -> np.ndarray:
    return (_nibbles(b[:, 8:24]) + _fifth(b, 4)) * _half(b, 0) + _half(b, 2)


def q8_0(b: np.ndarray) -> np.ndarray:
    return b[:, 2:34].view(np.int8).astype(np.float32) * _half(b, 0)


def q8_k(b: np.ndarray) -> np.ndarray:
    return b[:, 8:264].view(np.int8).astype(np.float32) * b[:, :8].copy().view("<f8").astype(np.float32)


def q2_k(b: np.ndarray) -> np.ndarray:
    scale, q = b[:, :16], b[:, 16:80]
    two = np.stack([q >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(b), 16, 16).astype(np.float32)
    d, low = _half(b, 80)[..., None], _half(b, 82)[..., None]
    return (d * (scale & 15)[..., None] * two - low * (scale >> 4)[..., None]).reshape(len(b), 256)


def _six_bits(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight 6-bit scales and eight 6-bit minima out of 12 bytes."""
    scale = np.concatenate([s[:, :4] & 63, s[:, 8:12] & 15 | s[:, :4] >> 6 << 4], axis=1)
    low = np.concatenate([s[:, 4:8] & 63, s[:, 8:12] >> 4 | s[:, 4:8] >> 6 << 4], axis=1)
    return scale.astype(np.float32), low.astype(np.float32)


def q4_k(b: np.ndarray) -> np.ndarray:
    """Eight groups of 32: 16 low halves, then the 16 high halves of the same bytes."""
    scale, low = _six_bits(b[:, 4:16])
    q = b[:, 16:144].reshape(len(b), 8, 16)
    four = np.concatenate([q & 15, q >> 4], axis=2).astype(np.float32)
    return ((_half(b, 0) * scale)[..., None] * four - (_half(b, 2) * low)[..., None]).reshape(len(b), 256)


def q6_k(b: np.ndarray) -> np.ndarray:
    """16 groups of 16: four low bits from halves of ql, two high bits from quarters of qh."""
    low = _nibbles(b[:, :128])
    high = np.stack([b[:, 128:192] >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(b), 256).astype(np.float32)
    scale = b[:, 192:208].view(np.int8).astype(np.float32).repeat(16, axis=1)
    return _half(b, 208) * scale * (low + 16 * high - 32)


def q3_k(b: np.ndarray) -> np.ndarray:
    """Eight groups of 32: two low bits from qs, the third from hmask; a group's signed scale has four bits of one byte and two of another."""
    s = b[:, 96:108]
    low = s[:, :8] & 15
    high = np.concatenate([s[:, 8:12] & 3, s[:, 8:12] >> 2 & 3], axis=1)
    scale = (low | high << 6).view(np.int8).astype(np.float32)
    two = np.stack([b[:, 32:96] >> k & 3 for k in (0, 2, 4, 6)], axis=2).reshape(len(b), 256)
    third = np.unpackbits(b[:, :32], axis=1, bitorder="little")
    return _half(b, 108) * scale.repeat(32, axis=1) * (two.astype(np.float32) + 4 * third - 4)


def q5_k(b: np.ndarray) -> np.ndarray:
    """As q4_k with a fifth bit: group g takes it from four bytes of qh, at bit (place + g) mod 8."""
    scale, low = _six_bits(b[:, 4:16])
    q = b[:, 48:176].reshape(len(b), 8, 16)
    four = np.concatenate([q & 15, q >> 4], axis=2)
    g, j = np.arange(8)[:, None], np.arange(32)[None, :]
    fifth = b[:, 16 + 4 * (g // 4) + j // 8] >> (g % 4 + j % 8 & 7).astype(np.uint8) & 1
    return ((_half(b, 0) * scale)[..., None] * (four + 16.0 * fifth).astype(np.float32) - (_half(b, 2) * low)[..., None]).reshape(len(b), 256)


def half(b: np.ndarray) -> np.ndarray:
    return b.copy().view("<f2").astype(np.float32)


def bfloat(b: np.ndarray) -> np.ndarray:
    return (b.copy().view("<u2").astype(np.uint32) << 16).view(np.float32)


def single(b: np.ndarray) -> np.ndarray:
    return b.copy().view("<f4")


#: Type -> bytes of a block, kernel.
KERNELS = {
    "F32": (4, single), "F16": (2, half), "BF16": (2, bfloat), "Q4_0": (18, q4_0), "Q4_1": (20, q4_1), "Q5_0": (22, q5_0), "Q5_1": (24, q5_1), "Q8_0": (34, q8_0),
    "Q2_K": (84, q2_k), "Q3_K_S": (110, q3_k), "Q3_K_M": (110, q3_k), "Q3_K_L": (110, q3_k), "Q5_K_S": (176, q5_k), "Q5_K_M": (176, q5_k), "Q4_K_S": (144, q4_k), "Q4_K_M": (144, q4_k), "Q6_K": (210, q6_k), "Q8_K": (292, q8_k),
}


def decoded(name: str, data: bytes) -> np.ndarray:
    """[block, element] of whole blocks of a type; a lot of blocks at a time, so that only the result is as large as all of them."""
    size, kernel = KERNELS[name]
    blocks = np.frombuffer(data, np.uint8).reshape(-1, size)
    with np.errstate(all="ignore"):  # scales may be infinite or NaN
        values = np.empty((len(blocks), kernel(np.zeros((1, size), np.uint8)).shape[1]), np.float32)
        step = LOT_BYTES // size
        for a in range(0, len(blocks), step):
            values[a : a + step] = kernel(blocks[a : a + step])
    return values


@pandas_udf(ArrayType(FloatType()))
def _dequantize(dtype: pd.Series, data: pd.Series) -> pd.Series:
    out: list = [None] * len(data)
    blobs_of = data.tolist()
    for name in set(dtype) & set(KERNELS):
        rows = [i for i, d in enumerate(dtype) if d == name]
        size = KERNELS[name][0]
        blobs = [blobs_of[i] for i in rows]
        whole = [len(x or b"") // size for x in blobs]  # a rest that isn't a block is dropped
        values = decoded(name, b"".join((x or b"")[: n * size] for x, n in zip(blobs, whole, strict=True)))
        for i, x, part in zip(rows, blobs, np.split(values, np.cumsum(whole)[:-1]), strict=True):
            out[i] = None if x is None else part.reshape(-1)
    return pd.Series(out, dtype=object)


def dequantize(dtype: Column, data: Column) -> Column:
    """Float values of whole blocks; null for null bytes and for types without a kernel."""
    bounded_batches(SparkSession.active())  # values take up to twelve times the bytes
    return _dequantize(dtype, data)


@pandas_udf(StringType())
def xxh64(data: pd.Series) -> pd.Series:
    """xxHash64 with seed 0 in 16 hex digits (Spark's own has another seed); null stays null."""
    import xxhash

    return data.map(lambda x: None if x is None else xxhash.xxh64_hexdigest(x))
