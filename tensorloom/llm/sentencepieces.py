"""Operator 3: offset-preserving SentencePiece encoding, and decoding.

Text is normalised by longest-prefix matches in the model's compiled character map while the source
byte of every normalised byte is recorded; the normalised text is split into pieces by the
sentencepiece library (with its own normaliser switched off, as its work is already done); each
piece's normalised span is then projected to a byte span of the original text.

BPE merges that cross a word boundary need a piece with ``▁`` after another character.  Where the
vocabulary has none and unknown characters fall back to bytes, a text's pieces are those of its
words one after another, so the pieces of a word are computed once and looked up afterwards; the
table of words is emptied when it holds ``CACHE_WORDS`` entries, so memory is bounded.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, released

SPACE = "▁"
CACHE_WORDS = 100_000


class CharMap:
    """The compiled character map: a double-array trie whose values point into a block of replacements.

    The map's layout is that of the public model format: u32 length of the trie, the trie's u32
    units, then zero-terminated replacement strings.
    """

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and what replaces it."""
        units, found = self.units, None
        node = self._children(units[0], 0)
        for i in range(at, len(data)):
            c = data[i]
            node ^= c
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != c:  # label and leaf bit
                break
            node = self._children(unit, node)
            if unit >> 8 & 1:  # a value hangs below
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return found

    @staticmethod
    def _children(unit: int, node: int) -> int:
        return node ^ (unit >> 10 << (unit >> 6 & 8))


class PieceCodec:
    """Encoder and decoder of one model; built once per Python worker."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        self._set_up(model, sp)

    @classmethod
    def of(cls, serialized: bytes) -> PieceCodec:
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        out = cls.__new__(cls)
        model = pb.ModelProto()
        model.ParseFromString(serialized)
        out._set_up(model, sp)
        return out

    def _set_up(self, model, sp) -> None:
        spec = model.normalizer_spec
        self.charmap = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.library = sp.SentencePieceProcessor()
        self.library.LoadFromSerializedProto(model.SerializeToString())
        self.eos = self.library.eos_id()
        # the same pieces without a normaliser
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.splitter = sp.SentencePieceProcessor()
        self.splitter.LoadFromSerializedProto(model.SerializeToString())
        self.by_word = (
            self.escape
            and not self.suffix
            and model.trainer_spec.model_type == 2
            and model.trainer_spec.byte_fallback
            and not any(SPACE in p.piece.lstrip(SPACE) or p.type == 4 for p in model.pieces)
        )
        self.lengths = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces], np.int32)
        self.fixed_lengths = self.by_word  # an unknown piece may have any length; byte fallback leaves none
        self.words: dict[str, array] = {}
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and the source byte of each (one entry more: the end)."""
        data = text.encode()
        if not self.charmap.units and not self.squeeze:
            return self._identity(data)
        space = SPACE.encode() if self.escape else b" "
        out, source = bytearray(), []
        spans = list(self._replaced(data))
        if self.squeeze:
            while spans and spans[0][1] == b" ":
                spans.pop(0)
        if spans and self.prefix and not self.suffix:
            out += space
            source += [spans[0][0]] * len(space)
        blank = self.squeeze
        end = spans[-1][2] if spans else 0
        for begin, new, _ in spans:
            if self.squeeze and blank:
                new = new.lstrip(b" ")
            for byte in new:
                piece = space if byte == 0x20 else bytes([byte])
                out += piece
                source += [begin] * len(piece)
            if new:
                blank = self.squeeze and new.endswith(b" ")
        if self.squeeze:
            while out.endswith(space):
                end = source[len(out) - len(space)]
                del out[len(out) - len(space) :]
                del source[len(out) :]
        if spans and self.prefix and self.suffix:
            out += space
            source += [end] * len(space)
        return bytes(out), np.array([*source, end], np.int64)

    def _replaced(self, data: bytes) -> Iterator[tuple[int, bytes, int]]:
        """(begin, replacement, end) of each longest prefix; a character that no key covers stays."""
        at = 0
        while at < len(data):
            found = self.charmap.longest(data, at) if self.charmap.units else None
            if found is None:
                first = data[at]
                n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                found = n, data[at : at + n]
            yield at, found[1], at + found[0]
            at += found[0]

    def _identity(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        space = SPACE.encode() if self.escape else b" "
        widths = np.where(np.frombuffer(data, np.uint8) == 0x20, len(space), 1)
        source = np.append(np.repeat(np.arange(len(data)), widths), len(data))
        norm = data.replace(b" ", space)
        if self.prefix and not self.suffix:
            return space + norm, np.concatenate([np.zeros(len(space), np.int64), source])
        if self.prefix:
            return norm + space, np.concatenate([source[:-1], np.full(len(space) + 1, len(data))])
        return norm, source

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, and each piece's first and last (exclusive) byte in the text; no end id."""
        norm, source = self.normalize(text)
        if self.by_word:
            packed = array("i")  # four bytes an id, in the table of words as well
            known = self.words
            for word in self.chunk.findall(norm.decode()):
                got = known.get(word)
                if got is None:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    got = known[word] = array("i", self.splitter.encode(word))
                packed += got
            ids = packed.tolist()
            ends = np.cumsum(self.lengths[ids]) if ids else np.zeros(0, np.int64)
        else:
            parts = self.splitter.encode_as_proto(norm.decode()).pieces
            ids = [p.id for p in parts]
            ends = np.cumsum([len(p.surface.replace(" ", SPACE).encode()) for p in parts]) if ids else np.zeros(0, np.int64)
        begins = np.concatenate([[0], ends[:-1]]) if ids else ends
        return ids, source[begins], source[ends]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_CODECS: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    if model_path not in _CODECS:
        _CODECS[model_path] = PieceCodec(model_path)
    return _CODECS[model_path]


#: Texts handled at once; bounds what a task holds beside Spark's own batch.
ROWS = 64


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: bool = True) -> DataFrame:
    """Every text's ids, byte spans and decoded text.

    Result: ``id_col``, ``ids`` array<int> (with the end id last if ``end_id``), ``begins`` and
    ``ends`` array<int> (byte spans of the pieces in the UTF-8 text, the end id having none) and
    ``decoded``.  A null text counts as empty: no pieces, an empty ``decoded``.  Repeated rows each
    give a row, a null id stays null, other columns are not read.  One narrow pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                found = [c.encode(t or "") for t in part.column(1).to_pylist()]
                ids = [[*f[0], c.eos] if end_id else f[0] for f in found]
                n = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        _lists(ids, [len(x) for x in ids]),
                        _lists([f[1] for f in found], n),
                        _lists([f[2] for f in found], n),
                        pa.array([c.decode(x) for x in ids], pa.string()),
                    ],
                    names=["id", "ids", "begins", "ends", "decoded"],
                )

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"id {kind}, ids array<int>, begins array<int>, ends array<int>, decoded string").withColumnRenamed("id", id_col)


def _lists(rows: list, sizes: list[int]) -> pa.ListArray:
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, pa.int32()))


def digests(encoded: DataFrame, id_col: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    """Counts and SHA-256 digests of what :func:`encode_decode` returns, and the columns ``also``."""
    return encoded.select(
        id_col,
        *also,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"),
    )
