import struct

import numpy as np
import pytest

from tensorloom.llm.queries import tokenizer_path
from tensorloom.llm.sentencepieces import PieceCodec, digests, encode_decode

sp = pytest.importorskip("sentencepiece")
MODEL = tokenizer_path("piece_bpe_32k.model")
TEXTS = ["", " ", "Hello  world", " hi\n\nthere\t a ", "▁x ▁▁", "é̈ １２ ﬁ ", "日本 😀 \x00 x", "<s> </s> <0x0A>", "x" * 3000, "a  b " * 500, None]


def trie(pairs: dict[bytes, bytes]) -> bytes:
    """A compiled character map: a double array built the plain way, each node at the first base that fits."""
    nodes, values = {b""}, {}
    strings = b""
    for k, v in pairs.items():
        values[k] = len(strings)
        strings += v + b"\0"
        nodes |= {k[:i] for i in range(len(k) + 1)}
    units, place, base = {0: 0}, {b"": 0}, {}
    for node in sorted(nodes, key=lambda k: (len(k), k)):
        labels = sorted({k[len(node)] for k in nodes if len(k) == len(node) + 1 and k.startswith(node)})
        slots = ([0] if node in values else []) + labels
        at = place[node]
        offset = next(o for o in range(1, 1 << 20) if all((at ^ o ^ c) not in units for c in slots))
        base[node] = offset
        for c in labels:
            place[node + bytes([c])] = at ^ offset ^ c
            units[at ^ offset ^ c] = c
        if node in values:
            units[at ^ offset] = values[node] | 1 << 31
    for node, at in place.items():
        units[at] = units[at] & 0xFF | base[node] << 10 | (node in values) << 8
    array = np.zeros((max(units) // 256 + 1) * 256, np.uint32)
    for at, u in units.items():
        array[at] = u
    return struct.pack("<I", array.nbytes) + array.tobytes() + strings


def variants():
    from sentencepiece import sentencepiece_model_pb2 as pb

    blob = trie({"ﬁ".encode(): b"fi", "１".encode(): b"1", "２".encode(): b"2", "é".encode(): "é".encode(), b"\t": b" ", b"\n": b" ", b"ab": b"X", b"a": b"A", "​".encode(): b""})
    for mapped in (False, True):
        for squeeze in (False, True):
            for prefix in (True, False):
                m = pb.ModelProto()
                m.ParseFromString(open(MODEL, "rb").read())
                m.normalizer_spec.precompiled_charsmap = blob if mapped else b""
                m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix = squeeze, prefix
                yield m.SerializeToString()


@pytest.mark.parametrize("model", list(variants()))
def test_same_as_library_under_any_normaliser(model):
    library = sp.SentencePieceProcessor()
    library.LoadFromSerializedProto(model)
    codec = PieceCodec.of(model)
    for text in [t or "" for t in TEXTS] + ["abab a b ﬁ​é\t\n１２  ", "​", "\t"]:
        ids, begins, ends = codec.encode(text)
        assert ids == library.encode(text), text
        data = text.encode()
        assert len(ids) == len(begins) == len(ends)
        if len(ids):
            assert (begins <= ends).all() and (np.diff(begins) >= 0).all() and ends[-1] <= len(data)


def test_spans_cover_the_text():
    codec = PieceCodec(MODEL)
    for text in TEXTS:
        data = (text or "").encode()
        _, begins, ends = codec.encode(text or "")
        assert b"".join(data[a:b] for a, b in zip(begins, ends, strict=True)) == data


def test_operator(frame):
    library = sp.SentencePieceProcessor(model_file=MODEL)
    rows = [*enumerate(TEXTS), (3, "again"), (3, "again"), (None, "no id")]
    out = encode_decode(frame(rows), MODEL).collect()
    assert len(out) == len(rows)
    want = sorted((i is None, i or 0, [*library.encode(t or ""), 2], library.decode([*library.encode(t or ""), 2])) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids, r.decoded) for r in out) == want
    assert digests(encode_decode(frame([]), MODEL)).collect() == []
    empty = digests(encode_decode(frame([(1, None)]), MODEL)).first()
    assert empty.n_tokens == 1 and empty.n_bytes == 0
