import itertools
import math
import zlib

import numpy as np
import pytest
from conftest import words

from tensorloom.llm import language as lg
from tensorloom.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    known = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
    pieces = lg.pieces_of(MODEL)
    rng = np.random.default_rng(0)
    p = rng.random((pieces.size + 1, 2)) * 1e-3
    p[pieces.size] = lg.UNKNOWN
    tried = ["▁the", "▁Hellos", "x", "▁日本鿕語", "▁aé!", "▁internation"]
    got = lg.scores(pieces, tried, lg.Weights(p))
    for word, row in zip(tried, got, strict=True):
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            parts = [word[a:b] for a, b in itertools.pairwise(at)]
            if all(x in known or len(x) == 1 for x in parts):
                total += np.prod([p[known.get(x, pieces.size)] for x in parts], axis=0)
        assert row == pytest.approx(np.log(total))


def test_expected_counts_cover_the_characters():
    pieces = lg.pieces_of(MODEL)
    p = np.full(pieces.size + 1, 1e-4)
    got = lg.expected(pieces, ["▁the", "▁cat"], np.array([2.0, 1.0]), lg.Weights(p))
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    assert sum(len(m.pieces[i].piece) * got[i] for i in np.flatnonzero(got)) == pytest.approx(12)


def test_identify(frame, rng):
    heads = {"xx": "bade kilo mune", "yy": "schra strout threng", "zz": "ñolla cióna ado"}
    rows = [(i, " ".join(rng.choice(heads[x].split()) + rng.choice(["", "n", "s"]) for _ in range(20)), x) for i in range(150) for x in [rng.choice(sorted(heads))]]
    rows += [(900, None, "xx"), (901, "123 !!", "xx"), (902, "", "yy"), (903, "bade kilo mune", None), (904, "bade " * 20000, "xx"), (None, "kilo kilo", "xx"), (905, "x" * 3000, "xx"), (903, "bade kilo mune", None)]
    got = lg.identify(frame(rows), MODEL).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, x in rows[:150]:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert by[i].lang_pred == x and 0 <= by[i].score <= 1
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[903].lang_pred == "xx" and not math.isnan(by[905].score)
    assert not lg.identify(frame([]), MODEL).collect()


def test_nothing_to_learn(frame):
    assert [r.lang_pred for r in lg.identify(frame([(3, "text", None)]), MODEL).collect()] == ["und"]


def test_held_out_accuracy(spark, frame):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in lg.identify(docs, MODEL).collect()}
    held = [(got[r.doc_id].lang_pred, r.lang) for r in docs.collect() if got[r.doc_id].held_out and r.lang and len(r.text or "") > 50]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_long_runs_of_unseen_characters_stay_finite(spark, frame):
    pieces = lg.pieces_of(MODEL)
    p = np.full((pieces.size + 1, 2), 0.1 / 60e6) * [1, 2]
    p[pieces.size] = lg.UNKNOWN
    seen = next(c for c in "жщфэ" if lg.scores(pieces, [c], lg.Weights(p))[0, 0] < math.log(lg.UNKNOWN))  # in the vocabulary
    for run in (seen * 64, "\u9fd5" * 64, "a" + seen * 62 + "b"):
        got = lg.scores(pieces, ["▁the", run, seen], lg.Weights(p))
        assert np.isfinite(got).all()
    tried, count = ["▁the", "\u9fd5" * 64], np.array([2.0, 3.0])
    flat = np.full(pieces.size + 1, 1 / pieces.size)
    flat[pieces.size] = lg.UNKNOWN
    got = lg.expected(pieces, tried, count, lg.Weights(flat))
    assert np.isfinite(got).all() and got[pieces.size] == pytest.approx(192)
    # the other words still decide
    langs, small = ["aa", "bb"], np.full((pieces.size + 1, 2), 0.1 / 60e6)
    small[:, 1] *= 1.01
    small[pieces.size] = lg.UNKNOWN
    r = lg.predict(frame([(1, "the cat " + seen * 64)]), langs, small, MODEL, ["doc_id"]).first()
    assert r.lang_pred == "bb" and 0.5 < r.score <= 1


def by_logarithms(known, word, p, size):
    """Logarithms of the forward sums, place by place."""
    sums = [0.0, *[-math.inf] * len(word)]
    for end in range(1, len(word) + 1):
        for begin in range(max(0, end - 40), end):
            piece = word[begin:end]
            if piece in known or len(piece) == 1:
                sums[end] = np.logaddexp(sums[end], sums[begin] + math.log(p[known.get(piece, size)]))
    return sums[-1]


def test_words_of_any_length_are_summed_whole(rng):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    known = {x.piece: i for i, x in enumerate(m.pieces) if x.type == 1}
    pieces = lg.pieces_of(MODEL)
    p = np.random.default_rng(1).random((pieces.size + 1, 2)) * 1e-3
    p[::3] = 1e-12
    p[pieces.size] = lg.UNKNOWN
    tried = ["▁" + "".join(rng.choice("theinatio\u9fd5é") for _ in range(n)) for n in (1, 8, 15, 16, 17, 18, 63, 64, 65, 200, 1500)]
    got = lg.scores(pieces, tried, lg.Weights(p))
    for word, row in zip(tried, got, strict=True):
        assert row == pytest.approx([by_logarithms(known, word, p[:, i], pieces.size) for i in range(2)])
    # expected counts of long words: each character is in one piece
    for word in tried:
        n = lg.expected(pieces, [word], np.array([3.0]), lg.Weights(p[:, 0]))
        sizes = np.array([len(x.piece) for x in m.pieces] + [1])
        assert n @ sizes == pytest.approx(3 * len(word))
    together = lg.expected(pieces, tried, np.ones(len(tried)), lg.Weights(p[:, 0]))
    assert together == pytest.approx(sum(lg.expected(pieces, [w], np.ones(1), lg.Weights(p[:, 0])) for w in tried))
