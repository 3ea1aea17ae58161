import numpy as np
import pytest

from tensorloom.llm import neighbours as nb


@pytest.fixture()
def vectors(spark):
    return lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, block int, score double")


def brute(rows, ask, k=5):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in ask:
        if q in good:
            s = [(-float(nb.cosine(good[q], v[None])[0]), i) for i, v in good.items() if i != q and len(v) == len(good[q])]
            out[q] = [(i, -c) for c, i in sorted(s)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_exact_cases(vectors):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).round(3).tolist()) for i in range(40)] + [(100 + i, [1.0, 2.0] + [0.0] * 6) for i in range(30)]
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] * 8), (204, [None] + [1.0] * 7), (205, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (206, [1.0, 2.0])]
    df = vectors([(*r, 1, 2, 3.0) for r in rows])
    got = found(nb.nearest(df, df))
    want = brute(rows, [r[0] for r in rows])
    want = {q: w for q, w in want.items() if w}
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}
    for q, g in got.items():
        assert [s for _, s in g] == [s for _, s in want[q]]
    assert not nb.nearest(vectors([]), vectors([])).collect()


def test_recall_over_blocks(vectors, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 500)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(2000)]
    df = vectors([(*r, 1, 2, 3.0) for r in rows])
    got, want = found(nb.nearest(df, df.filter("vec_id % 50 = 0"))), brute(rows, range(0, 2000, 50))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
