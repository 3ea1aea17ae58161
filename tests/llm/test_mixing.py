import pytest

from tensorloom.llm.mixing import apply_mix, mix, targets


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Deals and deals again what is over, as the contract words it."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full, out = share * sum(sizes.values()), set(), dict.fromkeys(names, 0.0)
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return out
        each = (left - sum(cap * sizes[s] for s in full)) / sum(w[s] for s in rest)
        out |= {s: each * w[s] for s in rest}
        over = {s for s in rest if out[s] > cap * sizes[s]}
        if not over:
            return out
        out |= {s: cap * sizes[s] for s in over}
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50}, {"a": 5, "b": 5, "é": 1000, "z": 3, None: 77}, {"a": 0, "b": 10}, {"a": 1}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(water(sizes))


def test_mix(frame, rng):
    rows = [(i, " ".join(["w"] * rng.randrange(0, 200)), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    rows += [(600, None, "en", "b"), (601, "", "en", "a"), (601, "twice here", "en", "a"), (None, "no id", "en", "c")]
    got = mix(frame(rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size and 0 <= r.rate <= 2
    aims = water(sizes)
    for s, n in sizes.items():
        assert {r.source_size for r in got if r.source == s} == {n}
        assert sum(r.taken for r in got if r.source == s) == pytest.approx(aims[s], rel=0.01)
        assert sum(r.rate * r.size for r in got if r.source == s) == pytest.approx(aims[s], rel=1e-4)
    assert sorted(map(str, mix(frame(rows)).collect())) == sorted(map(str, got))


def test_apply(frame):
    rows = [(i, "w " * (i + 1), "en", "ab"[i % 2]) for i in range(50)]
    docs = frame(rows)
    copies = {r.doc_id: r.copies for r in mix(docs).collect()}
    out = apply_mix(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert {i: ids.count(i) for i in copies} == copies
    assert not mix(frame([])).collect()
