import itertools

import numpy as np
import pytest
from conftest import words

from tensorloom.llm import ngram_join
from tensorloom.llm.components import components
from tensorloom.llm.shingles import shingle_set


def brute(rows, n, num, den):
    sets = [set(shingle_set(t, n).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(ids.get(root(i), d), d)
    return sorted((d, len(sets[i]), ids.get(root(i))) for i, (d, _) in enumerate(rows) if d is not None)


def corpus(rng):
    rows, base = [], words(rng, 60)
    for i in range(60):  # a group of near copies, of which not all are linked
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((100 + i, " ".join(w)))
    shared = " ".join(words(rng, 12))
    rows += [(200 + i, " ".join(words(rng, rng.randrange(1, 40))) + " " + shared) for i in range(40)]
    rows += [(300 + i, " ".join(words(rng, 3, 3))) for i in range(20)]
    return rows


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 50)])
def test_like_brute_force(frame, rng, n, num, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 0.0)
    rows = corpus(rng) + [(7, "One two THREE"), (3, "one  TWO three"), (8, None), (9, ""), (10, " \n"), (11, "a b"), (12, "a b"), (13, "long " * 30000), (7, "One two THREE")]
    got = sorted(map(tuple, ngram_join.join(frame(rows), n, num, 100).collect()))
    assert got == brute(rows, n, num, 100)


def test_pairs_of_tokens_lose_no_link(rng):
    """Index keys of any two linked sets meet, wherever the line between rare and frequent lies."""
    r = np.random.default_rng(3)
    for num, limit in itertools.product((80, 90), (0, 5, 10, 1000)):
        for size in (2, 5, 11, 40, 119, 121, 240, 260, 300):
            counts_of = r.integers(1, 12, 2000)
            a = np.sort(r.choice(2000, size, replace=False)).astype(np.uint64)
            for _ in range(20):
                b = a.copy()
                drop = r.integers(0, max(1, size // 9) + 1)
                b = np.delete(b, r.choice(size, min(drop, size - 1), replace=False))
                b = np.unique(np.append(b, r.integers(0, 2000, r.integers(0, 3)).astype(np.uint64)))
                shared = len(np.intersect1d(a, b))
                if 100 * shared >= num * (len(a) + len(b) - shared) and not np.array_equal(a, b):
                    keys = [ngram_join.index_keys(s, counts_of[s.astype(int)], limit, num, 100) for s in (a, b)]
                    assert len(np.intersect1d(*keys))


def test_small_blocks(frame, rng, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rows = corpus(rng)
    assert sorted(map(tuple, ngram_join.join(frame(rows), 3, 90, 100).collect())) == brute(rows, 3, 90, 100)


def test_empty(frame):
    out = ngram_join.join(frame([]), 3, 90, 100)
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and not out.collect()


def test_keep_first(frame):
    rows = [(2, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (5, "h i j k l m"), (6, None), (None, "a b c d e f g"), (7, "")]
    got = ngram_join.keep_first(frame(rows))
    assert got.columns == frame([]).columns
    assert sorted(r.doc_id or -1 for r in got.collect()) == [-1, 1, 5, 6, 7]


def test_components(spark):
    path = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5), (200, 200)]
    got = {r.v: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}
    assert not components(spark.createDataFrame([], "a long, b long")).collect()
