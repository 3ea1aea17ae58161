import math
from collections import Counter, defaultdict

import pytest
from conftest import words

from tensorloom.llm import perplexity as px


class Plain:
    """Interpolated modified Kneser-Ney by its definition, over dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        tops = Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))
        self.a = {order: tops}
        for n in range(order - 1, 0, -1):
            c = Counter(g[1:] for g in self.a[n + 1])
            self.a[n] = c
        for n in range(1, order):
            self.a[n] = Counter({g: c for g, c in self.a[n].items() if not g.endswith(px.START)})
        self.d, self.total, self.off = {}, defaultdict(int), defaultdict(float)
        for n, c in self.a.items():
            t = [sum(v == i for v in c.values()) for i in range(1, 5)]
            y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0
            self.d[n] = [min(max(i - (i + 1) * y * t[i] / t[i - 1], 0.05), i) if t[i - 1] else 0.5 * i for i in (1, 2, 3)]
            for g, v in c.items():
                self.total[n, g[:-1]] += v
                self.off[n, g[:-1]] += self.d[n][min(v, 3) - 1]
        self.kinds = len(self.a[1]) + 1

    def p(self, h, w):
        n = len(h) + 1
        below = self.p(h[1:], w) if n > 1 else 1 / self.kinds
        if (n, h) not in self.total:
            return below
        v = self.a[n].get(h + w, 0)
        own = v - self.d[n][min(v, 3) - 1] if v else 0
        return own / self.total[n, h] + self.off[n, h] / self.total[n, h] * below

    def logp(self, t):
        o = self.order
        return sum(math.log(self.p(t[i - o + 1 : i], t[i])) for i in range(o - 1, len(t)))


@pytest.fixture()
def corpus(rng):
    good = [(i, " ".join(words(rng, rng.randrange(5, 60), 60)), ["en", "de"][i % 2]) for i in range(120)]
    bad = [(200 + i, "".join(rng.choice("#$%&*ABCXYZ") for _ in range(300)), ["en", "de"][i % 2]) for i in range(10)]
    odd = [(300, None, "en"), (301, "", None), (302, "w1 w2 " * 20000, "en"), (303, "日本語", "fr"), (None, "w1 w2", "en")]
    return good + bad + odd


def test_probabilities_by_definition_and_both_joins(frame, labels, corpus):
    docs = frame(corpus)
    marks = [(i, 1, 0) for i, *_ in corpus[:120]] + [(0, 1, 0), (200, 0, 0), (999, 1, 0)]
    sent = sorted(map(tuple, px.classify(docs, labels(marks)).collect()), key=str)
    joined = sorted(map(tuple, px.classify(docs, labels(marks), broadcast_rows=0).collect()), key=str)
    assert [r[0] for r in sent] == [r[0] for r in joined] and len(sent) == len(corpus)
    assert [r[3] for r in sent] == pytest.approx([r[3] for r in joined], rel=1e-4)
    import zlib

    model = Plain([px.padded(t) for i, t, _ in corpus[:120] if zlib.crc32(str(i).encode()) % px.FOLDS], px.ORDER)
    text = {i: t for i, t, _ in corpus}
    for i, _, n, perplexity, *_ in sent:
        t = px.padded(text[i])
        assert n == len(t) - px.ORDER + 1
        assert perplexity == pytest.approx(math.exp(-model.logp(t) / n), rel=1e-3)
    kept = {r[0]: r[5] for r in sent}
    assert not any(kept[200 + i] for i in range(10)) and all(kept[i] for i in range(120)) and kept[303]
    assert {r.doc_id for r in px.keep_good(docs, labels(marks)).collect()} >= {None, *range(120)}


def test_sum_to_one(frame, corpus):
    model = Plain([px.padded(t) for _, t, _ in corpus[:30]], 4)
    for h in ("w1 ", " w2", "\x02\x02\x02", "zzz"):
        assert sum(model.p(h, c) for c in model.a[1]) + model.p(h, "?") == pytest.approx(1)


def test_nothing_to_learn(frame, labels):
    out = px.classify(frame([(1, "a b"), (2, None)]), labels([])).collect()
    assert all(r.kept and r.threshold is None for r in out) and len(out) == 2
    assert not px.classify(frame([]), labels([])).collect()


def test_limits_are_quantiles_of_like_length(spark):
    for n in (1, 100, 597, 598, 2000):
        tail = [sum(math.comb(n, i) * 0.005**i * 0.995 ** (n - i) for i in range(k + 1)) for k in range(40)]
        assert px.spare(n) == max([k for k in range(min(n, 40)) if tail[k] <= px.ERROR], default=0)
    rows = [("en", c, -(i + 1) / 1000 * 100 * w, 100) for c, w in ((4, 3), (9, 1)) for i in range(800)] + [("de", 9, -50.0, 100)]
    own, pooled = px.limits(spark.createDataFrame(rows, "lang string, class int, logp double, n_chars long"))
    got = {r.lang: {c: v for c, v in r.limits} for r in own.collect()}
    # no slack above the rank, and a lone text isn't believed
    assert abs(got["en"][9] - (800 - px.spare(800))) <= 1 and abs(got["en"][4] - 3 * (800 - px.spare(800))) <= 3
    assert got["de"] == {9: dict(map(tuple, pooled.first().limits))[9]}


def test_dull_junk_of_a_rare_length_goes(frame, labels, rng):
    rows = [(i, " ".join(words(rng, 300 if i % 2 else 12, 60)), "en") for i in range(600)]
    # as odd as a short text may be, but long
    rows += [(1000 + i, " ".join(rng.choice(["w1", "w2", "xq"]) for _ in range(300)), "en") for i in range(10)]
    rows += [(2000, "w1 w2 w3 w4", "fr"), (2001, "".join(rng.choice("#$%&*") for _ in range(300)), "fr")]
    own = next(i for i in range(3000, 3100) if px.spare(1) == 0 and __import__("zlib").crc32(str(i).encode()) % px.FOLDS)
    rows += [(own, " ".join(words(rng, 100, 60)), "fr")]
    marks = [(i, 1, 0) for i in range(600)] + [(own, 1, 0)]
    got = {r.doc_id: r for r in px.classify(frame(rows), labels(marks)).collect()}
    assert not any(got[1000 + i].kept for i in range(10))
    # fr has trusted documents in training only: the limits of all languages hold
    assert got[2001].threshold is not None and not got[2001].kept and got[own].kept
    assert sum(not got[i].kept for i in range(600)) <= 6
