import re
from collections import Counter

import pytest
from conftest import words
from pyspark.sql import functions as F

from tensorloom.llm import quality_rules as q


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_measures(frame, rng):
    texts = [None, "", " \n\n", "a", "x\n\nx\n x\ny", "# * <b> é😀", " ".join(["a b c d e f g h"] * 5), "a " * 9000]
    texts += [" ".join(words(rng, n, 3)) for n in range(5, 60)] + ["\n".join(" ".join(words(rng, 4, 3)) for _ in range(20))]
    got = {r.doc_id: r for r in q.measures(frame(list(enumerate(texts))), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_binomial(spark):
    from math import comb

    rows = [(k, n) for n in (1, 10, 300, 2000) for k in range(0, min(n, 12))]
    out = spark.createDataFrame(rows, "k long, n long").select("k", "n", q.binomial_at_most(F.col("k"), F.col("n"), 0.02).alias("p")).collect()
    for r in out:
        want = sum(comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1)) if r.k < 0.02 * r.n else 1.0
        assert r.p == pytest.approx(want, rel=1e-9)


def test_cutoffs_are_certified(frame, labels, rng):
    rows = [(i, " ".join(words(rng, 30)) + " #" * (i % 100 == 0) * 9, "en") for i in range(3000)]
    rows += [(5000 + i, " ".join(f"{w}###" for w in words(rng, 30)), "en") for i in range(50)]
    rows += [(6000, " ".join(words(rng, 30)), None), (6001, "short", "de"), (6000, " ".join(words(rng, 30)), None)]
    marks = [(i, 1, 0) for i in range(3000)] + [(5000 + i, 0, 0) for i in range(50)] + [(1, 1, 1), (77777, 1, 0)]
    got = {r.doc_id: r for r in q.judge(frame(rows), labels(marks)).collect()}
    assert not any(got[5000 + i].kept for i in range(50))
    assert sum(not got[i].kept for i in range(3000)) <= q.RISK * 3000
    assert got[6000].kept and not got[6001].kept


def test_without_labels(frame, labels, rng):
    out = q.judge(frame([(1, " ".join(words(rng, 30)) + " ###" * 40), (2, None)]), labels([])).collect()
    assert {r.doc_id: r.kept for r in out} == {1: False, 2: False} or {r.doc_id: r.kept for r in out} == {1: True, 2: False}
    assert not q.judge(frame([]), labels([])).collect()
