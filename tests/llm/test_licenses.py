import textwrap

import pytest

from tensorloom.llm import licenses as lic


def pairs_of(w):
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def plain_runs(text, rows):
    """The best run of lines of each template, and of these those that no better one overlaps."""
    lines = [w for w in map(lic.words_of, text.split("\n")) if w]
    best = {}
    for name, no, p, _ in rows:
        size = len(lic.words_of(lic.TEMPLATES[name][no]))

        def score(w, p=p):
            own = pairs_of(w)
            return 2 * len(own & set(p)) / (len(own) + len(p)), len(own & set(p))

        for i in range(len(lines)):
            j, n = i, len(lines[i])
            while n < size and j + 1 < len(lines):
                j += 1
                n += len(lines[j])
            if j == i or n > 2 * size or (i == 0 and j == len(lines) - 1) or any(score(w)[0] >= lic.THRESHOLD for w in lines[i : j + 1]):
                continue
            dice, shared = score(sum(lines[i : j + 1], []))
            if dice >= lic.THRESHOLD and dice > best.get((name, no), (0,))[0]:
                best[name, no] = dice, shared, i, j
    rank = {t: (-s, -d, *t) for t, (d, s, _, _) in best.items()}
    return [(t[0], d) for t, (d, _, i, j) in best.items() if not any(rank[o] < rank[t] and best[o][2] <= j and i <= best[o][3] for o in best)]


def plain(text):
    rows, _ = lic.prepared(lic.TEMPLATES, lic.THRESHOLD)
    found = {}
    for segment in (text.split("\n") + [text] * ("\n" in text)) if text else []:
        w = lic.words_of(segment)
        own = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
        scores = [(-2 * len(own & set(p)) / (len(own) + len(p)), name) for name, _, p, _ in rows if own]
        if scores and -min(scores)[0] >= lic.THRESHOLD:
            d, name = min(scores)
            old = found.get(name, (0, 0))
            found[name] = max(old[0], -d), old[1] + 1
    for name, d in plain_runs(text or "", rows):
        old = found.get(name, (0, 0))
        found[name] = max(old[0], d), old[1] + 1
    return found


def test_like_all_templates(frame, rng):
    texts = [None, "", "\n", "word", "licensed", "Licensed under the Apache License, Version 2.0.\n" * 3]
    for notices in lic.TEMPLATES.values():
        for t in notices:
            w = t.split()
            texts += [t, "text before\n" + t.upper() + "\nafter", "\n".join([" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])])]
            for _ in range(4):
                v = list(w)
                for _ in range(rng.randrange(1, 4)):
                    v[rng.randrange(len(v))] = rng.choice(["changed", "license", ""])
                texts.append(" ".join(v))
    texts.append("filler " * 50000 + "\nReleased under the MIT License.")
    got = {}
    for r in lic.scan(frame(list(enumerate(texts)))).collect():
        got.setdefault(r.doc_id, {})[r.license] = (pytest.approx(r.dice), r.n_segments)
    assert got == {i: plain(t) for i, t in enumerate(texts) if plain(t)}


def test_wrapped_notices(frame, rng):
    """Full licences, wrapped, indented and behind comment marks, inside longer files."""
    filler = [f"x{i} = compute(x{i - 1}, {i})" for i in range(1, 700)]
    rows = []
    for name, notices in lic.TEMPLATES.items():
        for t in notices:
            if len(t.split()) < 20:
                continue
            for width, mark in ((60, "# "), (76, " * "), (8, "")):
                rows.append((name, "\n".join([*filler[: rng.randrange(30) if rows else 600], "Copyright 2020 A. Person", "", *[mark + line for line in textwrap.wrap(t, width, break_long_words=False)], "", *filler[:5]])))
    texts = [t for _, t in rows]
    got = {}
    for r in lic.scan(frame(list(enumerate(texts)))).collect():
        got.setdefault(r.doc_id, {})[r.license] = (r.dice, r.n_segments)
    assert {i: {name: (pytest.approx(d), n) for name, (d, n) in of.items()} for i, of in got.items()} == {i: plain(t) for i, t in enumerate(texts)}
    assert all(name in got[i] and got[i][name][0] >= 0.9 for i, (name, _) in enumerate(rows))
    # the longest match stands alone
    assert all(list(got[i]) == [name] for i, (name, _) in enumerate(rows) if name.startswith("BSD-"))


def test_empty(frame):
    assert not lic.scan(frame([])).collect()
