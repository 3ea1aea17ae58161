"""Stages act on rows: texts that share an id, repeated rows, nulls, empty tables and any column names."""

import corpus_pipeline
import pytest
from conftest import words

from tensorloom.llm import mixing, ngram_join, passages, perplexity
from tensorloom.llm.queries import tokenizer_path

NAMES = ["later_id", "later_row", "place", "bad_id", "bad_row", "bad_lang", "mix_id", "mix_row", "mix_source", "mix_total", "mix_rows", "mix_place", "cut_id", "cut_print", "cut_spans", "id", "row", "print", "part", "_id", "v", "n"]


@pytest.fixture(scope="module")
def wide(spark):
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", *range(len(NAMES))) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in NAMES))

    return make


def shape(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_first_of_each_component(wide, rng):
    a, b = " ".join(words(rng, 40)), " ".join(words(rng, 40))
    docs = wide([(3, a), (5, a), (5, b), (5, b), (7, b), (None, a), (8, None), (8, ""), (9, "x y"), (4, "x y")])
    out = ngram_join.keep_first(docs)
    assert out.columns == docs.columns
    assert shape(out) == sorted([(3, a), (5, b), (None, a), (8, None), (8, ""), (4, "x y")], key=str)


def test_good_rows_of_an_id_stay(wide, labels, rng):
    lexicon = ["".join(rng.choice("abdeiklmnoprstu") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    rows = [(i, prose(60)) for i in range(400)]
    junk = "#$%&| " * 60
    docs = wide([*rows, (900, junk), (900, rows[7][1]), (None, junk), (None, rows[3][1]), (901, None)])
    out = perplexity.keep_good(docs, labels([(i, 1, 0) for i in range(400)]))
    assert out.columns == docs.columns
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert (900, rows[7][1]) in got and (900, junk) not in got and (None, junk) not in got and (None, rows[3][1]) in got


def test_copies_follow_rows(wide, rng):
    rows = [(i // 3, " ".join(words(rng, 1 + rng.randrange(60))), "en", "abc"[i % 3]) for i in range(300)]
    rows += [rows[4]] * 5 + [(None, "x y z", "en", None), (None, None, "en", "a"), (2, "", "en", "b")]
    docs = wide(rows)
    want = {}
    for r in mixing._mixed(docs, "doc_id", "text", "source", (5.0, 2.0, 1.0), 1.5, 2.0).collect():
        want[r.id, r.source, r.size] = want.get((r.id, r.source, r.size), 0) + r.copies
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        key = (r.doc_id, r.source, len((r.text or "").split()))
        got[key] = got.get(key, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_stages_on_odd_tables(spark, wide, rng, tmp_path):
    a, b = " ".join(words(rng, 70)), " ".join(words(rng, 80))
    odd = [(1, a), (2, a), (2, b), (2, b), (None, b), (3, None), (4, ""), (5, "w " * 30000), (None, None), (6, a + " " + b, None, None)]
    spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for i, rows in enumerate(([], odd)):
        docs = wide(rows)
        names = docs.columns
        docs = docs.withColumn("n_chars", docs.doc_id)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert sorted(out.columns) == sorted([*names, "n_chars"])
            out.write.parquet(f"{tmp_path}/{i}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{i}-{k}")
        assert docs.count() == 0 if not rows else docs.count() > 0


def test_passages_need_no_model_or_label(wide):
    assert tokenizer_path("piece_bpe_32k.model") and not passages.repeats(wide([])).collect()
