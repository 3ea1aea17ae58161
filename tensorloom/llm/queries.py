"""Queries of the training-data operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, language, licenses, mixing, neighbours, ngram_join, passages, perplexity, quality_rules, sentencepieces
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepieces.digests(sentencepieces.encode_decode(docs, tokenizer_path("piece_bpe_32k.model")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", extra), (-7, 1, "assistant", extra)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_turns(rows))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_license_scan": op2_license_scan,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_nearest_neighbours": op6_nearest_neighbours,
        "op7_mixing": op7_mixing,
        "op8_quality_rules": op8_quality_rules,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_language_id": op10_language_id,
    }


#: Every pair that shares a shingle, without prefixes; components by recursion over least ids.
_OP1 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w
), t AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)
), both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(v, r) AS (SELECT x, x FROM both_ways UNION SELECT b.y, r FROM reach JOIN both_ways b ON b.x = v)
SELECT n.doc_id, n.n AS n_shingles, coalesce((SELECT min(r) FROM reach WHERE v = n.doc_id), n.doc_id) AS component_id FROM n
"""

_WORD = r"[^\x20\x09-\x0D]+"


def _op2() -> str:
    """Every segment and every run of lines against every template, without keys or size bounds."""
    rows, _ = licenses.prepared(licenses.TEMPLATES, licenses.THRESHOLD)
    values = ", ".join(f"('{name}', {no}, {len(licenses.words_of(licenses.TEMPLATES[name][no]))}, [{', '.join(repr(p) for p in pairs)}])" for name, no, pairs, _ in rows)
    return rf"""
WITH t(license, no, size, pairs) AS (VALUES {values}),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents
  UNION ALL SELECT doc_id, text, 0 FROM documents WHERE contains(text, chr(10))
), w AS MATERIALIZED (SELECT doc_id, line, list_filter(string_split(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM lines),
b AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM w WHERE len(w) > 1),
m AS MATERIALIZED (
  SELECT doc_id, line, license, no, 2 * len(list_intersect(own, pairs)) / (len(own) + len(pairs)) AS dice FROM b, t
  WHERE 2 * len(list_intersect(own, pairs)) / (len(own) + len(pairs)) >= {licenses.THRESHOLD}
), best AS (
  SELECT doc_id, line, license, dice FROM m
  QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) = 1
), l AS MATERIALIZED (
  SELECT doc_id, line, row_number() OVER p - 1 AS k, sum(len(w)) OVER p AS last, sum(len(w)) OVER p - len(w) AS first, count(*) OVER (PARTITION BY doc_id) AS n
  FROM w WHERE line > 0 AND len(w) > 0 WINDOW p AS (PARTITION BY doc_id ORDER BY line)
), r AS (
  SELECT x.doc_id, x.k AS i, y.k AS j, x.line AS l1, y.line AS l2, license, no, pairs, list_distinct(list_transform(range(CAST(x.first AS BIGINT) + 1, CAST(y.last AS BIGINT)), lambda i: w.w[i] || ' ' || w.w[i + 1])) AS own
  FROM l x JOIN t ON true JOIN l y ON y.doc_id = x.doc_id AND y.k > x.k AND y.first - x.first < size AND (y.last - x.first >= size OR y.k = y.n - 1)
  JOIN w ON w.doc_id = x.doc_id AND w.line = 0
  WHERE y.last - x.first <= 2 * size AND NOT (x.k = 0 AND y.k = y.n - 1)
), f AS (
  SELECT doc_id, i, j, l1, l2, license, no, len(list_intersect(own, pairs)) AS shared, 2 * len(list_intersect(own, pairs)) / (len(own) + len(pairs)) AS dice FROM r
), g AS (
  SELECT * FROM f WHERE dice >= {licenses.THRESHOLD}
    AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = f.doc_id AND m.license = f.license AND m.no = f.no AND m.line BETWEEN l1 AND l2)
  QUALIFY row_number() OVER (PARTITION BY doc_id, license, no ORDER BY dice DESC, i) = 1
), h AS (
  SELECT doc_id, license, dice FROM g WHERE NOT EXISTS (
    SELECT 1 FROM g o WHERE o.doc_id = g.doc_id AND o.i <= g.j AND g.i <= o.j AND (-o.shared, -o.dice, o.license, o.no) < (-g.shared, -g.dice, g.license, g.no))
)
SELECT doc_id, license, max(dice) AS dice, count(*) AS n_segments FROM (SELECT doc_id, license, dice FROM best UNION ALL SELECT doc_id, license, dice FROM h) GROUP BY ALL
"""


def _op8() -> str:
    q = quality_rules
    alpha = q.RISK / len(q.GRID)
    cells = sum(map(len, q.GRID.values()))
    grid = ", ".join(f"('{rule}', {i}, CAST({c} AS DOUBLE))" for rule, cuts in q.GRID.items() for i, c in enumerate(cuts))
    bad = " OR ".join(f"coalesce({r} > cut_{r}, false)" for r in q.GRID)
    picks = ", ".join(f"max(cut) FILTER (rule = '{r}') AS cut_{r}" for r in q.GRID)
    return rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
  FROM (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM w WHERE len(w) >= 8)
), rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(0, 8) r(k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
), d AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbols_per_word,
    n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_word_share,
    word_chars / greatest(n_words, 1) AS chars_per_word FROM m
), good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1),
held AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM good)),
long AS (UNPIVOT (SELECT lang, {", ".join(q.GRID)} FROM held) ON {", ".join(q.GRID)} INTO NAME rule VALUE v),
grid(rule, i, cut) AS (VALUES {grid}),
k AS (SELECT lang, rule, i, cut, count(*) AS n, count(*) FILTER (v > cut) AS k FROM long JOIN grid USING (rule) GROUP BY ALL),
p AS (
  SELECT *, CASE WHEN k >= n * {alpha} THEN 1 ELSE (
    SELECT sum(exp(lgamma(n + 1) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln(1 - {alpha})))
    FROM unnest(range(0, k + 1)) u(j)) END AS p FROM k
), ok AS (
  SELECT *, bool_and(p <= {q.DELTA} / ({cells} * (SELECT count(DISTINCT coalesce(lang, '')) FROM held)))
    OVER (PARTITION BY lang, rule ORDER BY i) AS fine FROM p
), best AS (SELECT lang, rule, arg_max(cut, i) AS cut FROM ok WHERE fine GROUP BY ALL),
cuts AS (SELECT lang AS stratum, {picks} FROM best GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({bad}) AS kept, {", ".join(q.GRID)}
FROM d LEFT JOIN cuts ON lang IS NOT DISTINCT FROM stratum
"""


#: The template's marks: `<s>` once, then around each text; a backslash goes before each control string.
_OP9 = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|<</?ROLE')) AS n,
    CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 20 + 2 * strlen(role) END AS marks
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + marks) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_rewrites
FROM e GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": _OP1, "op2_license_scan": _op2(), "op8_quality_rules": _op8(), "op9_chat_formatting": _OP9}
