"""Operator 4: quality classifier, an interpolated modified Kneser-Ney model over characters.

The corpora here are of invented or rare words in several languages, so the n-grams are of
characters (white space collapsed, an end mark predicted).  Counts of n-grams of the highest order
are combined in tasks, sharded by n-gram and summed by Spark; continuation counts, discounts, back-off
weights and interpolated probabilities of all orders follow as joins and aggregations of these shards.

Every n-gram then gets one additive weight,

    weight(g) = [ log p(g) - log backoff(context of g) - log p(suffix of g) ] + log backoff(g),

with which the log-probability of a text is the sum of its n-grams' weights over all orders: whatever
n-gram is seen, its suffix is seen too, so the terms telescope to the usual back-off recursion.
Scoring is thus a join of documents' n-gram counts with the weights.  Where the weights are few enough
(``BROADCAST_ROWS``, checked at run time) they are sent to the tasks, which join in memory; beyond, the
documents' n-grams are shuffled to the shards of the weights.  Both give the same sums.

A document is rejected if its perplexity is above its language's quantile, taken over trusted texts
of like length that the model hasn't seen: short texts vary more.  A length class (a power of two of
characters) is set by the trusted documents in it and by the ends, as long as the class, of longer
ones.  What is taken is an upper confidence rank of the quantile, the greatest of few texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, released, sized, text_print, written

ORDER = 4
#: Weights sent to tasks, at most: 16 bytes each there, about four times that while they are built.
BROADCAST_ROWS = 2_000_000
#: Trusted documents with crc32(id) mod FOLDS = 0 set the thresholds, the others train.
FOLDS = 5
QUANTILE = 0.995
#: Chance that the rank taken is below the quantile, and texts under which all languages' limit and a normal quantile's are heeded too.
ERROR, FEW = 0.05, 60
#: Length classes: texts of 2 ** class characters up to twice as many; the first has shorter, the last longer ones too.
CLASSES = range(2, 13)
#: Resolution of the log-perplexity in which quantiles are counted.
BIN = 0.001
START, END = "\x02", "\x03"
#: Characters handled at once, and n-grams held per task before they are handed on.
LOT_CHARS, HELD = 1_000_000, 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACES = re.compile(r"\s+")


def padded(text: str | None, order: int = ORDER) -> str:
    return START * (order - 1) + _SPACES.sub(" ", (text or "").replace(START, " ").replace(END, " ")).strip() + END


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place, from place n - 1 on."""
    h = codes[: len(codes) - n + 1]
    for k in range(1, n):
        h = (h ^ (h >> np.uint64(29))) * BASE + codes[k : len(codes) - n + 1 + k]
    h = (h ^ (h >> np.uint64(32))) * BASE
    return h ^ (h >> np.uint64(29))


def _lots(texts: Iterator[tuple]) -> Iterator[list[tuple]]:
    lot, size = [], 0
    for row in texts:
        lot.append(row)
        size += len(row[-1])
        if size >= LOT_CHARS:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def ngram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, c): n-grams of the highest order in column ``text``, counted in tasks, then by shard."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for lot in _lots((padded(t, order),) for f in frames for t in f["text"]):
            codes = _codes([r[0] for r in lot])
            ends = np.cumsum([len(r[0]) for r in lot])
            ok = np.ones(len(codes), bool)
            for k in range(1, order):  # windows that would run over two texts
                ok[np.minimum(ends - k, len(codes) - 1)] = False
            ok = ok[: len(codes) - order + 1]
            hashes, first, n = np.unique(_hashes(codes, order)[ok], return_index=True, return_counts=True)
            at = np.flatnonzero(ok)[first]
            held.append((hashes, (codes[at[:, None] + np.arange(order)] - np.uint64(1)).astype(np.uint32), n))
            size += len(n)
            if size > HELD:
                held = [combined(held)]
                size = len(held[0][2])
                if size > HELD // 2:
                    yield flushed(*held[0])
                    held, size = [], 0
        if held:
            yield flushed(*combined(held))

    def combined(held: list[tuple]) -> tuple:
        hashes, first, at = np.unique(np.concatenate([h for h, _, _ in held]), return_index=True, return_inverse=True)
        n = np.bincount(at, np.concatenate([n for _, _, n in held]), len(hashes)).astype(np.int64)
        return hashes, np.concatenate([g for _, g, _ in held])[first], n

    def flushed(_: np.ndarray, grams: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        flat = grams.tobytes().decode("utf-32-le", "replace")
        return pd.DataFrame({"g": pd.Series([flat[i : i + order] for i in range(0, len(flat), order)], dtype=object), "c": n})

    return texts.select("text").mapInPandas(released(run), "g string, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _discount(a: str) -> Column:
    return F.when(F.col(a) == 1, F.col("d1")).when(F.col(a) == 2, F.col("d2")).otherwise(F.col("d3"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, float]:
    """(g, weight) of all n-grams of 1 to ``order`` characters, and the log-probability of an unknown character.

    ``counts`` has (g, c) of the highest order.  Lower orders count the different characters seen
    before them; discounts come from counts of counts 1 to 4 of their own order.
    """
    levels = {order: counts.select("g", F.col("c").alias("a"))}
    for n in range(order - 1, 0, -1):
        levels[n] = written(levels[n + 1].groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("a")))
    lower, unknown, tables = None, 0.0, []
    for n in range(1, order + 1):
        level = levels[n]
        # a padded start is context only, never predicted
        if n < order:
            level = level.filter(~F.col("g").endswith(START))
        t = level.agg(*[F.coalesce(F.sum((F.col("a") == i).cast("double")), F.lit(0.0)) for i in range(1, 5)]).first()  # four numbers
        y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.0
        d1, d2, d3 = (min(max(i - (i + 1) * y * t[i] / t[i - 1], 0.05), i) if t[i - 1] else 0.5 * i for i in (1, 2, 3))
        level = level.withColumns({"h": F.expr(f"substring(g, 1, {n - 1})"), "d1": F.lit(d1), "d2": F.lit(d2), "d3": F.lit(d3)})
        # a context's characters are bounded by the alphabet; its sums are combined in tasks first
        kinds_of = [F.sum((F.col("a") == i).cast("long") if i < 3 else (F.col("a") >= 3).cast("long")) for i in (1, 2, 3)]
        off = sum(d * k for d, k in zip((d1, d2, d3), kinds_of, strict=True))  # whole numbers are summed, so reruns agree
        context = level.groupBy("h").agg(F.sum("a").alias("total"), off.alias("off")).withColumn("backoff", F.col("off") / F.col("total"))
        context = written(context.select("h", "total", "backoff"))
        if n == 1:
            row = context.first()
            total, backoff = (row["total"], row["backoff"]) if row else (1, 1.0)
            kinds = level.count() + 1  # characters seen, and the unknown
            p = (F.col("a") - _discount("a")) / total + backoff / kinds
            unknown = math.log(backoff / kinds)
            lower = written(level.select("g", F.log(p).alias("logp"), F.log(p).alias("delta")))
        else:
            seen = level.join(context, "h").join(lower.select(F.col("g").alias("s"), F.col("logp").alias("below")), F.expr("substring(g, 2)") == F.col("s"))
            p = (F.col("a") - _discount("a")) / F.col("total") + F.col("backoff") * F.exp("below")
            lower = written(seen.select("g", F.log(p).alias("logp"), (F.log(p) - F.log("backoff") - F.col("below")).alias("delta")))
            tables.append(context.select(F.col("h").alias("g"), F.log("backoff").alias("w")))
        tables.append(lower.select("g", F.col("delta").alias("w")))
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.groupBy("g").agg(F.sum("w").alias("weight")), unknown


class Weights:
    """Open-addressing table of hashed n-grams, looked up many at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.float32)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.keys[slot[own]], self.values[slot[own]] = keys[own], values[own]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        slot = self._slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.float32(default))
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there != 0)]
        return out


def _sums(texts: list[str], tables: list[Weights], unknown: float, order: int) -> np.ndarray:
    """Log-probability of each padded text."""
    codes = _codes(texts)
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
    total = np.zeros(len(codes))
    for n in range(1, order + 1):
        got = tables[n - 1].get(_hashes(codes, n), unknown if n == 1 else 0.0)
        total[n - 1 :] += got
        for k in range(n - 1):  # windows that began in the text before
            at = begins + k
            total[at[at >= n - 1]] -= got[at[at >= n - 1] - (n - 1)]
    # of the padding, only windows that end at its last character are contexts of something predicted
    for k in range(order - 2):
        total[begins + k] = 0
    pad = _hashes(np.array([ord(START) + 1], np.uint64), 1)
    if order > 1 and np.isnan(tables[0].get(pad, np.nan)[0]):
        total[begins + order - 2] -= unknown
    return np.add.reduceat(total, begins)


def score(docs: DataFrame, weights: DataFrame, unknown: float, keep: list[str], order: int = ORDER, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keep`` columns, n_chars (predicted characters, the end included) and logp of column ``text``."""
    weights = written(weights)
    if weights.count() <= broadcast_rows:
        return _score_broadcast(docs, weights, unknown, keep, order)
    return _score_shuffled(docs, weights, unknown, keep, order)


def _score_broadcast(docs: DataFrame, weights: DataFrame, unknown: float, keep: list[str], order: int) -> DataFrame:
    table = weights.toArrow()
    grams, values = table["g"].to_pylist(), table["weight"].to_numpy()
    by_length: list[list[int]] = [[] for _ in range(order)]
    for i, g in enumerate(grams):
        if g:
            by_length[len(g) - 1].append(i)
    parts = [(_hashes(_codes([grams[i] for i in own]), n + 1)[:: n + 1] if own else np.zeros(0, np.uint64), values[own].astype(np.float32)) for n, own in enumerate(by_length)]
    sent = docs.sparkSession.sparkContext.broadcast(parts)  # at most BROADCAST_ROWS numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [Weights(*p) for p in sent.value]
        for frame in frames:
            texts = [padded(t, order) for t in frame["text"]]
            sums, at = [], 0
            for lot in _lots((t,) for t in texts):
                sums.append(_sums([r[0] for r in lot], tables, unknown, order))
                at += len(lot)
            yield frame[keep].assign(n_chars=[len(t) - order + 1 for t in texts], logp=np.concatenate(sums) if sums else np.zeros(0))

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, "text").mapInPandas(released(run), ", ".join([*kinds, "n_chars long, logp double"]))


def _score_shuffled(docs: DataFrame, weights: DataFrame, unknown: float, keep: list[str], order: int) -> DataFrame:
    """The same sums by a shuffle join of per-document n-gram counts with the weights."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 64):
                rows = []
                for row, text in zip(frame["_row"].iloc[at : at + 64], frame["text"].iloc[at : at + 64], strict=True):
                    t = padded(text, order)
                    found = Counter(t[i : i + n] for n in range(1, order + 1) for i in range(max(0, order - 1 - n), len(t) - n + 1))
                    rows += [(row, g, c) for g, c in found.items()]
                yield pd.DataFrame(rows, columns=["_row", "g", "n"], dtype=object).astype({"_row": "int64", "n": "int64"})

    numbered = written(docs.select(*keep, "text").withColumn("_row", F.monotonically_increasing_id()))
    grams = numbered.select("_row", "text").mapInPandas(released(run), "_row long, g string, n long")
    missing = F.when((F.length("g") == 1) & (F.col("g") != START), F.lit(unknown)).otherwise(0.0)
    weight = F.coalesce(F.col("weight").cast("float").cast("double"), missing)
    predicted = F.when((F.length("g") == 1) & (F.col("g") != START), F.col("n")).otherwise(0)
    sums = grams.join(weights, "g", "left").groupBy("_row").agg(F.sum(F.col("n") * weight).alias("logp"), F.sum(predicted).alias("n_chars"))
    return numbered.join(sums, "_row").select(*keep, "n_chars", "logp")


@lru_cache(maxsize=10_000)
def spare(n: int, quantile: float = QUANTILE) -> int:
    """How many of n texts may lie above the limit: the most for which P(Bin(n, 1 - quantile) <= it) is at most ERROR, or none."""
    p = 1 - quantile
    total, k = 0.0, 0
    while k < n * p:
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
        if total > ERROR:
            break
        k += 1
    return max(k - 1, 0)


def length_class(n_chars: Column) -> Column:
    return F.least(F.greatest(F.length(F.bin(n_chars)) - 1, F.lit(CLASSES[0])), F.lit(CLASSES[-1]))


def stretches(held: DataFrame) -> DataFrame:
    """The ends of each text, as long as the classes below its length; they begin with a word where they can."""
    short = F.array(*[F.lit(c) for c in CLASSES])
    each = held.withColumn("class", F.explode(F.filter(short, lambda c: F.length("text") > F.pow(F.lit(2), c))))
    return each.withColumn("text", F.regexp_replace(F.expr("right(text, cast(pow(2, class) as int))"), r"^\S*\s+(?=\S)", ""))


def limits(held: DataFrame, quantile: float = QUANTILE) -> tuple[DataFrame, DataFrame]:
    """(lang, limits) and the one row (limits) of all languages: [(class, limit in bins)], from (lang, class, logp, n_chars) of held-out texts."""
    mean = -F.col("logp") / F.col("n_chars")
    bins = cut(held.groupBy("lang", "class", F.ceil(mean / BIN).alias("bin")).agg(F.count("*").alias("n")))  # bounded: bins per class
    above = F.udf(lambda n: spare(n, quantile), "long")

    def ranked(b: DataFrame, keys: list[str]) -> DataFrame:
        over = Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        few = b.groupBy(*keys).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("bin")).alias("s"), F.sum(F.col("n") * F.col("bin") * F.col("bin")).alias("ss"))
        deviation = F.sqrt(F.greatest(F.col("ss") - F.col("s") * F.col("s") / F.col("all"), F.lit(0)) / F.greatest(F.col("all") - 1, F.lit(1)))
        # upper confidence limit of a normal quantile, for few texts
        z, sure = NormalDist().inv_cdf(quantile), NormalDist().inv_cdf(1 - ERROR)
        factor = z + sure * F.sqrt(1 / F.col("all") + z * z / 2 / F.greatest(F.col("all") - 1, F.lit(1)))
        bound = F.when(F.col("all") < FEW, F.ceil(F.col("s") / F.col("all") + factor * deviation))
        few = few.select(*[F.col(k).alias(f"_{k}") for k in keys], "all", above("all").alias("spare"), bound.alias("bound"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        # the least bin with no more texts above it than may be
        return b.withColumn("over", F.coalesce(F.sum("n").over(over), F.lit(0))).join(few, same).filter("over <= spare").groupBy(*keys).agg(F.greatest(F.min("bin"), F.first("bound")).alias("limit"), F.first("all").alias("all"))

    every = cut(ranked(bins.groupBy("class", "bin").agg(F.sum("n").alias("n")), ["class"]))
    own = ranked(bins, ["lang", "class"]).join(every.select("class", F.col("limit").alias("wide")), "class")
    own = own.withColumn("limit", F.when(F.col("all") < FEW, F.greatest("limit", "wide")).otherwise(F.col("limit")))
    listed = F.sort_array(F.collect_list(F.struct("class", "limit"))).alias("limits")  # as many as CLASSES
    return own.groupBy("lang").agg(listed), every.agg(listed)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, quantile: float = QUANTILE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Perplexity and verdict of every document.

    Trusted documents are those whose labels all have quality 1 and none toxic.  Result, a row per
    input row: id, lang, n_chars, perplexity, threshold (of the text's length), kept.  Null text
    counts as empty (only its end is predicted); a null language is one of its own; a language whose
    trusted documents are all in training has the threshold of all languages; one without trusted
    documents, of which the model knows nothing, has a null threshold and keeps everything; equal
    texts get equal scores, repeated rows stay repeated, repeated labels count once; empty tables
    work (the model is then uniform); other columns aren't read.
    """
    out = _classified(docs, labels, id_col, text_col, lang_col, order, quantile, broadcast_rows)
    return out.select(F.col("_id").alias(id_col), "lang", "n_chars", "perplexity", "threshold", "kept")


def _classified(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, order: int, quantile: float, broadcast_rows: int) -> DataFrame:
    """(_id, row, lang, n_chars, perplexity, threshold, kept); ``row`` is the text's hash."""
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(0))
    trusted = labels.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("q"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("t")).filter("q = 1 and t = 0").select("_id")
    trusted = sized(trusted)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), fold.alias("fold"), text_print(F.col(text_col)).alias("row"))
    training = rows.filter("fold != 0").join(trusted, "_id", "left_semi")
    counts = written(ngram_counts(training, order))
    weights, unknown = kneser_ney(counts, order)
    ends = written(stretches(rows.filter("fold = 0").join(trusted, "_id", "left_semi")))
    every = rows.withColumn("class", F.lit(None).cast("int")).unionByName(ends)
    every = written(score(every, weights, unknown, ["_id", "row", "lang", "fold", "class"], order, broadcast_rows))
    scored = every.filter("class is null").drop("class")
    held = scored.filter("fold = 0").join(trusted, "_id", "left_semi").withColumn("class", length_class(F.col("n_chars")))
    own, pooled = limits(held.unionByName(every.filter("class is not null")), quantile)
    learnt = scored.join(trusted, "_id", "left_semi").select(F.col("lang").alias("_lang")).distinct()
    known = learnt.join(own, F.col("_lang").eqNullSafe(F.col("lang")), "left").join(pooled.withColumnRenamed("limits", "_every"), F.lit(True))
    known = cut(known.select("_lang", F.coalesce("limits", "_every").alias("limits")))  # a row per language
    out = scored.join(known, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("class", length_class(F.col("n_chars")))
    # a class without texts takes the next shorter one's limit, which isn't below its own
    shorter = F.filter("limits", lambda e: e["class"] <= F.col("class"))
    limit = F.coalesce(F.get(F.reverse(shorter), F.lit(0))["limit"], F.get("limits", F.lit(0))["limit"])
    out = out.withColumn("limit", limit).withColumn("bin", F.ceil(-F.col("logp") / F.col("n_chars") / BIN))
    return out.select(
        "_id", "row", "lang", "n_chars", F.exp(-F.col("logp") / F.col("n_chars")).alias("perplexity"),
        F.exp(F.col("limit") * BIN).alias("threshold"), F.coalesce(F.col("bin") <= F.col("limit"), F.lit(True)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, quantile: float = QUANTILE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents that :func:`classify` keeps, with all their columns.

    Each row is judged by its own text and language, whatever other rows have its id; rows without an
    id or with a null or empty text are judged alike (an id only says what is trusted); any column
    names will do; an empty table gives none.
    """
    judged = _classified(docs, labels, id_col, text_col, lang_col, order, quantile, broadcast_rows)
    key, mark, tongue = fresh(docs, "bad_id", "bad_row", "bad_lang")
    bad = judged.filter("not kept").select(F.col("_id").alias(key), F.col("row").alias(mark), F.col("lang").alias(tongue)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(key)) & (text_print(F.col(text_col)) == F.col(mark)) & F.col(lang_col).cast("string").eqNullSafe(F.col(tongue))
    return docs.join(sized(bad), same, "left_anti")
