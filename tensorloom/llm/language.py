"""Operator 10: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A text's score in a
language is the sum over *all* ways to cut it into pieces of the product of their probabilities,
computed by the forward algorithm.  No piece holds white space inside, so the sum factorises over
words, and a word's score is computed once per batch and looked up afterwards.

Probabilities are learnt by expectation maximisation: counts of (language, word) are gathered over
all training text by Spark, each iteration's expected piece counts are summed by Spark, and what
comes to the driver is one number for each piece and language: the vocabulary is fixed, so its size
is bounded whatever the input.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written

SPACE = "▁"
#: Iterations; likelihood hardly moves afterwards.
ITERATIONS = 3
#: Pseudo-count of every piece, and the probability of a character that no piece covers.
SMOOTHING, UNKNOWN = 0.1, 1e-7
#: Words kept per task, characters of texts handled at once, and (divided by languages) of words put through the forward algorithm at once.
CACHE_WORDS, TEXT_CHARS, LOT_CHARS = 200_000, 2_000_000, 400_000
#: Typical probability per character; products are scaled by it so that they stay near 1.
PER_CHAR = 0.05
#: Sums of words more than twice as long are divided by their largest every so many characters.
RESCALE = 8
#: Languages that can be told apart, at most: a task holds a number for each piece and language.
MAX_LANGS = 400

LETTER = re.compile(r"[^\W\d_]")


class Pieces:
    """The vocabulary as a trie whose edges are hashed, so that many characters are looked up at once."""

    def __init__(self, model_path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        trie, ends = {}, {0: -1}
        self.size = len(model.pieces)
        self.longest = 1
        for i, piece in enumerate(model.pieces):
            if piece.type != 1:  # neither control, unknown nor byte pieces
                continue
            node = 0
            self.longest = max(self.longest, len(piece.piece))
            for c in piece.piece:
                key = node << 21 | ord(c)
                if key not in trie:
                    trie[key] = len(trie) + 1
                    ends[trie[key]] = -1
                node = trie[key]
            ends[node] = i
        self.ends = np.array([ends[i] for i in range(len(ends))], np.int32)
        self.first = np.zeros(0x110000, np.int32)  # child of the root by character, 0 if none
        for key, node in trie.items():
            if key < 1 << 21:
                self.first[key] = node
        self.bits = (4 * len(trie)).bit_length()
        self.keys, self.child = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        keys, nodes = np.array(list(trie), np.int64), np.array(list(trie.values()), np.int32)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):  # linear probing, many at once
            free = left[self.keys[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            own = free[one]
            self.keys[slot[own]], self.child[slot[own]] = keys[own], nodes[own]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Children of nodes by characters; 0 where there is none."""
        key = node.astype(np.int64) << 21 | char
        slot = self._slots(key)
        there = self.keys[slot]
        out = np.where(there == key, self.child[slot], 0)
        left = np.flatnonzero((there != key) & (there >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
            there = self.keys[slot[left]]
            hit = there == key[left]
            out[left[hit]] = self.child[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out

    def lattice(self, words: list[str]) -> Lattice:
        """All pieces at all places of the words; a single character that isn't a piece is piece ``size``."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.arange(len(chars))
        stop = np.repeat(np.cumsum(n), n)  # where each place's word ends
        node = self.first[chars]
        piece = np.where(node > 0, self.ends[node], -1)
        starts, lengths, found = [at], [np.ones(len(at), np.int64)], [np.where(piece < 0, self.size, piece)]
        here = np.flatnonzero((node > 0) & (stop > at + 1))
        node = node[here]
        for length in range(2, self.longest + 1):
            if not len(here):
                break
            node = self._step(node, chars[here + length - 1])
            on = node > 0
            here, node = here[on], node[on]
            piece = self.ends[node]
            whole = piece >= 0
            starts.append(here[whole])
            lengths.append(np.full(int(whole.sum()), length))
            found.append(piece[whole])
            on = stop[here] > here + length
            here, node = here[on], node[on]
        return Lattice(n, np.concatenate(starts), np.concatenate(lengths), np.concatenate(found))


class Lattice:
    """Pieces that start at places of words laid end to end: ``start``, ``length`` and ``piece`` of each edge.

    In tables of sums a word of n characters has n + 1 places, 0 to n, after those of the words before.
    """

    def __init__(self, n: np.ndarray, start: np.ndarray, length: np.ndarray, piece: np.ndarray) -> None:
        self.n, self.length, self.piece = n, length, piece
        begin = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
        self.word = np.repeat(np.arange(len(n)), n)[start]
        self.offset = start - begin[self.word]
        self.begin = begin + np.arange(len(n))  # of a word in the tables

    def forward(self, scaled: Weights, longest: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """[place, language] sums over all ways from a word's begin (``back``: end) to a place, and the
        logarithm of what each was divided by.

        All edges that leave one offset end at different places, so each offset is one addition.  Long
        words are divided by their largest sum every ``RESCALE`` characters, in each language on its own.
        """
        size = int(self.n.sum()) + len(self.n)
        sums, logs = np.zeros((2, size, scaled.probability.shape[1]))
        offset = self.n[self.word] - self.offset - self.length if back else self.offset
        begin = self.begin + self.n if back else self.begin
        sign = -1 if back else 1
        sums[begin] = 1
        last = int(self.n.max(initial=0))
        order = np.argsort(offset.astype(np.uint16) if last < 1 << 16 else offset, kind="stable")  # short keys sort by radix
        bounds = np.searchsorted(offset[order], np.arange(last + 1))
        source = (begin[self.word] + sign * offset)[order]
        target = source + sign * self.length[order]
        weight = scaled.of(self.piece[order], self.length[order])
        long = np.flatnonzero(self.n > 2 * RESCALE)
        for at in range(len(bounds) - 1):
            if at and at % RESCALE == 0 and len(long):
                long = long[self.n[long] > at]
                ahead = np.minimum(at + np.arange(longest + 1), self.n[long][:, None])
                places = begin[long][:, None] + sign * ahead
                top = sums[places].max(axis=1)
                sums[places] /= top[:, None]
                logs[begin[long] + sign * at] += np.log(top)
            edges = slice(bounds[at], bounds[at + 1])
            sums[target[edges]] += sums[source[edges]] * weight[edges]
        for w in np.flatnonzero(self.n > 2 * RESCALE):  # a place's divisor holds up to the word's end
            own = slice(self.begin[w], self.begin[w] + self.n[w] + 1)
            logs[own] = np.cumsum(logs[own][::sign], axis=0)[::sign]
        return sums, logs


@lru_cache(maxsize=2)
def pieces_of(model_path: str) -> Pieces:
    return Pieces(model_path)


class Weights:
    """[piece, language] probabilities, and by length the inverse of as many typical characters' probability."""

    def __init__(self, probability: np.ndarray) -> None:
        self.probability = probability if probability.ndim == 2 else probability[:, None]
        self.factor = PER_CHAR ** -np.arange(64.0)

    def of(self, piece: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = self.probability[piece]
        out *= self.factor[length][:, None]
        return out


def lots(words: list[str], langs: int) -> Iterator[np.ndarray]:
    """Places of words, those of like length together, in lots of bounded characters; a word is never cut."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    lot = np.cumsum(size[order]) // max(LOT_CHARS // max(langs, 1), 1)
    for part in np.split(order, np.flatnonzero(np.diff(lot)) + 1):
        if len(part):
            yield part


def scores(pieces: Pieces, words: list[str], scaled: Weights) -> np.ndarray:
    """[word, language] log of the sum over all segmentations."""
    out = np.empty((len(words), scaled.probability.shape[1]))
    for own in lots(words, out.shape[1]):
        lattice = pieces.lattice([words[i] for i in own])
        sums, logs = lattice.forward(scaled, pieces.longest)
        last = lattice.begin + lattice.n
        out[own] = np.log(sums[last]) + logs[last] + lattice.n[:, None] * math.log(PER_CHAR)
    return out


def expected(pieces: Pieces, words: list[str], count: np.ndarray, scaled: Weights) -> np.ndarray:
    """Expected number of each piece over all segmentations of counted words in one language."""
    total = np.zeros(pieces.size + 1)
    for own in lots(words, 2):
        lattice = pieces.lattice([words[i] for i in own])
        alpha, alog = (t[:, 0] for t in lattice.forward(scaled, pieces.longest))
        beta, blog = (t[:, 0] for t in lattice.forward(scaled, pieces.longest, back=True))
        last = lattice.begin + lattice.n
        begin = lattice.begin[lattice.word] + lattice.offset
        end = begin + lattice.length
        share = alpha[begin] * scaled.of(lattice.piece, lattice.length)[:, 0] * beta[end]
        if (lattice.n > 2 * RESCALE).any():
            share = share * np.exp(alog[begin] + blog[end] - alog[last][lattice.word])
        total += np.bincount(lattice.piece, share * (count[own] / alpha[last])[lattice.word], len(total))
    return total


def split(text: str) -> list[str]:
    """Words with their mark in front."""
    return [SPACE + w for w in text.split()]


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n) over all given rows; counted in tasks before they are shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                held.setdefault(lang, Counter()).update(split(text))
                if sum(map(len, held.values())) > CACHE_WORDS:
                    yield flushed(held)
                    held = {}
        yield flushed(held)

    def flushed(held: dict[str, Counter]) -> pd.DataFrame:
        langs, sizes = pd.Series(list(held), dtype=object), [len(c) for c in held.values()]
        words = pd.Series([w for c in held.values() for w in c], dtype=object)
        counts = np.fromiter((n for c in held.values() for n in c.values()), np.int64, len(words))
        return pd.DataFrame({"lang": langs.repeat(sizes).array, "word": words, "n": counts})

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    return rows.mapInPandas(released(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(counts: DataFrame, model_path: str, iterations: int = ITERATIONS) -> tuple[list[str], np.ndarray]:
    """Languages, and [piece, language] probabilities, from (lang, word, n) rows."""
    size = pieces_of(model_path).size
    langs = [r[0] for r in counts.select("lang").distinct().orderBy("lang").limit(MAX_LANGS + 1).collect()]
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    probability = np.full((size + 1, len(langs)), 1 / size)
    probability[size] = UNKNOWN
    for _ in range(iterations if langs else 0):
        column = {lang: i for i, lang in enumerate(langs)}

        def run(frames: Iterator[pd.DataFrame], probability=probability) -> Iterator[pd.DataFrame]:
            pieces, total = pieces_of(model_path), {}
            for frame in frames:
                for lang, part in frame.groupby("lang"):
                    got = expected(pieces, part["word"].tolist(), part["n"].to_numpy(float), Weights(probability[:, column[lang]]))
                    total[lang] = total.get(lang, 0) + got
            for lang, got in total.items():
                there = np.flatnonzero(got)
                yield pd.DataFrame({"lang": pd.Series([lang] * len(there), dtype=object), "piece": there, "n": got[there]})

        # rounded, so that the order of additions leaves no trace
        found = counts.mapInPandas(released(run), "lang string, piece long, n double").groupBy("lang", "piece").agg(F.round(F.sum("n"), 3).alias("n")).toPandas()
        weight = np.full((size + 1, len(langs)), SMOOTHING)
        weight[found["piece"].to_numpy(int), found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)] += found["n"].to_numpy(float)
        probability = weight / weight[:size].sum(axis=0)
        probability[size] = UNKNOWN
    return langs, probability


def predict(docs: DataFrame, langs: list[str], probability: np.ndarray, model_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred and score (posterior under equal priors; ties go to the first language)."""
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, scaled = pieces_of(model_path), Weights(probability)
        known: dict[str, int] = {}
        table = np.empty((0, len(langs)))
        for whole in frames:
            texts = [t if isinstance(t, str) and LETTER.search(t) else "" for t in whole["_text"]]
            lot = np.cumsum([len(t) for t in texts]) // TEXT_CHARS
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(lot)) + 1):
                split_ = [split(texts[i]) for i in part]
                if len(known) > CACHE_WORDS:
                    known, table = {}, table[:0]
                new = list({w for s in split_ for w in s if w not in known})
                if new and langs:
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    table = np.concatenate([table, scores(pieces, new, scaled)])
                pred, score = [], []
                for s in split_:
                    if not s or not langs:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    sums = table[[known[w] for w in s]].sum(axis=0)
                    best = int(sums.argmax())
                    pred.append(langs[best])
                    score.append(float(1 / np.exp(np.maximum(sums - sums[best], -700)).sum()))
                yield whole[keep].iloc[part].assign(lang_pred=pred, score=score)

    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    return rows.mapInPandas(released(run), ", ".join([*kinds, "lang_pred string", "score double"]))


def identify(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Language of every text, learnt from two thirds of the rows.

    Rows whose crc32(id as text) mod 3 is 1 are held out; the others with a language and a text are
    learnt from.  Result, a row per input row: id, held_out, lang_pred, score.  More than ``MAX_LANGS`` languages to learn are an
    error.  A null text, or one
    without a letter, is ``und`` with score 0; so is everything where nothing can be learnt.  A null
    id isn't held out.  Repeated rows count repeatedly; an empty table gives no rows; further
    columns aren't read.
    """
    rows = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col), F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"))
    counts = written(word_counts(rows.filter(~F.col("held_out")), text_col, lang_col))
    langs, probability = learn(counts, model_path)
    return predict(rows, langs, probability, model_path, [id_col, "held_out"], text_col)
