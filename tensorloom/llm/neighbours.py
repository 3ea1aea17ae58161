"""Operator 6: approximate nearest neighbours with a hash-prefix forest.

A vector's hash in a tree is a long string of sign bits of random projections.  Each tree is a sorted
array of these strings.  A query descends every tree to the longest prefix that any string shares
with its own (two binary searches), and then all trees ascend together, one bit at a time, each step
widening every tree's range to the strings that share a prefix one bit shorter.

The ascent stops when what has been found makes a miss unlikely: two vectors with cosine s share a
bit with probability p = 1 - arccos(s) / pi, so a vector as near as the k-th best found so far stays
outside all ranges of L trees at prefix length x with probability at most (1 - p^x)^L.  Close
neighbours stop the ascent early; where nothing is close, it goes on down to short prefixes, and at
length 0 everything has been compared.  There is no cap on candidates.

Rows are dealt by hash of their id into blocks of about ``BLOCK``; a block's forest is built in the
task that holds it, and the queries (a stated set, one in fifty) visit each block in lots.  Each
visit gives at most k rows, so nothing grows with the number of candidates, equal vectors included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES, BITS = 48, 24
#: Chance that one neighbour is missed, at most.
MISS = 0.05
BLOCK = 8192
#: Queries of a block handled at once.
LOT = 256
SEED = 20240229


def projections(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, TREES * BITS))


def strings(x: np.ndarray) -> np.ndarray:
    """[tree, row] hash strings as integers, the first bit highest."""
    bits = (x @ projections(x.shape[1]) >= 0).reshape(len(x), TREES, BITS)
    return (bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).T.copy()


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of b's rows with a; equal rows give equal numbers, whatever their place."""
    return (b * a).sum(axis=1) / (np.sqrt((b * b).sum(axis=1)) * np.sqrt((a * a).sum()))


class Forest:
    """The trees over one block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
        codes = strings(self.unit)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def ranges(self, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """[tree, query] first and last (exclusive) place of the strings that share ``length`` bits."""
        low = codes >> (BITS - length) << (BITS - length)
        high = low + (1 << (BITS - length))
        return (
            np.array([np.searchsorted(t, q) for t, q in zip(self.sorted, low, strict=True)]),
            np.array([np.searchsorted(t, q) for t, q in zip(self.sorted, high, strict=True)]),
        )

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, its k best candidates of this block: ids and cosines; ties to the smaller id."""
        unit = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
        codes = strings(unit)
        seen = np.zeros((len(queries), len(self.ids)), bool)
        worst = np.full(len(queries), -np.inf)  # cosine of the k-th best found
        best: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        near: list[np.ndarray] = [np.zeros(0)] * len(queries)
        open_ = np.arange(len(queries))
        before: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in range(BITS, -1, -1):
            low, high = self.ranges(codes[:, open_], length)
            for j, q in enumerate(open_):
                a, b = low[:, j], high[:, j]
                if (b == a).all():
                    continue
                was = before.get(q, (a, a))
                parts = []
                for t in np.flatnonzero((a < was[0]) | (b > was[1])):
                    parts += [self.order[t, a[t] : was[0][t]], self.order[t, was[1][t] : b[t]]]
                before[q] = (a, b)
                if not parts:
                    continue
                new = np.concatenate(parts)
                new = new[~seen[q, new]]
                seen[q, new] = True
                new = np.unique(new)
                new = new[self.ids[new] != ids[q]]
                if not len(new):
                    continue
                rows, cos = np.concatenate([best[q], new]), np.concatenate([near[q], self.unit[new] @ unit[q]])
                if len(rows) > k:
                    # all that may tie with the k-th stay
                    kth = np.partition(cos, len(cos) - k)[len(cos) - k]
                    stay = cos >= kth - 1e-9
                    rows, cos = rows[stay], cos[stay]
                    if len(rows) > 4 * k:  # many equal vectors: smaller ids go first
                        exact = cosine(queries[q], self.x[rows])
                        top = np.lexsort((self.ids[rows], -exact))[:k]
                        rows, cos = rows[top], cos[top]
                    worst[q] = kth
                elif len(rows) == k:
                    worst[q] = cos.min()
                best[q], near[q] = rows, cos
            share = 1 - np.arccos(np.clip(worst[open_], -1, 1)) / math.pi
            missed = (1 - share**length) ** TREES
            open_ = open_[np.isinf(worst[open_]) | (missed > MISS)]
            if not len(open_):
                break
        out = []
        for q, rows in enumerate(best):
            exact = cosine(queries[q], self.x[rows]) if len(rows) else np.zeros(0)
            top = np.lexsort((self.ids[rows], -exact))[:k]
            out.append((self.ids[rows][top], exact[top]))
        return out


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0)


def _visits(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Sorted by block, rows before queries: builds a block's forest, then lets the queries through in lots."""
    block, rows, queries, forest = None, [], [], None

    def answers() -> Iterator[pd.DataFrame]:
        nonlocal forest, rows, queries
        if rows:
            forest, rows = Forest(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)), []
        if forest is not None and queries:
            ids = np.array([r[0] for r in queries])
            found = forest.search(ids, np.array([r[1] for r in queries], np.float64), k)
            yield pd.DataFrame({"query_id": np.repeat(ids, [len(f[0]) for f in found]), "vec_id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found])})
        queries = []

    for frame in frames:
        for b, asks, i, v in zip(frame["block"], frame["asks"], frame["id"], frame["vector"], strict=True):
            if b != block:
                yield from answers()
                block, forest = b, None
            (queries if asks else rows).append((i, v))
            if len(queries) == LOT:
                yield from answers()
    yield from answers()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` nearest rows by cosine, itself (its id) left out.

    Result: query_id, rank (from 1), vec_id, score (the cosine in double precision of the vectors as
    given).  Nearest first, ties to the smaller id; all candidates if there are fewer than k.
    Vectors that are null, empty, zero or hold a null or non-finite component take no part, on
    either side, nor do rows with a null id; vectors of different length never meet.  Repeated
    vectors are candidates each; repeated ids are one row (the first by vector); an empty table gives
    no rows.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
        return rows.groupBy("id").agg(F.min("vector").alias("vector"))

    rows = clean(vectors)
    blocks = max(1, round(rows.count() / BLOCK))  # one number
    dims = F.size("vector")
    rows = rows.select(F.struct(dims.alias("d"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b")).alias("block"), F.lit(False).alias("asks"), "id", "vector")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    asked = clean(queries).select("id", "vector", every.alias("b")).select(F.struct(dims.alias("d"), F.col("b")).alias("block"), F.lit(True).alias("asks"), "id", "vector")
    dealt = rows.unionByName(asked).withColumn("block", F.xxhash64("block")).repartition("block").sortWithinPartitions("block", "asks", "id")
    found = dealt.mapInPandas(lambda f: _visits(f, k), "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
