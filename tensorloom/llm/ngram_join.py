"""Operator 1: n-gram Jaccard join with token-combination prefixes.

Tokens are a text's distinct word shingles.  All tokens have one global order, by a corpus-wide count
and then by hash: rare ones first.  Two sets of Jaccard similarity t or more share at least
ceil(t * n) of either's n tokens, so at most e = n - ceil(t * n) of a set's tokens are missing in its
partner.  A set is indexed under

* each of its first rare tokens, singly, and
* if these are no more than e, each *pair* of its following frequent tokens, as many that
  (rare) + (frequent - 1) > e.

Of the prefix of the set whose prefix ends first, more tokens are shared than could be missing; so
either a rare token is shared, or two frequent ones, and both sets are indexed under it.  Pairs are
used for sets of up to ``PAIR_PREFIX`` prefix tokens, where there are few; larger sets are indexed by
single tokens, and sets whose size is near the limit both ways, since their partners may lie beyond.

The counts are those of a fixed number of slots that tokens hash to, summed over all texts: an upper
bound is all that the order needs, for any order gives the same result.

Sets under one index key are not paired with each other.  The most central of them (whose prefix is
most frequent) is the pivot, and the others are compared with it.  Jaccard distance is a metric, so
of those not linked to the pivot, only pairs whose distances from it differ by at most 1 - t can be
links; these are compared in blocks of bounded size that give back a spanning forest, not pairs.
Equal sets are one vertex from the start, and a key's sets are split where their sizes leave a gap
that no link can cross.

Both comparisons go by bitmaps first: a set's bitmap has the parity of its tokens in each of about n
slots, so two sets differ in at least as many tokens as their bitmaps differ in bits.  That is a
proof that most candidates aren't links, at a sixtieth of a set's size; only where it doesn't
decide are the sets themselves compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, released, sized, text_print, written
from .components import components
from .shingles import fingerprint, mixed, shingle_set

#: Slots of the count sketch, and slots in a row of it.
SLOTS, ROW_SLOTS = 1 << 22, 1 << 12
#: A token is frequent if its slot's count is above this many times the mean slot.
FREQUENT = 8
#: Sets with more single prefix tokens are indexed by single tokens only.
PAIR_PREFIX = 24
#: Members of a block, both sides.
BLOCK = 1024
#: Up to so many needed ids (8 bytes each) are sent to the scan; beyond, the texts are shuffled.
BROADCAST_IDS = 2_000_000
#: Texts handled at once, and sets that a task remembers to have handed on.
ROWS, REMEMBERED = 512, 100_000


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of a set's tokens in a power of two of slots, no fewer than tokens."""
    slots = max(64, 1 << (len(tokens) - 1).bit_length())
    count = np.bincount((mixed(tokens) & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (last axis) of fewer slots: those that a smaller set of slots would have given."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tokens that two sets differ in, at least."""
    size = min(a.shape[-1], b.shape[-1])
    return np.bitwise_count(folded(a, size) ^ folded(b, size)).sum(axis=-1, dtype=np.int64)


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _scanned(docs: DataFrame, n: int) -> DataFrame:
    """One pass: a row (kind 0) per document with its set's size and hash, and rows (kind 1) of the sketch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SLOTS, np.int32)
        for frame in frames:
            sets = [shingle_set(t, n) for t in frame["text"]]
            for s in sets:
                np.add.at(counts, _slots(s), 1)
            prints = pd.array([fingerprint(s) if len(s) else None for s in sets], dtype="Int64")
            yield pd.DataFrame({"kind": 0, "id": frame["id"], "row": frame["row"], "n": [len(s) for s in sets], "print": prints, "bits": [bitmap(s) if len(s) else None for s in sets], "counts": None})
        at = np.flatnonzero(counts.reshape(-1, ROW_SLOTS).any(axis=1))
        for lot in range(0, len(at), 64):
            part = at[lot : lot + 64]
            yield pd.DataFrame({"kind": 1, "id": part, "row": 0, "n": 0, "print": pd.array([None] * len(part), dtype="Int64"), "bits": None, "counts": [counts[i * ROW_SLOTS : (i + 1) * ROW_SLOTS].tobytes() for i in part]})

    return docs.mapInPandas(released(run), "kind int, id long, row long, n long, print long, bits binary, counts binary")


def _sketch(rows: DataFrame) -> np.ndarray:
    """The summed sketch; a fixed number of bytes, whatever the input."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total = None, None
        for frame in frames:
            for i, c in zip(frame["id"], frame["counts"], strict=True):
                if i != last:
                    if last is not None:
                        yield pd.DataFrame({"id": [last], "counts": [total.tobytes()]})
                    last, total = i, np.zeros(ROW_SLOTS, np.int64)
                total += np.frombuffer(c, np.int32)
        if last is not None:
            yield pd.DataFrame({"id": [last], "counts": [total.tobytes()]})

    out = np.zeros(SLOTS, np.int64)
    summed = rows.select("id", "counts").repartition("id").sortWithinPartitions("id").mapInPandas(add, "id long, counts binary")
    for i, c in summed.collect():  # SLOTS numbers
        out[i * ROW_SLOTS : (i + 1) * ROW_SLOTS] = np.frombuffer(c, np.int64)
    return out


def index_keys(tokens: np.ndarray, counts: np.ndarray, limit: float, num: int, den: int) -> np.ndarray:
    """Index keys of a set; ``counts`` are its tokens' slot counts."""
    n = len(tokens)
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    missing = n - -(-num * n // den)
    largest = PAIR_PREFIX * den // (den - num)  # size up to which pairs are used
    parts = []
    # by single tokens: sets near or above that size, and those so small that two shared tokens aren't certain, or their partners
    if n > num * largest // den or n * num * num <= den * den:
        parts.append(mixed(tokens[: missing + 1]))
    if n <= largest:
        rare = int(np.searchsorted(counts, limit, "right"))
        if rare > missing:
            parts.append(mixed(tokens[: missing + 1]))
        else:
            often = tokens[rare : missing + 2]
            i, j = np.triu_indices(len(often), 1)
            parts += [mixed(tokens[:rare]), mixed(mixed(often[i]) * np.uint64(3) + often[j])]
    return np.unique(np.concatenate(parts)).view(np.int64)


def _keys(docs: DataFrame, n: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """(key, v, size, central): index keys of every set; of equal sets a task hands on one, as long as it remembers it."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)  # SLOTS numbers
    limit = max(64.0, FREQUENT * float(sketch.mean()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()
        for whole in frames:
            for at in range(0, len(whole), ROWS):
                keys, prints, sizes, central = [], [], [], []
                if len(met) > REMEMBERED:
                    met.clear()
                for text in whole["text"].iloc[at : at + ROWS]:
                    s = shingle_set(text, n)
                    if not len(s) or fingerprint(s) in met:
                        continue
                    met.add(fingerprint(s))
                    counts = sent.value[_slots(s)]
                    keys.append(index_keys(s, counts, limit, num, den))
                    prints.append(fingerprint(s))
                    sizes.append(len(s))
                    central.append(float(np.log2(np.sort(counts)[: max(1, len(s) * (den - num) // den)]).mean()))
                n_keys = [len(k) for k in keys]
                if keys:
                    yield pd.DataFrame({"key": np.concatenate(keys), "v": np.repeat(np.array(prints), n_keys), "size": np.repeat(np.array(sizes, np.int32), n_keys), "central": np.repeat(np.array(central, np.float32), n_keys)})

    return docs.select("text").mapInPandas(released(run), "key long, v long, size int, central float")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(v, tokens) of the wanted vertices; ``wanted`` has (v, id)."""
    rows = docs.join(sized(wanted, BROADCAST_IDS), "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"v": frame["v"], "tokens": [shingle_set(t, n).tobytes() for t in frame["text"]]})

    # repeated ids may stand for several texts: only the wanted set stays, repeated where its row is
    def right(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in run(frames):
            yield frame[[fingerprint(np.frombuffer(t, np.uint64)) == v for v, t in zip(frame["v"], frame["tokens"], strict=True)]]

    return rows.select("v", "text").mapInPandas(released(right), "v long, tokens binary")


def _bounded(frames: Iterator[pd.DataFrame], num: int, den: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (p, part, member), bitmaps for sets: the least distance from the pivot, and whether a link is possible."""
    n_p, pivot = 0, None
    for frame in frames:
        out = []
        for p, member, x, n, bits in zip(frame["p"], frame["member"], frame["x"], frame["n"], frame["bits"], strict=True):
            b = np.frombuffer(bits, np.uint8)
            if not member:
                n_p, pivot = n, b
            else:
                apart, both = max(int(differing(pivot, b)), abs(n_p - n)), n_p + n
                out.append((p, x, 2 * apart / (both + apart), den * (both - apart) >= num * (both + apart)))
        yield pd.DataFrame(out, columns=["p", "x", "far", "maybe"])


def _with_pivot(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (p, part, member): the pivot's set first, then members; one set is held."""
    pivot = None
    for frame in frames:
        out = []
        for p, member, x, tokens in zip(frame["p"], frame["member"], frame["x"], frame["tokens"], strict=True):
            s = np.frombuffer(tokens, np.uint64)
            if not member:
                pivot = s
            else:
                out.append((p, x, len(pivot), len(s), len(np.intersect1d(pivot, s, assume_unique=True))))
        yield pd.DataFrame(out, columns=["p", "x", "n_p", "n_x", "shared"])


class Forest:
    """Union-find over what one block links."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def partners(n: np.ndarray, bits: list[np.ndarray], m: np.ndarray, other: list[np.ndarray], same: bool, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sets of two blocks may be linked with some set of the other, by size and bitmap."""
    left, right = np.zeros(len(n), bool), np.zeros(len(m), bool)
    widths, by = np.array([len(b) for b in other]), {}
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        by[w] = rows, np.stack([other[i] for i in rows])
    for i, b in enumerate(bits):
        for w, (rows, stack) in by.items():
            if not len(b) // 2 <= w <= 2 * len(b) and num * 2 >= den:  # sizes more than twice apart
                continue
            apart = np.maximum(differing(np.broadcast_to(b, (1, len(b))), stack), np.abs(m[rows] - n[i]))
            both = m[rows] + n[i]
            hit = den * (both - apart) >= num * (both + apart)
            if same:
                hit &= rows != i
            left[i] |= hit.any()
            right[rows[hit]] = True
    return left, right


def _candidates(frames: Iterator[pd.DataFrame], num: int, den: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by block pair, bitmaps for sets: the members of both blocks that may have a link across; up to 2 * BLOCK are held."""
    key, sides, alone = None, ([], []), False

    def close() -> pd.DataFrame:
        held, passing = sides
        if alone:
            passing = held
        if not held or not passing:
            return pd.DataFrame({"pair": [], "alone": [], "streamed": [], "x": []}).astype({"pair": "int64", "alone": bool, "streamed": bool, "x": "int64"})
        n, m = (np.array([r[1] for r in side], np.int64) for side in (held, passing))
        left, right = partners(n, [r[2] for r in held], m, [r[2] for r in passing], alone, num, den)
        rows = [(key, alone, False, held[i][0]) for i in np.flatnonzero(left)]
        rows += [] if alone else [(key, alone, True, passing[i][0]) for i in np.flatnonzero(right)]
        return pd.DataFrame(rows, columns=["pair", "alone", "streamed", "x"])

    for frame in frames:
        for k, own, streamed, x, n, bits in zip(frame["pair"], frame["alone"], frame["streamed"], frame["x"], frame["n"], frame["bits"], strict=True):
            if k != key:
                yield close()
                key, sides, alone = k, ([], []), own
            sides[streamed].append((x, n, np.frombuffer(bits, np.uint8)))
    yield close()


class Block:
    """Up to BLOCK sets, with an index of their tokens."""

    def __init__(self) -> None:
        self.names: list[int] = []
        self.sets: list[np.ndarray] = []
        self.index: tuple | None = None

    def linked(self, s: np.ndarray, num: int, den: int) -> np.ndarray:
        """Places of the held sets that are linked with s."""
        if self.index is None:
            flat = np.concatenate(self.sets)
            order = np.argsort(flat, kind="stable")
            sizes = np.array([len(t) for t in self.sets])
            self.index = flat[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes
        tokens, owners, sizes = self.index
        low = np.searchsorted(tokens, s)
        n = np.searchsorted(tokens, s, "right") - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(owners[at], minlength=len(sizes))
        return np.flatnonzero(den * shared >= num * (sizes + len(s) - shared))


def _blocks(frames: Iterator[pd.DataFrame], num: int, den: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (block pair, streamed): a block is held and the other passes by, or the held is compared with itself.

    Gives a spanning forest of the links, never more edges than sets.
    """
    key, alone, block, forest = None, False, Block(), Forest()
    out: list[tuple] = []

    def meet(x: int, s: np.ndarray) -> None:
        out.extend((block.names[j], x) for j in block.linked(s, num, den) if block.names[j] != x and forest.join(block.names[j], x))

    def close() -> None:
        for x, s in zip(block.names, block.sets, strict=True) if alone else ():
            meet(x, s)

    for frame in frames:
        for k, own, streamed, x, tokens in zip(frame["pair"], frame["alone"], frame["streamed"], frame["x"], frame["tokens"], strict=True):
            s = np.frombuffer(tokens, np.uint64)
            if k != key:
                close()
                key, alone, block, forest = k, own, Block(), Forest()
            if streamed:
                meet(x, s)
            else:
                block.names.append(x)
                block.sets.append(s)
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        out.clear()
    close()
    yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _beside_pivot(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Rows (p, member, x, values...) sorted so that a pivot comes before its members; ``values`` has x and is joined to both.

    A large group is dealt over several tasks, each with the pivot's row.
    """
    parts = pairs.groupBy("p").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts"))
    members = pairs.join(parts, "p").select("p", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("member"), "x")
    pivots = parts.select("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), F.col("p").alias("x"))
    rows = members.unionByName(pivots).join(values, "x")
    return rows.repartition("p", "part").sortWithinPartitions("p", "part", "member", "x")


def _links(pairs: DataFrame, bits: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """(a, b): enough links between the members of every pivot's group to connect what is connected.

    ``bits`` has (x, n, bits) of every vertex, ``sets_of`` gives (x, tokens) of the vertices (v) asked for.
    """
    bounds = written(_beside_pivot(pairs, bits).select("p", "member", "x", "n", "bits").mapInPandas(released(lambda f: _bounded(f, num, den)), "p long, x long, far double, maybe boolean"))
    maybe = bounds.filter("maybe").select("p", "x")
    near = maybe.select(F.col("p").alias("v")).unionByName(maybe.select(F.col("x").alias("v"))).distinct()
    exact = _beside_pivot(maybe, sets_of(near)).select("p", "member", "x", "tokens").mapInPandas(released(_with_pivot), "p long, x long, n_p long, n_x long, shared long")
    union = F.col("n_p") + F.col("n_x") - F.col("shared")
    exact = exact.select("p", "x", (1 - F.col("shared") / union).alias("exact"), (den * F.col("shared") >= num * union).alias("linked"))
    compared = bounds.join(exact, ["p", "x"], "left").select("p", "x", F.coalesce("exact", "far").alias("far"), F.coalesce("exact", F.lit(1.0)).alias("most"), F.coalesce("linked", F.lit(False)).alias("linked"))
    compared = written(compared)
    star = compared.filter("linked").select(F.col("p").alias("a"), F.col("x").alias("b"))
    # The rest: members not linked to their pivot, against each other and against those linked, at a like distance from it.
    place = Window.partitionBy("p", "linked").orderBy("far", "x")
    open_ = compared.join(compared.filter("not linked").select("p").distinct(), "p", "left_semi")
    blocks = open_.withColumn("block", F.floor((F.row_number().over(place) - 1) / BLOCK)).select("p", "x", "far", "most", "linked", "block")
    spans = blocks.groupBy("p", "linked", "block").agg(F.min("far").alias("low"), F.max("most").alias("high"), F.count("*").alias("size"))
    reach = (den - num) / den + 1e-9
    h, s = spans.filter("not linked").alias("h"), spans.alias("s")
    alike = (F.col("s.low") <= F.col("h.high") + reach) & (F.col("h.low") <= F.col("s.high") + reach)
    once = F.col("s.linked") | (F.col("s.block") >= F.col("h.block"))
    alone = ~F.col("s.linked") & (F.col("s.block") == F.col("h.block"))
    near = h.join(s, (F.col("h.p") == F.col("s.p")) & alike & once).filter(~alone | (F.col("h.size") > 1))
    names = [F.col("h.p").alias("p"), F.col("h.block").alias("h"), F.col("s.linked").alias("linked"), F.col("s.block").alias("s"), alone.alias("alone")]
    near = cut(near.select(*names, F.xxhash64(F.col("h.p"), F.col("h.block"), F.col("s.linked"), F.col("s.block")).alias("pair")))
    left = blocks.filter("not linked").withColumnRenamed("block", "h").drop("linked").join(near, ["p", "h"]).select("pair", "alone", F.lit(False).alias("streamed"), "x")
    right = blocks.withColumnRenamed("block", "s").join(near.filter("not alone"), ["p", "linked", "s"]).select("pair", "alone", F.lit(True).alias("streamed"), "x")
    order = ["pair", "alone", "streamed", "x"]
    across = left.unionByName(right).join(bits, "x").repartition("pair").sortWithinPartitions("pair", "streamed", "x").select(*order, "n", "bits")
    open_ = written(across.mapInPandas(released(lambda f: _candidates(f, num, den)), "pair long, alone boolean, streamed boolean, x long"))
    both = open_.join(sets_of(open_.select(F.col("x").alias("v")).distinct()), "x").repartition("pair").sortWithinPartitions("pair", "streamed", "x")
    found = both.select(*order, "tokens").mapInPandas(released(lambda f: _blocks(f, num, den)), "a long, b long")
    return star.unionByName(found)


def _groups(keys: DataFrame, num: int, den: int) -> DataFrame:
    """(p, x): pivots and the sets to be compared with them.

    Sets under a key are sorted by size; where the next is larger by more than the similarity allows,
    no link crosses, and the group is split.  Most keys have one set and end here.
    """
    by_size = Window.partitionBy("key").orderBy("size", "v")
    fits_last = F.coalesce(F.lag("size").over(by_size) * den >= F.col("size") * num, F.lit(False))
    fits_next = F.coalesce(F.col("size") * den >= F.lead("size").over(by_size) * num, F.lit(False))
    split = keys.withColumn("fits_last", fits_last).withColumn("fits_next", fits_next)
    split = split.withColumn("part", F.sum((~F.col("fits_last")).cast("int")).over(by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    several = split.filter("fits_last or fits_next").select("key", "part", "v", "central")
    first = Window.partitionBy("key", "part").orderBy(F.desc("central"), "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return several.withColumn("p", F.first("v").over(first)).filter("p != v").select("p", F.col("v").alias("x")).distinct()


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by den * |intersection| >= num * |union| of their n-word shingle sets.

    Result, a row per input row: id, n_shingles (size of its set) and component_id (the smallest id
    reachable by links, its own included).  Null, empty and blank texts have an empty set and are
    linked with nothing; a text of fewer than n words is one shingle; equal sets are linked whatever
    their ids; rows that repeat an id are vertices of their own and meet in the component of their
    text; a null id is never a component's name unless all its members' are null; an empty table
    gives no rows; other columns aren't read.
    """
    found = _joined(docs, n, num, den, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _joined(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, n, root, component_id) of each row; ``row`` is its text's hash, ``root`` names the component (null without words)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), text_print(F.col(text_col).cast("string")).alias("row"))
    scanned = written(_scanned(rows, n))
    sets_of = scanned.filter("kind = 0").select("id", "row", "n", F.col("print").alias("v"))
    sketch = _sketch(scanned.filter("kind = 1"))
    keys = _keys(rows, n, num, den, sketch)
    pairs = written(_groups(keys, num, den))
    least = sets_of.filter("v is not null").groupBy("v").agg(F.min("id").alias("id"))

    def tokens(needed: DataFrame) -> DataFrame:
        return written(_sets(rows, least.dropna().join(needed, "v", "left_semi"), n)).withColumnRenamed("v", "x")

    used = pairs.select(F.col("p").alias("v")).unionByName(pairs.select(F.col("x").alias("v"))).distinct()
    bits = scanned.filter("kind = 0").select(F.col("print").alias("v"), "n", "bits").join(used, "v", "left_semi").dropDuplicates(["v"])
    links = written(_links(pairs, written(bits.withColumnRenamed("v", "x")), tokens, num, den))
    roots = components(links)
    named = least.withColumnRenamed("id", "least")
    rooted = named.join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("root"), "least")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = sized(rooted.join(names, "root").select("v", "root", "component_id"))
    return sets_of.join(by_set, "v", "left").select("id", "row", "n", "root", "component_id")


def keep_first(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of texts, the row with the smallest id; all columns stay.

    Different texts of one id are judged each on its own; where several of a component have its smallest
    id, the one of least hash stays.  Rows that repeat an id and its text are one document: one of them
    stays.  Rows without an id or without words stay; any column names will do; an empty table gives
    none.
    """
    found = written(_joined(docs, n, num, den, id_col, text_col).filter("id is not null and n > 0").select("id", "row", "root"))
    first = found.groupBy("root").agg(F.min(F.struct("id", "row")).alias("first"))
    later = found.join(first, "root").filter(F.struct("id", "row") != F.col("first")).select("id", "row").distinct()
    key, mark, place = fresh(docs, "later_id", "later_row", "place")
    named = [F.col("id").alias(key), F.col("row").alias(mark)]
    text_row = text_print(F.col(text_col).cast("string"))
    same = (F.col(id_col).cast("long") == F.col(key)) & (text_row == F.col(mark))
    kept = docs.join(sized(later.select(*named)), same, "left_anti")
    again = sized(found.groupBy("id", "row").agg(F.count("*").alias("c")).filter("c > 1").select(*named))
    if again.isEmpty():
        return kept
    order = Window.partitionBy(F.col(id_col), text_row).orderBy(F.lit(0))
    one = kept.join(again, same, "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
    return kept.join(again, same, "left_anti").unionByName(one)
