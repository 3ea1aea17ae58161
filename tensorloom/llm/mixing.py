"""Operator 7: mixing sources to target weights by entropy balancing.

Each document gets a rate r in (0, cap): the expected number of its copies.  Among all rates whose
words add up to their source's target, the operator takes those of least entropy distance from the
base rate cap/2, with an entropy term for what is taken (r) and for what is left (cap - r); these
rates are exponentially tilted, ``r = cap / (1 + exp(-lambda_s * size / scale_s))``.  The convex
dual in lambda is solved by Newton's method: each iteration is one Spark aggregation of gradient and
curvature per source.  The work table is not the documents but the count of documents per (source,
size), so a source with a third of all rows is pre-aggregated before anything moves.  Rates are then
rounded to whole copies, with the error carried along in blocks of a few thousand documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, released, sized, text_print

#: Documents rounded together, on average.
BLOCK = 4096
NEWTON_STEPS = 60
TOLERANCE = 1e-6


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) of (source, source_size) rows.

    Sources in code-point order, null last, have the weights in turn; ``share`` of all sizes is
    dealt by weight; no target passes ``cap`` times its source's size, and what is over is dealt
    again by weight among the rest until none is above.  That fixpoint is a water level: with
    sources ordered by cap*size/weight, a prefix is full and the rest share what is left.  Exact
    and one window pass; empty input gives no rows.
    """
    # The total order of sources has one row per source, never one per document.
    ordered = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    level = ordered.withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(cap)).withColumn("level", F.col("limit") / F.col("weight"))
    before = Window.orderBy("level", "place").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("level", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (
        level.withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(after))
        .withColumn("all", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("water", (F.col("all") - F.col("used")) / F.col("left"))
        .withColumn("full", F.col("water") >= F.col("level"))
    )
    # Once a source isn't full, no later one is; all that aren't share the first one's water.
    water = F.min(F.when(~F.col("full"), F.struct("level", "place", "water"))).over(every)["water"]
    return level.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(water * F.col("weight")).alias("target"))


def _exact_sum(x: Column) -> Column:
    """A sum that doesn't depend on the order of its terms, so that reruns agree."""
    return F.sum(x.cast("decimal(28,6)")).cast("double")


def tilts(histogram: DataFrame, aims: DataFrame, cap: float = 2.0) -> DataFrame:
    """(source, tilt, scale) by Newton iterations on (source, size, n) and (source, target).

    A source whose target is its ceiling gets an infinite tilt, one whose target is 0 minus
    infinity.  Iterations are safeguarded by a bracket per source, so they can't run away.
    """
    spark = histogram.sparkSession
    scale = histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    state = (
        aims.select("source", "target")
        .join(scale, aims["source"].eqNullSafe(scale["source"]))
        .select(aims["source"], "target", "scale", F.col("source_size").cast("double"))
        .withColumn("done", (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)) | (F.col("target") <= 0))
        .withColumn("tilt", F.when(~F.col("done"), 0.0).when(F.col("target") <= 0, float("-inf")).otherwise(float("inf")))
        .withColumn("low", F.lit(float("-inf")))
        .withColumn("high", F.lit(float("inf")))
    )
    state = cut(state)
    for step in range(NEWTON_STEPS):
        if state.filter(~F.col("done")).isEmpty():
            break
        open_ = state.filter(~F.col("done")).select(F.col("source").alias("s"), F.col("tilt").alias("t"), F.col("scale").alias("c"))
        z = F.col("size") / F.col("c")
        rate = F.lit(cap) / (1 + F.exp(-F.col("t") * z))
        sums = (
            histogram.join(open_, F.col("source").eqNullSafe(F.col("s")))
            .groupBy(F.col("s"))
            .agg(_exact_sum(F.col("n") * F.col("size") * rate).alias("got"), _exact_sum(F.col("n") * F.col("size") * z * rate * (1 - rate / cap)).alias("slope"))
        )
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        short = F.col("target") - F.col("got")
        low = F.when(short > 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(short > 0, F.col("high")).otherwise(F.col("tilt"))
        newton = F.col("tilt") + F.when(F.col("slope") > 0, short / F.col("slope")).otherwise(F.signum(short))
        inside = (newton > F.col("low2")) & (newton < F.col("high2"))
        middle = F.when(F.col("low2") == float("-inf"), F.col("tilt") * 2 - 1).when(F.col("high2") == float("inf"), F.col("tilt") * 2 + 1).otherwise((F.col("low2") + F.col("high2")) / 2)
        fits = F.coalesce(F.abs(short) <= TOLERANCE * F.col("target"), F.lit(True))
        moved = joined.withColumn("low2", low).withColumn("high2", high).withColumn("next", F.when(F.col("done") | fits, F.col("tilt")).when(inside, newton).otherwise(middle))
        state = cut(
            moved.select(
                "source", "target", "scale", "source_size", (F.col("done") | fits).alias("done"), F.col("next").alias("tilt"),
                F.when(F.col("done"), F.col("low")).otherwise(F.col("low2")).alias("low"), F.when(F.col("done"), F.col("high")).otherwise(F.col("high2")).alias("high"),
            )
        )
    else:
        if not state.filter(~F.col("done")).isEmpty():
            raise RuntimeError(f"a source's rates did not converge in {NEWTON_STEPS} steps")
    return state.select("source", "tilt", "scale")


def _rounded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole copies for rows sorted by block and then by falling size; only the running error is kept."""
    block, error = None, 0.0
    for frame in frames:
        out = []
        for key, size, rate in zip(frame["block"], frame["size"], frame["rate"], strict=True):
            if key != block:
                block, error = key, 0.0
            least = int(rate)
            copies = least
            if size and rate > least:
                error += (rate - least) * size
                if error >= size / 2:
                    copies, error = least + 1, error - size
            out.append(copies)
        yield frame.assign(copies=out)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """How many copies of each document a mixture takes.

    Result, one row per input row: ``id_col``, ``source``, size long, source_size long, target
    double, rate double, copies long, taken long (= copies * size).  A null source is a source of
    its own; a null or blank text has size 0, is taken 0 times as words but keeps one row with
    copies 0; repeated rows are mixed each on its own; an empty table gives no rows; other columns
    are not read.  Reruns give the same copies: ties are ordered by hash and id, nothing is random.
    """
    done = _mixed(docs, id_col, text_col, source_col, weights, share, cap)
    return done.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(id, row, source, size, source_size, target, rate, block, copies) of each row; ``row`` is its text's hash."""
    sized = docs.select(F.col(id_col).alias("id"), text_print(F.col(text_col)).alias("row"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = cut(sized)
    histogram = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    per_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("docs"))
    per_source = cut(per_source)
    aims = cut(targets(per_source.select("source", "source_size"), weights, share, cap))
    tilt = tilts(histogram, aims, cap)
    plan = (
        aims.alias("a")
        .join(tilt.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source")))
        .join(per_source.alias("p"), F.col("a.source").eqNullSafe(F.col("p.source")))
        .select(F.col("a.source").alias("s"), F.col("a.source_size"), "target", "tilt", "scale", "docs")
    )
    plan = cut(plan)
    # A source's row is joined to each (source, size) first: the documents then join on both, so no source is one hot key.
    rates = histogram.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", F.col("size").alias("z"), "source_size", "target", "docs",
        F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("tilt") == float("inf"), F.lit(float(cap))).when(F.col("tilt") == float("-inf"), F.lit(0.0)).otherwise(F.lit(cap) / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("scale")))).alias("rate"),
    )
    rated = (
        sized.alias("d")
        .join(rates.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.size") == F.col("r.z")))
        .select("d.id", "d.row", "d.source", "d.size", "source_size", "target", "rate", F.xxhash64(F.col("d.source"), F.pmod(F.xxhash64("d.id"), F.ceil(F.col("docs") / BLOCK))).alias("block"))
    )
    sorted_ = rated.repartition("block").sortWithinPartitions("block", F.desc("size"), F.xxhash64("id"), "id", "row")
    kind = sorted_.schema["id"].dataType.simpleString()
    return sorted_.mapInPandas(released(_rounded), f"id {kind}, row long, source string, size long, source_size long, target double, rate double, block long, copies long")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The documents themselves, each as often as the mixture takes it; ids and columns stay.

    Rows that share an id have each the copies that their own text and source were given; rows that
    repeat id, text and source share theirs out among themselves, so the mixture is the one solved.
    A null id or source is a value like others; documents without words are not taken; any column
    names will do; an empty table gives none.
    """
    key, mark, origin, total, rows, place = fresh(docs, "mix_id", "mix_row", "mix_source", "mix_total", "mix_rows", "mix_place")
    copies = _mixed(docs, id_col, text_col, source_col, weights, share, cap)
    copies = copies.groupBy(F.col("id").alias(key), F.col("row").alias(mark), F.col("source").alias(origin)).agg(F.sum("copies").alias(total), F.count("*").alias(rows))
    copies = sized(copies.filter(F.col(total) > 0))
    text_row, source = text_print(F.col(text_col)), F.col(source_col).cast("string")
    joined = docs.join(copies, F.col(id_col).eqNullSafe(F.col(key)) & (text_row == F.col(mark)) & source.eqNullSafe(F.col(origin)))
    own = joined.filter(F.col(rows) == 1).withColumn(place, F.col(total))
    if not copies.filter(F.col(rows) > 1).isEmpty():
        order = F.row_number().over(Window.partitionBy(id_col, text_row, source).orderBy(F.lit(0)))
        several = joined.filter(F.col(rows) > 1).withColumn(place, order)
        dealt = F.floor(F.col(total) / F.col(rows)) + (F.col(place) <= F.col(total) % F.col(rows)).cast("long")
        own = own.unionByName(several.withColumn(place, dealt))
    own = own.filter(F.col(place) > 0)
    return own.withColumn(place, F.explode(F.sequence(F.lit(1), F.col(place).cast("int")))).select(*docs.columns)
