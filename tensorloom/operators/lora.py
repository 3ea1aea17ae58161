"""Low-rank adapters: pairing of their two sides, and merging W + (B x A) * alpha / rank, as joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.names import adapter_layer, adapter_side, base_key


def pairs(adapters: DataFrame) -> DataFrame:
    """(model_id, layer, base, a, b): keys of adapters (model_id, seq, key) whose both sides are there; the last of a side counts."""
    sided = adapters.select("model_id", "seq", "key", adapter_layer(F.col("key")).alias("layer"), adapter_side(F.col("key")).alias("side")).filter("side is not null")
    by = sided.groupBy("model_id", "layer").agg(*[F.max_by(F.when(F.col("side") == s, F.col("key")), F.when(F.col("side") == s, F.col("seq"))).alias(s.lower()) for s in "AB"])
    return by.filter("a is not null and b is not null").select("model_id", "layer", base_key(F.col("layer")).alias("base"), "a", "b")


def merge(base: DataFrame, a: DataFrame, b: DataFrame, scale: DataFrame) -> DataFrame:
    """Merged weights, element by element: base (layer, r, c, w), a (layer, k, c, v), b (layer, r, k, v), scale (layer, alpha, rank).

    The product is one equi-join on (layer, k) and one sum per (layer, r, c), combined in tasks
    first.  A layer without an adapter keeps its weights; rank defaults to 8, alpha to the rank.
    """
    product = b.alias("b").join(a.alias("a"), ["layer", "k"]).groupBy("layer", "r", "c").agg(F.sum(F.col("b.v").cast("double") * F.col("a.v")).alias("delta"))
    rank = F.coalesce("rank", F.lit(8))
    factor = scale.select("layer", (F.coalesce("alpha", rank.cast("double")) / rank).alias("factor"))
    merged = base.join(product, ["layer", "r", "c"], "left").join(factor, "layer", "left")
    return merged.select("layer", "r", "c", (F.col("w") + F.coalesce(F.col("delta") * F.coalesce("factor", F.lit(1.0)), F.lit(0.0))).alias("w"))


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upserts: the last write of each key wins, at the place of its first."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("first_place", F.min(order).over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
