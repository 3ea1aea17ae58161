"""Validation of a conversion: structure by a table diff, numbers by an element-wise error aggregation, and certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.dtypes import num_elements


def structural(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per model: counts of tensors, of missing ones, of changed element counts and types, and whether it passed.

    Inputs have model_id, name, dtype, shape.  A missing tensor or another element count fails; a
    changed type or shape of the same size, and extra tensors, don't.
    """
    b = before.select("model_id", "name", F.col("dtype").alias("dtype_b"), num_elements(F.col("shape")).alias("n_b"))
    a = after.select("model_id", "name", F.col("dtype").alias("dtype_a"), num_elements(F.col("shape")).alias("n_a"), F.lit(True).alias("there"))
    both = b.join(a, ["model_id", "name"], "left")
    gone = F.col("there").isNull()
    diff = both.groupBy("model_id").agg(
        F.count("*").alias("tensors_before"),
        F.sum(gone.cast("long")).alias("missing"),
        F.sum(F.coalesce(F.col("n_a") != F.col("n_b"), F.lit(False)).cast("long")).alias("shape_mismatches"),
        F.sum(F.coalesce(F.col("dtype_a") != F.col("dtype_b"), F.lit(False)).cast("long")).alias("dtype_changes"),
    )
    counts = a.groupBy("model_id").agg(F.count("*").alias("tensors_after"))
    out = diff.join(counts, "model_id", "left").withColumn("tensors_after", F.coalesce("tensors_after", F.lit(0)))
    return out.withColumn("passed", (F.col("missing") == 0) & (F.col("shape_mismatches") == 0))


def numeric_threshold(source: Column, target: Column) -> Column:
    """Largest allowed difference of a pair of types, either way round."""
    pair = F.array_sort(F.array(source, target))

    def of(a: str, b: str) -> Column:
        return pair == F.array(*[F.lit(x) for x in sorted((a, b))])

    return F.when(of("F32", "F32"), 0.0).when(of("F16", "F32"), 1e-3).when(of("BF16", "F32"), 2e-2).when(of("F32", "Q4_K_M"), 1e-2).when(of("F32", "Q8_0"), 1e-3).otherwise(1e-4)


def numeric(before: DataFrame, after: DataFrame, threshold: Column | float) -> DataFrame:
    """Per tensor: elements compared, greatest and mean absolute difference, and whether the greatest is within ``threshold``.

    Inputs have model_id, name, data array<float>; only tensors of equal, non-zero length are
    compared.  Differences are taken in single, averaged in double precision; the greatest ignores
    NaN and the mean doesn't.  Arrays are reduced in place: no element becomes a row.
    """
    b = before.select("model_id", "name", F.col("data").alias("x"))
    both = b.join(after.select("model_id", "name", F.col("data").alias("y")), ["model_id", "name"]).filter((F.size("x") == F.size("y")) & (F.size("x") > 0))
    diffs = F.zip_with("x", "y", lambda p, q: F.abs(p.cast("float") - q.cast("float")))
    d = both.select("model_id", "name", diffs.alias("d"))
    worst = F.array_max(F.transform(F.filter("d", lambda v: ~F.isnan(v)), lambda v: v.cast("double")))
    d = d.select("model_id", "name", F.size("d").cast("long").alias("n"), F.coalesce(worst, F.lit(0.0)).alias("max_abs"), (F.aggregate("d", F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size("d")).alias("mean_abs"))
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return d.withColumn("passed", F.col("max_abs") <= limit)


def numeric_report(tensors: DataFrame) -> DataFrame:
    """Per model: the greatest difference, the mean of the tensors' means, and whether all passed."""
    return tensors.groupBy("model_id").agg(F.count("*").alias("tensors"), F.max("max_abs").alias("max_abs"), F.avg("mean_abs").alias("mean_abs"), F.bool_and("passed").alias("passed"))


def certificates(structure: DataFrame, numbers: DataFrame, issuer: str = "self-certified") -> DataFrame:
    """A signed row for each model that passed its structure and didn't fail its numbers; others have none."""
    both = structure.join(numbers.select("model_id", F.col("passed").alias("numeric_passed")), "model_id", "left").filter("passed and coalesce(numeric_passed, true)")
    body = F.concat_ws("|", F.col("model_id").cast("string"), F.col("tensors_before").cast("string"), F.col("dtype_changes").cast("string"), F.coalesce(F.col("numeric_passed").cast("string"), F.lit("none")))
    hash_ = F.sha2(body, 256)
    guarantees = F.when(F.col("numeric_passed").isNull(), 1).otherwise(2)
    return both.select("model_id", guarantees.alias("guarantees"), hash_.alias("body_hash"), F.concat(F.lit(f"{issuer}:"), F.left(hash_, F.lit(16))).alias("signature"))
