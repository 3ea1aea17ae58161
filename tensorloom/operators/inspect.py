"""Inspection: what a model's tables say about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.dtypes import byte_size, dominant_scheme, num_elements


def summary(tensors: DataFrame) -> DataFrame:
    """Per model: tensors, parameters, billions of them, nominal bytes and the dominant quantization."""
    n = num_elements(F.col("shape"))
    agg = tensors.groupBy("model_id").agg(F.count("*").alias("tensor_count"), F.sum(n).alias("parameters"), F.sum(byte_size(F.col("shape"), F.col("dtype"))).cast("long").alias("nominal_bytes"))
    return agg.join(dominant_scheme(tensors), "model_id").withColumn("billions", F.format_string("%.2fB", F.col("parameters") / 1e9))


def first_tensors(tensors: DataFrame, n: int) -> DataFrame:
    """The first n tensors of each model in the order they were inserted."""
    w = Window.partitionBy("model_id").orderBy("ordinal")
    return tensors.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def architecture(metadata: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """Per model: each field from the first of its keys that is there; whole numbers default to 0."""
    wanted = sorted({k for keys in fields.values() for k in keys})
    wide = metadata.filter(F.col("key").isin(wanted)).groupBy("model_id").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"k{i}") for i, k in enumerate(wanted)])
    return wide.select("model_id", *[F.coalesce(*[F.col(f"k{wanted.index(k)}") for k in keys], F.lit(0)).alias(f) for f, keys in fields.items()])


def typed_get(value: Column, kind: str) -> Column:
    """A JSON value if it is of that kind, else null: no coercion between kinds."""
    v = F.try_parse_json(value)
    of = F.schema_of_variant(v)
    return F.when(of == kind, F.try_variant_get(v, "$", {"BIGINT": "bigint", "STRING": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}[kind]))


def shared_resolved(tensors: DataFrame) -> DataFrame:
    """Tensors whose storage is another tensor's (column ``target``) get its bytes; one hop. ``resolved`` is false where the target is missing."""
    owners = tensors.filter("target is null").select("model_id", F.col("name").alias("target"), F.col("bytes").alias("target_bytes"))
    joined = tensors.join(owners, ["model_id", "target"], "left")
    return joined.select("model_id", "name", "target", F.coalesce("bytes", "target_bytes").alias("bytes"), (F.col("target").isNull() | F.col("target_bytes").isNotNull()).alias("resolved"))
