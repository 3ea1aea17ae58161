"""What the JSON files beside a model's weights say about its quantization or adapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(json: Column, *paths: str) -> Column:
    """The first of several places that is there, as text."""
    return F.coalesce(*[F.get_json_object(json, p) for p in paths])


def awq(models: DataFrame, json: str = "config") -> DataFrame:
    """Bits and group size; 4 and 128 where nothing is said."""
    c = F.col(json)
    return models.withColumns({"scheme": F.lit("AwqGemm4"), "bits": F.coalesce(first_of(c, "$.w_bit", "$.bits").try_cast("long"), F.lit(4)), "group_size": F.coalesce(first_of(c, "$.q_group_size", "$.group_size").try_cast("long"), F.lit(128))})


def gptq(models: DataFrame, json: str = "config") -> DataFrame:
    c = F.col(json)
    bits = F.coalesce(first_of(c, "$.quantization_config.bits").try_cast("long"), F.lit(4))
    return models.withColumns({"scheme": F.concat(F.lit("Gptq"), bits.cast("string")), "bits": bits, "group_size": F.coalesce(first_of(c, "$.quantization_config.group_size").try_cast("long"), F.lit(128))})


def lora(models: DataFrame, json: str = "config") -> DataFrame:
    """Rank (8 if nothing is said), alpha (the rank), target modules and kind of an adapter."""
    c = F.col(json)
    rank = F.coalesce(first_of(c, "$.r", "$.rank").try_cast("long"), F.lit(8))
    return models.withColumns(
        {
            "rank": rank,
            "alpha": F.coalesce(first_of(c, "$.lora_alpha").try_cast("double"), rank.cast("double")),
            "target_modules": F.coalesce(F.from_json(F.get_json_object(c, "$.target_modules"), "array<string>"), F.array().cast("array<string>")),
            "adapter_type": F.coalesce(first_of(c, "$.peft_type"), F.lit("LORA")),
        }
    )
