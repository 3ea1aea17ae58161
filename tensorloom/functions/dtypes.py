"""Element types, their sizes, and what may be converted to what."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Nominal bytes per element, and whether the type is quantized.
DTYPES: dict[str, tuple[float, bool]] = {
    "F64": (8.0, False), "F32": (4.0, False), "F16": (2.0, False), "BF16": (2.0, False), "F8E4M3": (1.0, False), "F8E5M2": (1.0, False),
    "I64": (8.0, False), "I32": (4.0, False), "I16": (2.0, False), "I8": (1.0, False),
    "U64": (8.0, False), "U32": (4.0, False), "U16": (2.0, False), "U8": (1.0, False), "Bool": (1.0, False),
    "Q8_0": (1.0, True), "Q8_K": (1.0, True), "AWQ_8": (1.0, True), "GPTQ_8": (1.0, True),
    "Q4_0": (0.5, True), "Q4_1": (0.5, True), "Q4_K_S": (0.5, True), "Q4_K_M": (0.5, True), "NF4": (0.5, True), "FP4": (0.5, True), "AWQ_4": (0.5, True), "GPTQ_4": (0.5, True),
    "Q5_0": (0.625, True), "Q5_1": (0.625, True), "Q5_K_S": (0.625, True), "Q5_K_M": (0.625, True), "Q6_K": (0.75, True),
    "Q2_K": (0.25, True), "GPTQ_2": (0.25, True), "Q3_K_S": (0.375, True), "Q3_K_M": (0.375, True), "Q3_K_L": (0.375, True), "GPTQ_3": (0.375, True),
}

# GGML type id -> (type, elements per block, bytes per block).
GGML: dict[int, tuple[str, int, int]] = {
    0: ("F32", 1, 4), 1: ("F16", 1, 2), 2: ("Q4_0", 32, 18), 3: ("Q4_1", 32, 20), 6: ("Q5_0", 32, 22), 7: ("Q5_1", 32, 24), 8: ("Q8_0", 32, 34), 9: ("Q8_0", 32, 36),
    10: ("Q2_K", 256, 84), 11: ("Q3_K_S", 256, 110), 12: ("Q3_K_M", 256, 110), 13: ("Q3_K_L", 256, 110), 14: ("Q4_K_S", 256, 144), 15: ("Q4_K_M", 256, 144),
    16: ("Q5_K_S", 256, 176), 17: ("Q5_K_M", 256, 176), 18: ("Q6_K", 256, 210), 19: ("Q8_K", 256, 292), 20: ("IQ2_XXS", 256, 66), 21: ("IQ2_XS", 256, 74),
    22: ("IQ3_XXS", 256, 98), 23: ("IQ1_S", 256, 50), 24: ("IQ4_NL", 32, 18), 25: ("IQ3_S", 256, 98), 26: ("IQ2_S", 256, 82), 27: ("IQ4_XS", 256, 136),
    28: ("I8", 1, 1), 29: ("I16", 1, 2), 30: ("I32", 1, 4), 31: ("I64", 1, 8), 32: ("F64", 1, 8), 33: ("IQ1_M", 256, 56), 34: ("BF16", 1, 2),
}

#: Types named in SafeTensors headers; any other name is a custom type.
SAFETENSORS = {"F64": "F64", "F32": "F32", "F16": "F16", "BF16": "BF16", "F8_E4M3": "F8E4M3", "F8_E5M2": "F8E5M2", "I64": "I64", "I32": "I32", "I16": "I16", "I8": "I8", "U64": "U64", "U32": "U32", "U16": "U16", "U8": "U8", "BOOL": "Bool"}


def _lookup(key: Column, values: dict, kind: str) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])
    return F.try_element_at(table, key).cast(kind)


def num_elements(shape: Column) -> Column:
    """Product of the dimensions; 1 for a scalar."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, d: a * d)


def bytes_per_element(dtype: Column) -> Column:
    return _lookup(dtype, {k: v[0] for k, v in DTYPES.items()}, "double")


def is_quantized(dtype: Column) -> Column:
    return F.coalesce(_lookup(dtype, {k: v[1] for k, v in DTYPES.items()}, "boolean"), F.lit(False))


def byte_size(shape: Column, dtype: Column) -> Column:
    """Nominal size, rounded up; null for a custom type."""
    return F.ceil(num_elements(shape) * bytes_per_element(dtype))


def from_safetensors(name: Column) -> Column:
    return F.coalesce(_lookup(name, SAFETENSORS, "string"), F.concat(F.lit("Custom:"), name))


def to_safetensors(dtype: Column) -> Column:
    """Header name, or null where a type must be decoded to F32 first."""
    return _lookup(dtype, {v: k for k, v in SAFETENSORS.items()}, "string")


def ggml_row_size(type_id: Column, n: Column) -> Column:
    """Bytes of n elements in blocks; null if n isn't a whole number of blocks or the type is unknown."""
    elements = _lookup(type_id, {k: v[1] for k, v in GGML.items()}, "long")
    size = _lookup(type_id, {k: v[2] for k, v in GGML.items()}, "long")
    return F.when(n % elements == 0, F.floor(n / elements) * size)


def ggml_dtype(type_id: Column) -> Column:
    return _lookup(type_id, {k: v[0] for k, v in GGML.items()}, "string")


def lossless_upcast(source: Column, target: Column) -> Column:
    """Whether every value of the source type is one of the target type: same type, or a wider one of its kind."""
    rank = {"Float": {"F16": 1, "BF16": 1, "F32": 2, "F64": 3}, "I": {"I8": 1, "I16": 2, "I32": 3, "I64": 4}, "U": {"U8": 1, "U16": 2, "U32": 3, "U64": 4}}
    wider = [_lookup(source, r, "int") < _lookup(target, r, "int") for r in rank.values()]
    return (source == target) | F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), wider), F.lit(False))


# Bits of a quantization scheme; 0 where the scheme doesn't say.
BIT_WIDTH = {"Q4_0": 4, "Q4_1": 4, "Q5_0": 5, "Q5_1": 5, "Q8_0": 8, "Q2_K": 2, "Q3_K_S": 3, "Q3_K_M": 3, "Q3_K_L": 3, "Q4_K_S": 4, "Q4_K_M": 4, "Q5_K_S": 5, "Q5_K_M": 5, "Q6_K": 6, "Q8_K": 8, "AWQ_4": 4, "GPTQ_4": 4, "NF4": 4, "FP4": 4}


def bit_width(scheme: Column) -> Column:
    return F.coalesce(_lookup(scheme, BIT_WIDTH, "int"), F.lit(0))


def requantization(scheme: Column) -> Column:
    return F.when(scheme.startswith("AWQ") | scheme.startswith("GPTQ"), "RequiresCalibration").when(scheme.isin("NF4", "FP4"), "Unsupported").otherwise("Supported")


def dominant_scheme(tensors: DataFrame) -> DataFrame:
    """(model_id, scheme): the quantized type of more than half of a model's tensors, in a fixed order of preference; else null."""
    groups = [("Q4_K_M", ["Q4_K_M"]), ("Q4_K_S", ["Q4_K_S"]), ("Q5_K_M", ["Q5_K_M"]), ("Q8_0", ["Q8_0", "Q8_K"])]
    counts = tensors.groupBy("model_id").agg(F.count("*").alias("n"), *[F.sum(F.col("dtype").isin(of).cast("long")).alias(f"n_{name}") for name, of in groups])
    scheme = F.coalesce(*[F.when(F.col(f"n_{name}") * 2 > F.col("n"), F.lit(name)) for name, _ in groups])
    return counts.select("model_id", scheme.alias("scheme"))


def dtype_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in DTYPES.items()], "dtype string, bytes_per_element double, quantized boolean")
