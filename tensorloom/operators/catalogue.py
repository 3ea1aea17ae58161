"""The catalogue of formats, the architectures known by name, and what a loader tells from a file's name and head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Slug, name, readable, writable, without external tools, extensions, description.
FORMATS = [
    ("gguf", "GGUF", True, True, True, ["gguf"], "Quantized weights of llama.cpp"),
    ("safetensors", "SafeTensors", True, True, True, ["safetensors"], "Tensors without code"),
    ("onnx", "ONNX", True, True, True, ["onnx"], "Open Neural Network Exchange"),
    ("pytorch", "PyTorch", True, True, True, ["pt", "pth", "bin"], "PyTorch checkpoint"),
    ("awq", "AWQ", True, True, True, ["safetensors"], "Activation-aware quantization"),
    ("gptq", "GPTQ", True, True, True, ["safetensors"], "Post-training quantization"),
    ("tflite", "TFLite", True, True, True, ["tflite"], "TensorFlow Lite flat buffer"),
    ("coreml", "CoreML", False, True, False, ["mlpackage", "mlmodel"], "Settings for Core ML"),
    ("tensorrt", "TensorRT", False, True, False, ["engine"], "Settings for a TensorRT engine"),
    ("openvino", "OpenVINO", False, True, False, ["xml"], "OpenVINO intermediate representation"),
    ("executorch", "ExecuTorch", False, True, False, ["pte"], "On-device programs"),
    ("lora", "LoRA Adapter", True, False, True, ["safetensors", "bin"], "Low-rank adapters"),
]

# Architectures known by name.
ARCHITECTURES = ["llama", "mistral", "phi", "phi2", "gemma", "qwen", "qwen2", "falcon", "gpt2", "bloom", "mpt", "stablelm", "phi3", "starcoder2", "deepseek", "deepseek2", "command-r"]


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "slug string, name string, can_read boolean, can_write boolean, native boolean, extensions array<string>, description string")


def known_architecture(name: Column) -> Column:
    return F.coalesce(name.isin(*ARCHITECTURES), F.lit(False))


def tokenizer(metadata: DataFrame) -> DataFrame:
    """(model_id, type, chat_template, bos_token, eos_token) of models whose tokenizer model is a string.

    ``metadata`` has model_id, key, kind (STRING, BIGINT, ...) and value as text; ids of another kind are null.
    """

    def of(key: str, kind: str) -> Column:
        return F.max(F.when((F.col("key") == key) & (F.col("kind") == kind), F.col("value")))

    wide = metadata.groupBy("model_id").agg(
        of("tokenizer.ggml.model", "STRING").alias("model"),
        of("tokenizer.chat_template", "STRING").alias("chat_template"),
        of("tokenizer.ggml.bos_token_id", "BIGINT").alias("bos_token"),
        of("tokenizer.ggml.eos_token_id", "BIGINT").alias("eos_token"),
    )
    return wide.filter("model is not null").select("model_id", F.lit("BPE").alias("type"), "chat_template", "bos_token", "eos_token")
