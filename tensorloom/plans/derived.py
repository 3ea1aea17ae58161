"""Model, file and job tables derived from the given ones by Spark; each grows with its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.operators.routes import EDGES
from tensorloom.sources import gguf, onnx, pytorch, tflite

NODES = sorted({n for e in EDGES for n in e[:2]})
READERS = ["GGUF", "SafeTensors", "ONNX", "PyTorch", "TFLite", "AWQ", "GPTQ"]
WRITERS = ["GGUF", "SafeTensors", "ONNX", "PyTorch", "TFLite", "AWQ", "GPTQ", "CoreML", "TensorRT", "OpenVINO", "ExecuTorch"]
EXTENSIONS = ["gguf", "bin", "tflite", "h5", "onnx", "pt", "model", "safetensors", "txt", "GGUF"]
HEADS = [b"GGUF\x03\0\0\0", b"GGML", b"\0\0\0\0TFL3", b"\x89HDF", b"\x08", b"PK\x03\x04", b"\x40" + b"\0" * 7 + b'{"a":', b"\x40" + b"\0" * 7 + b'{"qweight":1,"qzeros":2,"scales":3,', b""]
ARCHITECTURE = {"hidden_size": ["phi.view", "llama.view"], "num_layers": ["phi.error", "phi.click"], "vocab_size": ["phi.absent", "phi.purchase"], "heads": ["phi.absent"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tensor per vector, one model per label."""
    v = F.col("vec_id")
    dtype = F.when((v + F.col("label")) % 3 == 0, pick(["F16", "BF16", "Q4_0", "F32"], v % 4)).when(F.col("label") % 2 == 0, "Q4_K_M").otherwise("Q8_0")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("model_id"), v.alias("ordinal"), F.concat(F.lit("layers."), v.cast("string"), F.lit(".weight")).alias("name"), dtype.alias("dtype"), F.array(F.lit(8), F.lit(8)).cast("array<bigint>").alias("shape"), F.col("embedding").alias("data")
    )


def converted(before: DataFrame) -> DataFrame:
    """A conversion that loses some tensors, reshapes some and changes the type of others."""
    v = F.col("ordinal")
    shape = F.when(v % 7 == 0, F.array(F.lit(4), F.lit(16))).when(v % 13 == 0, F.array(F.lit(8), F.lit(4))).otherwise(F.array(F.lit(8), F.lit(8)))
    lost = (F.col("model_id") % 2 == 0) & (v % 11 == 0)
    data = F.transform("data", lambda x: (F.floor(x.cast("double") * 1024) / 1024).cast("float"))
    return before.filter(~lost).withColumns({"shape": shape.cast("array<bigint>"), "dtype": F.when(v % 5 == 0, "F16").otherwise(F.col("dtype")), "data": data})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose heads and names come from documents."""
    d = F.col("doc_id")
    head = F.concat(pick(HEADS, d % 9), F.encode(F.left(F.col("text"), F.lit(100)), "UTF-8"))
    path = F.concat(F.lit("/models/"), d.cast("string"), F.lit("."), pick(EXTENSIONS, F.floor(d / 9) % 10))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), head.alias("head"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion jobs from orders."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("queued")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"),
        pick(NODES, F.col("o_orderkey") % len(NODES)).alias("source"), pick(NODES, F.col("o_custkey") % len(NODES)).alias("target"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value metadata from events."""
    e = table(spark, sf_dir, "events")
    family = F.when(F.col("event_id") % 2 == 0, "phi.").otherwise("llama.")
    return e.select((F.col("user_id") % 200).alias("model_id"), F.concat(family, F.col("event_type")).alias("key"), F.get_json_object("props", "$.k").cast("long").alias("value"))


def adapter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    side = pick(["lora_A", "lora_B", "lora_a", "bias"], F.col("l_linenumber") % 4)
    key = F.concat(F.lit("base_model.model.layers."), (F.col("l_partkey") % 50).cast("string"), F.lit(".attn."), side, F.lit(".weight"))
    return li.select((F.col("l_suppkey") % 20).alias("model_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), key.alias("key"))


def text_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' bytes as U8 tensors, a model per source."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    name = F.concat(F.lit("doc."), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("model_id"), name.alias("name"), F.lit("U8").alias("dtype"), F.array(F.octet_length(data).cast("long")).alias("shape"), data.alias("data"))


@F.pandas_udf(T.BinaryType())
def gguf_file(name, data):
    return name.combine(data, lambda n, x: gguf.write({"general.architecture": "phi", "general.name": n}, [(n, [len(x)], "I8", bytes(x)), (n + ".again", [1, len(x)], "I8", bytes(x))]))


@F.pandas_udf(T.BinaryType())
def onnx_file(name, data):
    return name.combine(data, lambda n, x: onnx.write([(n, [len(x)], "U8", bytes(x)), (n + ".again", [1, len(x)], "I8", bytes(x))], {"source_format": "text"}))


@F.pandas_udf(T.BinaryType())
def pytorch_file(name, data):
    return name.combine(data, lambda n, x: pytorch.write([(n, [len(x)], "U8", bytes(x)), (n + ".again", [1, len(x)], "I8", bytes(x))]))


@F.pandas_udf(T.BinaryType())
def tflite_file(name, data):
    return name.combine(data, lambda n, x: tflite.write([(n, [len(x)], "U8", bytes(x)), (n + ".again", [1, len(x)], "I8", bytes(x))]))
