"""Format detection: a cascade of scored rules over a file's first bytes and name, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.binary import little_endian
from tensorloom.functions.names import extension

#: Bytes that the rules may look at.
WINDOW = 512


def _starts(data: Column, magic: bytes) -> Column:
    return F.substring(data, 1, len(magic)) == F.lit(magic)


def rules(head: Column, path: Column) -> list[tuple[str, int, Column, Column | None]]:
    """(format, priority, score, version) of each rule, in order of registration; score 0 is no match."""
    ext, text = extension(path), F.decode(head, "ISO-8859-1")
    tag = F.substring(head, 5, 4)
    header = (F.octet_length(head) >= 9) & (F.substring(head, 9, 1) == F.lit(b"{")) & little_endian(head, 0, 8).between(2, 99_999_999)
    small = header & (little_endian(head, 0, 8) < 10_000_001)
    first = F.substring(head, 1, 1)
    protobuf, zipped = first.isin(F.lit(b"\x08"), F.lit(b"\x0a")), _starts(head, b"PK\x03\x04")
    onnx, torch = ext == "onnx", ext.isin("pt", "pth", "bin")
    tflite = tag.isin(F.lit(b"TFL3"), F.lit(b"TFL2"), F.lit(b"TFL1"))
    awq = small & (text.contains('"awq"') | (text.contains("scales") & text.contains("zeros")))
    gptq = small & text.contains("qweight") & (text.contains("qzeros") | text.contains("scales"))
    lora = small & text.rlike("lora_[ABab]")
    return [
        ("GGUF", 1, F.when(_starts(head, b"GGUF"), 0.99).when(ext == "gguf", 0.70), F.when(F.octet_length(head) >= 8, F.concat(F.lit("v"), little_endian(head, 4, 4).cast("string")))),
        ("GGML", 1, F.when(_starts(head, b"GGML"), 0.99).when(ext == "bin", 0.20), None),
        ("TFLite", 1, F.when(tflite, 0.99).when(ext == "tflite", 0.75), F.when(tflite, tag.cast("string"))),
        ("KerasH5", 1, F.when(_starts(head, b"\x89HDF"), F.when(ext.isin("h5", "keras", "hdf5"), 0.99).otherwise(0.85)), None),
        ("ONNX", 2, F.when(protobuf & onnx, 0.95).when(protobuf, 0.50).when(onnx, 0.80), None),
        ("PyTorch", 2, F.when(zipped & torch, 0.90).when(zipped, 0.40).when(torch, 0.55), None),
        ("SentencePiece", 2, F.when(ext.isin("model", "spm"), 0.75), None),
        ("AWQ", 2, F.when(awq, 0.95), F.lit("AWQ-4bit")),
        ("GPTQ", 2, F.when(gptq, 0.95), F.lit("GPTQ-4bit")),
        ("LoRA", 2, F.when(lora, 0.95), None),
        ("SafeTensors", 1, F.when(header, 0.99).when(ext == "safetensors", 0.75), F.lit("1.0")),
        ("Diffusers", 3, F.when(path.endswith("/model_index.json"), 0.95), None),
    ]


def detect(files: DataFrame, path_col: str = "path", head_col: str = "head") -> DataFrame:
    """The winner of each file: format, confidence, method, version, runner_up and whether it was close.

    Highest score wins, then lowest priority, then first registered; ``ambiguous`` if the second is
    less than 0.1 behind.  A file that no rule knows has a null format.  No shuffle, no UDF.
    """
    head = F.substring(F.coalesce(F.col(head_col), F.lit(b"")), 1, WINDOW)
    scored = [
        F.when(
            F.coalesce(score, F.lit(0.0)) > 0,
            F.struct(score.cast("double").alias("confidence"), F.lit(-prio).alias("prio"), F.lit(-i).alias("order"), F.lit(name).alias("format"), (F.lit(None).cast("string") if version is None else version).alias("version")),
        )
        for i, (name, prio, score, version) in enumerate(rules(head, F.col(path_col)))
    ]
    ranked = files.withColumn("_r", F.sort_array(F.filter(F.array(*scored), lambda x: x.isNotNull()), asc=False))
    one, two = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    method = F.when(one["prio"] == -1, "MagicBytes").when(one["prio"] == -2, "HeaderStructure").when(one["prio"] == -3, "DirectoryLayout")
    return ranked.select(
        *files.columns,
        one["format"].alias("format"),
        one["confidence"].alias("confidence"),
        method.alias("method"),
        one["version"].alias("version"),
        two["format"].alias("runner_up"),
        F.coalesce(F.round(one["confidence"] - two["confidence"], 6) < 0.1, F.lit(False)).alias("ambiguous"),
    )
