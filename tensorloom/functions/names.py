"""Names of files, tensors and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty if there is none. Case matters."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def sanitized(name: Column) -> Column:
    """Only letters, digits, dot, dash and underscore, at most 128 of them."""
    return F.left(F.regexp_replace(name, r"[^\p{L}\p{N}._-]", ""), F.lit(128))


def target_format(path: Column) -> Column:
    """The format that a file's extension asks for; null if none."""
    by = {"gguf": "GGUF", "safetensors": "SafeTensors", "pt": "PyTorch", "pth": "PyTorch", "bin": "PyTorch", "onnx": "ONNX", "tflite": "TFLite", "mlpackage": "CoreML", "engine": "TensorRT", "h5": "KerasH5"}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in by.items() for x in kv]), extension(path))


def adapter_side(key: Column) -> Column:
    """A or B of a low-rank adapter's tensor; null otherwise."""
    return F.when(key.rlike(r"\.lora_[Aa]"), "A").when(key.rlike(r"\.lora_[Bb]"), "B")


def adapter_layer(key: Column) -> Column:
    return F.regexp_extract(key, r"^(.*?)\.lora_[AaBb]", 1)


def base_key(layer: Column) -> Column:
    """The base model's tensor that an adapter layer belongs to."""
    short = F.regexp_replace(layer, r"^base_model\.model\.", "")
    return F.when(short.rlike(r"\.(weight|bias)$"), short).otherwise(F.concat(short, F.lit(".weight")))


def extension_key_valid(key: Column) -> Column:
    """format@version/path: at most 512 characters of letters, digits and @ . _ - /, an @ before the first /."""
    at, slash = F.instr(key, "@"), F.instr(key, "/")
    return (F.length(key) <= 512) & key.rlike(r"^[\p{L}\p{N}@/._-]*$") & (at > 0) & (slash > at)


def layer_number(name: Column) -> Column:
    """First dotted part that is a whole number; null if none."""
    return F.try_element_at(F.filter(F.split(name, r"\."), lambda p: p.rlike(r"^\d+$")), F.lit(1)).try_cast("long")


def round_up(n: Column, to: int) -> Column:
    """Next multiple of ``to``, in whole numbers throughout."""
    return n + F.pmod(-n, F.lit(to))


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def slug(name: Column) -> Column:
    """Lower-case letters and digits, with one dash for all between."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-|-$", "")
