"""Models as documents, and their stores of extensions and hints."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.dtypes import num_elements
from tensorloom.functions.names import extension_key_valid


def inspect_json(tensors: DataFrame, first: int | None = None) -> DataFrame:
    """(model_id, json, mib): counts and tensors of each model as one JSON document, and the bytes of its data.

    ``first`` bounds the tensors listed, in order of ``ordinal``; a document lists all where it is None.
    """
    n = num_elements(F.col("shape"))
    place = F.row_number().over(Window.partitionBy("model_id").orderBy("ordinal"))
    rows = tensors.select("model_id", "ordinal", n.alias("n"), (4 * F.size("data")).alias("bytes"), F.struct("name", "dtype", "shape", n.alias("num_elements")).alias("t"), place.alias("place"))
    listed = F.when(F.col("place") <= first, F.struct("ordinal", "t")) if first is not None else F.struct("ordinal", "t")
    agg = rows.groupBy("model_id").agg(F.count("*").alias("tensor_count"), F.sum("n").cast("long").alias("parameters"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(listed)).alias("l"))
    doc = F.to_json(F.struct("tensor_count", "parameters", F.transform("l", lambda e: e["t"]).alias("tensors")))
    return agg.select("model_id", doc.alias("json"), (F.col("bytes") / (1 << 20)).alias("mib"))


def extension_writes(writes: DataFrame, max_bytes: int) -> DataFrame:
    """(model_id, entries, total_bytes) after writes (model_id, seq, key, value) in order.

    A write under an invalid key is refused, and so is one whose value would, on top of all that is
    held, its own old value included, pass ``max_bytes``.  The version in a key doesn't tell keys apart.
    Rows are sorted by model and streamed; a task holds the sizes of one model's entries.
    """
    at = F.split("key", "[@/]", 3)
    rows = writes.filter(extension_key_valid(F.col("key"))).select("model_id", "seq", F.concat(at[0], F.lit("/"), at[2]).alias("entry"), F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("size"))
    dealt = rows.repartition("model_id").sortWithinPartitions("model_id", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, held, total, out = None, {}, 0, []
        for frame in frames:
            for m, entry, size in zip(frame["model_id"], frame["entry"], frame["size"], strict=True):
                if m != model:
                    if model is not None:
                        out.append((model, len(held), total))
                    model, held, total = m, {}, 0
                if total + size <= max_bytes:
                    total += size - held.get(entry, 0)
                    held[entry] = size
            yield pd.DataFrame(out, columns=["model_id", "entries", "total_bytes"])
            out = []
        if model is not None:
            yield pd.DataFrame([(model, len(held), total)], columns=["model_id", "entries", "total_bytes"])

    return dealt.mapInPandas(run, "model_id long, entries int, total_bytes long")


def hints(requests: DataFrame, table: DataFrame) -> DataFrame:
    """Conversions (source, target, ...) with their hints, null where there are none."""
    return requests.join(table, ["source", "target"], "left")
