"""Lineage: a tamper-evident hash chain of conversion steps."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def root_hash(timestamp: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.lit("ROOT_"), timestamp.cast("string"), F.lit("_"), path), 256)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by model and order to chain hashes; only the last model's last hash is held."""
    model, last, begun = None, None, False
    for batch in batches:
        hashes = []
        for m, root, own in zip(*(batch.column(c).to_pylist() for c in ("model_id", "root_hash", "content_hash")), strict=True):
            if not begun or m != model:
                model, last, begun = m, root, True
            last = None if last is None or own is None else sha256((last + own).encode()).hexdigest()
            hashes.append(last)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("model_id", "seq", "content_hash")), pa.array(hashes, pa.string())], ["model_id", "seq", "content_hash", "chain_hash"])


def append(entries: DataFrame, root: Column, content: Column) -> DataFrame:
    """Entries (model_id, seq, ...) with content_hash, chain_hash: each link hashes the one before with the content.

    A chain is a fold in order: a model's hashes (not its entries) are sorted and streamed through one
    task, whatever their number.  The chain starts from the first entry's root; from an entry without
    content on it is null.  Entries without a model or place have no link and are left out.
    """
    hashed = entries.withColumn("content_hash", F.sha2(content, 256)).withColumn("root_hash", root)
    narrow = hashed.select("model_id", "seq", "content_hash", "root_hash").filter(F.col("model_id").isNotNull() & F.col("seq").isNotNull())
    ordered = narrow.repartition("model_id").sortWithinPartitions("model_id", "seq", "content_hash")
    kinds = StructType([*(narrow.schema[c] for c in ("model_id", "seq", "content_hash")), StructField("chain_hash", StringType())])
    links = ordered.mapInArrow(_linked, kinds).toDF("_model", "_seq", "_content", "chain_hash")
    same = (F.col("model_id") == F.col("_model")) & (F.col("seq") == F.col("_seq")) & F.col("content_hash").eqNullSafe(F.col("_content"))
    return hashed.join(links, same).drop("_model", "_seq", "_content")


def verify(chain: DataFrame, content: Column) -> DataFrame:
    """(model_id, valid, n): whether every content and every link can be recomputed; one window by model."""
    before = F.coalesce(F.lag("chain_hash").over(Window.partitionBy("model_id").orderBy("seq")), F.col("root_hash"))
    ok = (F.sha2(content, 256) == F.col("content_hash")) & (F.sha2(F.concat(before, F.col("content_hash")), 256) == F.col("chain_hash"))
    return chain.withColumn("_ok", ok).groupBy("model_id").agg(F.bool_and("_ok").alias("valid"), F.count("*").alias("n"))
