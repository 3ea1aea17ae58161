"""SafeTensors files as tables of tensors: headers are read with column expressions, bytes are cut and files
written in one pass over Arrow batches.

A file is ``u64 length of header, JSON header, data``; the header maps a tensor's name to its type,
shape and byte range.  Files are read as (path, content) rows, as Spark's ``binaryFile`` gives them.
Writing deals a model's tensors to shards of bounded size, as large models are published, so that no
row holds more than a shard.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tensorloom.functions.binary import little_endian
from tensorloom.functions.dtypes import from_safetensors, to_safetensors
from tensorloom.shared import BATCH_BYTES, bounded_batches

HEADER = "map<string, struct<dtype: string, shape: array<bigint>, data_offsets: array<bigint>>>"
SHARD_BYTES = 256 << 20
#: Models of more bytes are dealt over several tasks by hash of the tensors' names.
TASK_BYTES = 1 << 30
#: Rows of a batch that the reader hands on.
BATCH_ROWS = 4096


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").load(path).select("path", "content")


def tensors(files: DataFrame, metadata_only: bool = False) -> DataFrame:
    """A row per tensor: path, ordinal (header order by name), name, dtype, shape, byte_len, in_bounds and, unless only metadata is asked, data; last, error.

    A file whose header isn't JSON gives one row with its ``error`` and ``in_bounds`` false; one without
    tensors gives none; a range beyond the file is kept with ``in_bounds`` false and null data.
    """
    size = little_endian(F.col("content"), 0, 8).cast("long")
    header = F.from_json(F.decode(F.substring(F.col("content"), F.lit(9), F.col("_n").cast("int")), "UTF-8"), HEADER)
    parsed = files.withColumns({"_n": size, "_size": F.octet_length("content")}).withColumn("_h", header)
    entries = F.array_sort(F.filter(F.map_entries("_h"), lambda e: e["key"] != "__metadata__"))

    def found(e: Column) -> Column:
        first, last = F.get(e["value"]["data_offsets"], F.lit(0)), F.get(e["value"]["data_offsets"], F.lit(1))
        inside = (first >= 0) & (last >= first) & (8 + F.col("_n") + last <= F.col("_size"))
        return F.struct(e["key"].alias("name"), from_safetensors(e["value"]["dtype"]).alias("dtype"), e["value"]["shape"].alias("shape"), (last - first).alias("byte_len"), F.coalesce(inside, F.lit(False)).alias("in_bounds"), (8 + F.col("_n") + first).alias("start"))

    broken = F.when(F.col("_h").isNull(), F.lit("no header of a SafeTensors file"))
    # errors are told before rows are made: neither content nor header goes along with each tensor
    told = parsed.select("path", "content", broken.alias("error"), F.transform(entries, found).alias("_all"))
    if not metadata_only:
        bounded_batches(files.sparkSession)
        schema = T.StructType([T.StructField("path", files.schema["path"].dataType), *T._parse_datatype_string(_CUT).fields])
        return told.mapInArrow(_cut, schema)
    rows = told.select("path", "error", F.posexplode_outer("_all").alias("ordinal", "_e")).filter(F.col("_e").isNotNull() | F.col("error").isNotNull())
    return rows.select("path", "ordinal", "_e.name", "_e.dtype", "_e.shape", "_e.byte_len", F.coalesce("_e.in_bounds", F.lit(False)).alias("in_bounds"), "error")


_CUT = "ordinal int, name string, dtype string, shape array<bigint>, byte_len bigint, in_bounds boolean, data binary, error string"
_KINDS = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.bool_(), pa.binary(), pa.string()]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (path, content, error, tensors found); Catalyst would copy a file's content for each slice of it."""
    rows, size = [], 0

    def made(kind: pa.DataType) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *_KINDS], strict=True)], names=["path", *(f.split()[0] for f in _CUT.split(", "))])

    for batch in batches:
        path, content, error, all_ = batch.columns
        for i in range(batch.num_rows):
            if error[i].is_valid:
                rows.append((path[i].as_py(), None, None, None, None, None, False, None, error[i].as_py()))
            elif all_[i].is_valid:
                whole = content[i].as_buffer()
                for k, e in enumerate(all_[i].as_py()):
                    data = whole.slice(e["start"], e["byte_len"]).to_pybytes() if e["in_bounds"] else None
                    rows.append((path[i].as_py(), k, e["name"], e["dtype"], e["shape"], e["byte_len"], e["in_bounds"], data, None))
                    size += len(data or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield made(path.type)
                        rows, size = [], 0
    if rows:
        yield made(path.type)


def file_metadata(files: DataFrame) -> DataFrame:
    """(path, key, value) of the header's ``__metadata__``, which holds strings only."""
    header = F.decode(F.substring(F.col("content"), F.lit(9), little_endian(F.col("content"), 0, 8).cast("int")), "UTF-8")
    return files.select("path", F.explode(F.from_json(F.get_json_object(header, "$.__metadata__"), "map<string, string>")).alias("key", "value"))


def _files(shard_bytes: int, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Files of rows sorted by model, part and name; one file's bytes are held."""
    group, at, shard, begin = None, 0, 0, 0
    names: dict[str, dict] = {}
    body: list[bytes] = []

    def close() -> Iterator[pa.RecordBatch]:
        if names:
            header = json.dumps(names, ensure_ascii=False, separators=(",", ":")).encode()
            content = b"".join([struct.pack("<Q", len(header)), header, *body])
            names.clear()
            body.clear()
            model, own, parts = group
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((model, own + parts * shard, content), schema, strict=True)], schema=schema)

    for batch in batches:
        for model, own, parts, name, kind, shape, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name is None or data is None:
                raise ValueError(f"model {model}: tensor {name} has no {'name' if name is None else 'data'}")
            if (model, own, parts) != group:
                yield from close()
                group, at, shard, begin = (model, own, parts), 0, 0, 0
            if at // shard_bytes != shard:
                yield from close()
                shard, begin = at // shard_bytes, at
            if name in names:
                raise ValueError(f"model {model} has several tensors {name}")
            names[name] = {"dtype": kind, "shape": shape, "data_offsets": [at - begin, at - begin + len(data)]}
            body.append(data)
            at += len(data)
    yield from close()


def shards(rows: DataFrame, shard_bytes: int = SHARD_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(model_id, shard, content): files of (model_id, name, dtype, shape, data) rows, tensors by name.

    A new shard begins where the running size passes a multiple of ``shard_bytes``.  A model of more
    than ``task_bytes`` is first dealt into parts by hash of the names; its shards then count up in
    steps of the number of parts.  Types without a name in this format must have been decoded before;
    they fail the job, as do a model's tensors of the same name in one file and those without data.
    """
    bounded_batches(rows.sparkSession)
    totals = rows.groupBy(F.col("model_id").alias("_model")).agg(F.ceil(F.sum(F.octet_length("data").cast("long")) / task_bytes).alias("_parts"))
    # there are at most as many large models as task_bytes go into all bytes
    parted = rows.join(F.broadcast(totals.filter(F.col("_parts") > 1)), F.col("model_id").eqNullSafe(F.col("_model")), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    kind = F.coalesce(to_safetensors(F.col("dtype")), F.raise_error(F.concat(F.lit("decode first: "), F.col("dtype"))))
    dealt = parted.select("model_id", F.pmod(F.xxhash64("name"), F.col("_parts")).alias("_part"), "_parts", "name", kind.alias("dtype"), "shape", "data")
    ordered = dealt.repartition("model_id", "_part").sortWithinPartitions("model_id", "_part", "name")
    model = T.StructField("model_id", rows.schema["model_id"].dataType)
    out = T.StructType([model, T.StructField("shard", T.LongType()), T.StructField("content", T.BinaryType())])
    arrow = pa.schema([pa.field("model_id", to_arrow_type(model.dataType)), pa.field("shard", pa.int64()), pa.field("content", pa.binary())])
    return ordered.mapInArrow(lambda batches: _files(shard_bytes, batches, arrow), out)
