"""What bounds memory and work where cells or files are large."""

import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tensorloom import shared
from tensorloom.functions import kernels, tensor_ops
from tensorloom.sources import safetensors, walked


@pytest.mark.parametrize("bound", [lambda df: kernels.dequantize(F.lit("F32"), F.col("content")), lambda df: walked.tensors(df, lambda _: [])], ids=["dequantize", "walked"])
def test_batches_for_python_are_bounded_by_bytes(spark, bound):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    files = spark.range(0, 600, 1, 1).select(F.col("id").cast("string").alias("path"), F.repeat(F.lit("x"), 50_000).cast("binary").alias("content"))
    bound(files)

    def batch_bytes(data: pd.Series) -> pd.Series:
        return pd.Series([int(data.map(len).sum())] * len(data))

    most, n = files.select(F.pandas_udf(batch_bytes, "long")("content").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert n == 600 and most <= 1.1 * shared.BATCH_BYTES
    spark.conf.set(key, "123456")  # a session's own bound stays
    bound(files)
    assert spark.conf.get(key) == "123456"
    spark.conf.unset(key)


@pytest.mark.parametrize("name", list(kernels.KERNELS))
def test_decoding_needs_little_more_than_its_result(name):
    size, kernel = kernels.KERNELS[name]
    data = np.random.default_rng(3).integers(0, 256, 6_000_000 // size * size, np.uint8).tobytes()
    tracemalloc.start()
    values = kernels.decoded(name, data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < values.nbytes + 100 * kernels.LOT_BYTES
    with np.errstate(all="ignore"):
        assert values.tobytes() == kernel(np.frombuffer(data, np.uint8).reshape(-1, size)).tobytes()


def test_a_file_of_many_tensors_is_not_copied_for_each_of_them(spark):
    t = spark.range(0, 12_000, 1, 1).select(F.lit("m").alias("model_id"), F.col("id").cast("string").alias("name"), F.lit("U8").alias("dtype"), F.array(F.lit(1000).cast("long")).alias("shape"), F.rpad(F.col("id").cast("string"), 1000, "x").cast("binary").alias("data"))
    began = time.monotonic()
    files = safetensors.shards(t).withColumn("path", F.lit("p"))
    wrong = safetensors.tensors(files).filter((F.col("data") != F.rpad("name", 1000, "x").cast("binary")) | ~F.col("in_bounds"))
    assert files.count() == 1 and wrong.count() == 0 and safetensors.tensors(files).count() == 12_000
    assert time.monotonic() - began < 40  # 12 MB; a copy of the file for each tensor and step would be 144 GB each


@pytest.mark.parametrize("rows", [[("m", "a", b"1"), ("m", "a", b"1")], [("m", "a", None)], [("m", None, b"1")]], ids=["twice", "no data", "no name"])
def test_tensors_that_fit_in_no_file_fail_the_job(spark, rows):
    t = spark.createDataFrame(rows, "model_id string, name string, data binary").select("model_id", "name", F.lit("U8").alias("dtype"), F.array(F.lit(1).cast("long")).alias("shape"), "data")
    with pytest.raises(Exception, match=r"several tensors|has no"):
        safetensors.shards(t).collect()


def test_what_all_elements_share_is_computed_once(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 8.0], [[1.0] * 4, [2.0] * 4])], "x array<double>, w array<array<double>>")
    experts = F.array(*[F.struct(F.lit(1.0).alias("scale"), F.lit(0.5).alias("shift"))] * 2)

    def plan(value):
        return df.select(value.alias("v"))._jdf.queryExecution().optimizedPlan().toString()

    assert plan(tensor_ops.mixture_of_experts(F.col("x"), F.col("w"), experts)).count("array_sort(") == 1
    assert plan(tensor_ops.group_norm(F.col("x"), 4, 2)).count("aggregate(") == 2  # a mean and a variance
