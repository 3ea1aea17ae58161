"""Tensor operators, accounts, catalogue, stores and routes against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from tensorloom.functions import kernels, names
from tensorloom.functions import tensor_ops as t
from tensorloom.operators import accounts, catalogue, routes, store
from tensorloom.sources import gguf


def value(spark, column, **columns):
    names_ = list(columns)
    return spark.createDataFrame([tuple(columns.values())], names_).select(column.alias("v")).first().v


def test_shapes(spark):
    x = [float(i) for i in range(6)]
    q = F.col("x")
    assert value(spark, t.transpose(q, 2, 3), x=x) == [0, 3, 1, 4, 2, 5]
    assert value(spark, t.pad(q, 2, 3, (0, 1), (1, 0), 9.0), x=x) == [9, 0, 1, 2, 9, 3, 4, 5, 9, 9, 9, 9]
    assert value(spark, t.tile(q, 2, 3, (2, 1)), x=x) == x + x
    assert value(spark, t.gather(q, F.array(F.lit(-1), F.lit(5)), 3), x=x) == [3, 4, 5, None, None, None]
    assert value(spark, t.concat_columns(q, q, 2, 3, 3), x=x) == [0, 1, 2, 0, 1, 2, 3, 4, 5, 3, 4, 5]
    assert value(spark, t.expand(F.slice(q, 1, 2), 2, 1, (2, 3)), x=x) == [0, 0, 0, 1, 1, 1]
    assert t.reshape([2, 6], [3, -1]) == [3, 4] and t.squeeze([1, 3, 1]) == [3] and t.unsqueeze([3], [0, 2]) == [1, 3, 1] and t.flatten([2, 3, 4], 1) == [2, 12]
    with pytest.raises(ValueError):
        t.reshape([2, 3], [4, -1])
    with pytest.raises(ValueError):
        t.squeeze([2, 1], [0])


def test_values(spark):
    assert value(spark, F.array(*[t.erf(F.lit(v)) for v in (-2.0, 0.0, 0.5, 3.0)]), x=1) == pytest.approx([math.erf(v) for v in (-2, 0, 0.5, 3)], abs=2e-7)
    assert value(spark, t.cast(F.lit("12"), "I8"), x=1) == 12 and value(spark, t.cast(F.lit("300"), "I8"), x=1) is None
    assert value(spark, t.where(F.lit(None).cast("boolean"), F.lit(1), F.lit(2)), x=1) == 2
    assert value(spark, t.reduce_prod(F.col("x")), x=[2.0, -3.0, 0.5]) == -3


def test_attention_of_equal_tokens_is_their_value(spark):
    rows = spark.createDataFrame([(0, p, [1.0, 2.0]) for p in range(5)] + [(1, 0, [3.0, 4.0])], "s int, p int, x array<double>")
    got = {(r.s, r.p): r.out for r in t.attention(rows, "s", "p", "x", "x", "x", 2, causal=True).collect()}
    assert len(got) == 6 and got[1, 0] == pytest.approx([3, 4]) and all(got[0, p] == pytest.approx([1, 2]) for p in range(5))


def test_accounts(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "user_id long, email string")
    new = spark.createDataFrame([(2, "x"), (3, "c")], "user_id long, email string")
    assert sorted(map(tuple, accounts.insert(users, new, ["user_id"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert [r.email for r in accounts.by_key(users, new, "user_id").collect()] == ["b"]
    tokens = accounts.issued(spark.createDataFrame([("t1", 1, False), ("t2", 1, False)], "token string, user_id long, revoked boolean"))
    gone = tokens.filter("token_hash = sha2('t1', 256)")
    assert sorted(r.revoked for r in accounts.revoked(tokens, gone).collect()) == [False, True] and "token" not in tokens.columns
    jobs = accounts.queued(spark.createDataFrame([(7, 1, "A", "B", 0)], "job_id long, user_id long, source string, target string, at int"))
    assert jobs.first().status == "queued" and accounts.healthy(jobs).first().ok
    asked = spark.createDataFrame([(7, 1), (7, 2), (8, 1)], "job_id long, user_id long")
    assert sorted((r.user_id, r.own) for r in accounts.owners(jobs, asked).collect()) == [(1, True), (2, False)]
    assert accounts.downloads(jobs.withColumn("output_path", F.lit("/x"))).isEmpty()


def test_catalogue(spark):
    assert [value(spark, catalogue.known_architecture(F.lit(x).cast("string")), x=1) for x in ("phi3", "PHI3", None)] == [True, False, False]
    meta = [("a", "tokenizer.ggml.model", "STRING", "llama"), ("a", "tokenizer.ggml.bos_token_id", "BIGINT", "1"), ("a", "tokenizer.ggml.eos_token_id", "STRING", "2"), ("b", "tokenizer.ggml.bos_token_id", "BIGINT", "1")]
    got = catalogue.tokenizer(spark.createDataFrame(meta, "model_id string, key string, kind string, value string")).collect()
    assert [(r.model_id, r.type, r.bos_token, r.eos_token) for r in got] == [("a", "BPE", "1", None)]


def test_extension_store(spark):
    writes = [("m", 0, "f@1/a", "xxxx"), ("m", 1, "f@2/a", "xxxxx"), ("m", 2, "f@1/a", "xx"), ("m", 3, "bad", "x"), ("m", 4, "g@1/a", "xxxxxxxxxx"), ("n", 0, "f@1/a", None)]
    rows = spark.createDataFrame([(1 if m == "m" else 2, s, k, v) for m, s, k, v in writes], "model_id long, seq long, key string, value string")
    # the second write would make 4 + 5 > 8, though it replaces the first
    assert sorted(map(tuple, store.extension_writes(rows, 8).collect())) == [(1, 1, 2), (2, 1, 0)]


def test_graph(spark):
    graph = routes.edges(spark)
    pairs = spark.createDataFrame([("GGUF", "ONNX"), ("ONNX", "LoRA")], "source string, target string")
    assert {(r.source, r.direct) for r in routes.has_edge(graph, pairs).collect()} == {("GGUF", True), ("ONNX", False)}
    assert routes.edges_from(graph, "LoRA").count() == 1 and routes.formats(graph).count() == 14 and not routes.acyclic(graph)
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0, True) for i in range(12)], "source string, target string, cost double, native boolean")
    assert routes.acyclic(chain)
    more = routes.register(chain, spark.createDataFrame([("n0", "n12", 20.0, False)], chain.schema))
    best = {(r.source, r.target): r for r in routes.attributes(routes.routes(more)).collect()}
    assert best["n0", "n12"].hops == 12 and best["n0", "n12"].all_native and best["n3", "n4"].is_direct and best["n3", "n5"].steps == "n3 -> n4 -> n5"


def test_names(spark):
    assert [value(spark, names.round_up(F.lit(n), 32), x=1) for n in (0, 1, 32, 2**60 + 1)] == [0, 32, 32, 2**60 + 32]
    assert value(spark, F.array(names.stem(F.lit("/a/b.tar.gz")), names.stem(F.lit(".x")), names.slug(F.lit("LoRA Adapter!"))), x=1) == ["b.tar", ".x", "lora-adapter"]


def test_xxh64():
    import pandas as pd

    assert list(kernels.xxh64.func(pd.Series([b"", b"a", b"abc", None]))) == ["ef46db3751d8e999", "d24ec4f1a98c6e5b", "44bc2cf5ad770999", None]


def test_gguf_alignment_is_checked(spark):
    import struct

    def file(align):
        key = b"general.alignment"
        head = b"GGUF" + struct.pack("<IQQ", 3, 0, 1) + struct.pack("<Q", len(key)) + key
        return head + (struct.pack("<II", 4, align) if isinstance(align, int) else struct.pack("<IQ", 8, 1) + b"x")

    rows = spark.createDataFrame([("zero", file(0)), ("text", file("x")), ("null", None)], "path string, content binary")
    got = {r.path: r.error for r in gguf.tensors(rows).collect()}
    assert set(got) == {"zero", "text", "null"} and all(got.values()) and "alignment" in got["zero"]
