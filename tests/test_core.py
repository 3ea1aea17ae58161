import hashlib
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions import canonical, dtypes, kernels, names, ops
from tensorloom.functions.binary import little_endian, to_little_endian
from tensorloom.operators import detect, jobs, lora, provenance, routes, validate
from tensorloom.plans import queries
from tensorloom.sources import gguf, onnx, pytorch, safetensors, tflite, walked
from tensorloom.streaming import progress


def half(x: float) -> bytes:
    return struct.pack("<e", x)


def decoded(spark, dtype, data):
    df = spark.createDataFrame([(dtype, bytearray(data))], "dtype string, data binary")
    return df.select(kernels.dequantize(F.col("dtype"), F.col("data")).alias("v")).first().v


def f16(b):
    return struct.unpack("<e", bytes(b))[0]


def plain(dtype, b):
    """Each kernel element by element."""
    out = []
    if dtype in ("Q4_0", "Q4_1", "Q5_0", "Q5_1"):
        at = {"Q4_0": 2, "Q4_1": 4, "Q5_0": 6, "Q5_1": 8}[dtype]
        high = int.from_bytes(b[at - 4 : at], "little") if dtype[1] == "5" else 0
        for e in range(32):
            q = (b[at + e // 2] >> 4 * (e % 2) & 15) + 16 * (high >> e & 1)
            out.append((q - (8 if dtype == "Q4_0" else 16)) * f16(b[:2]) if dtype[-1] == "0" else q * f16(b[:2]) + f16(b[2:4]))
    elif dtype == "Q8_0":
        out = [x * f16(b[:2]) for x in np.frombuffer(b[2:], np.int8).tolist()]
    elif dtype == "Q8_K":
        out = [x * struct.unpack("<d", b[:8])[0] for x in np.frombuffer(b[8:264], np.int8).tolist()]
    elif dtype == "Q2_K":
        for g in range(16):
            for j in range(16):
                q = b[16 + 4 * g + j // 4] >> 2 * (j % 4) & 3
                out.append(f16(b[80:82]) * (b[g] & 15) * q - f16(b[82:84]) * (b[g] >> 4))
    elif dtype == "Q4_K_M":
        s = b[4:16]
        for g in range(8):
            if g < 4:
                scale, low = s[g] & 63, s[g + 4] & 63
            else:
                scale, low = (s[g + 4] & 15) | (s[g - 4] >> 6) << 4, (s[g + 4] >> 4) | (s[g] >> 6) << 4
            for j in range(32):
                q = b[16 + 16 * g + j % 16] >> (4 if j >= 16 else 0) & 15
                out.append(f16(b[:2]) * scale * q - f16(b[2:4]) * low)
    elif dtype == "Q3_K_M":
        for i in range(256):
            g = i // 32
            s = (b[96 + g] & 15) | (b[104 + g % 4] >> (2 if g > 3 else 0) & 3) << 6
            q = (b[32 + i // 4] >> 2 * (i % 4) & 3) | (b[i // 8] >> i % 8 & 1) << 2
            out.append(f16(b[108:110]) * (s - 256 if s > 127 else s) * (q - 4))
    elif dtype == "Q5_K_M":
        four = plain("Q4_K_M", half(1) + half(0) + bytes([1] * 4 + [0] * 4 + [1] * 4) + b[48:176])
        one = plain("Q4_K_M", b[:16] + b"\x11" * 128)
        none = plain("Q4_K_M", b[:16] + b"\0" * 128)
        for i in range(256):
            g, j = divmod(i, 32)
            fifth = b[16 + 4 * (g // 4) + j // 8] >> (g % 4 + j % 8) % 8 & 1
            out.append((one[i] - none[i]) * (four[i] + 16 * fifth) + none[i])
    elif dtype == "Q6_K":
        for e in range(256):
            q = (b[e // 2] >> 4 * (e % 2) & 15) | (b[128 + e // 4] >> 2 * (e % 4) & 3) << 4
            out.append(f16(b[208:210]) * np.int8(b[192 + e // 16].__index__() if b[192 + e // 16] < 128 else b[192 + e // 16] - 256) * (q - 32))
    return out


@pytest.mark.parametrize("dtype", ["Q4_0", "Q4_1", "Q5_0", "Q5_1", "Q8_0", "Q8_K", "Q2_K", "Q3_K_M", "Q4_K_M", "Q5_K_M", "Q6_K"])
def test_kernels(spark, dtype):
    rng = np.random.default_rng(len(dtype))
    size = kernels.KERNELS[dtype][0]
    blocks = []
    for _ in range(3):
        b = bytearray(rng.integers(0, 256, size, dtype=np.uint8).tobytes())
        for at in {"Q2_K": (80, 82), "Q3_K_M": (108,), "Q6_K": (208,)}.get(dtype, (0, 2) if dtype in ("Q4_1", "Q5_1", "Q4_K_M", "Q5_K_M") else (0,)):
            b[at : at + 2] = half(float(rng.normal()))
        if dtype == "Q8_K":
            b[:8] = struct.pack("<d", 0.5)
        blocks.append(bytes(b))
    got = decoded(spark, dtype, b"".join(blocks) + b"rest")
    assert got == pytest.approx([v for b in blocks for v in plain(dtype, b)], rel=1e-4, abs=1e-4)


def test_closed_forms(spark):
    assert decoded(spark, "F16", b"\x00\x3c") == [1.0] and decoded(spark, "BF16", b"\x80\x3f\x80\x3f") == [1.0, 1.0]
    assert decoded(spark, "Q4_K_M", half(1) + half(0) + bytes([1] * 4 + [0] * 4 + [1] * 4) + b"\xff" * 128) == [15.0] * 256
    assert decoded(spark, "Q8_K", struct.pack("<d", 1.0) + bytes(range(256)) + bytes(28)) == [float(np.int8(np.uint8(i))) for i in range(256)]
    assert decoded(spark, "Custom:x", b"abc") is None and decoded(spark, "F32", None or b"") == []


def test_types(spark):
    rows = [("F32", 128, 0), ("F16", 128, 1), ("Q4_0", 32, 2), ("Q4_0", 64, 2), ("Q4_K_M", 256, 15), ("Q4_0", 33, 2)]
    df = spark.createDataFrame(rows, "d string, n long, t int")
    assert [r[0] for r in df.select(dtypes.ggml_row_size(F.col("t"), F.col("n"))).collect()] == [512, 256, 18, 36, 144, None]
    pairs = spark.createDataFrame([("F16", "F32"), ("F32", "F16"), ("U8", "I16"), ("I8", "I64"), ("Q8_0", "Q8_0"), ("F16", "BF16")], "a string, b string")
    assert [r[0] for r in pairs.select(dtypes.lossless_upcast(F.col("a"), F.col("b"))).collect()] == [True, False, False, True, True, False]
    one = spark.createDataFrame([([],), ([3, 4],), ([0, 5],)], "s array<bigint>").select(dtypes.num_elements(F.col("s"))).collect()
    assert [r[0] for r in one] == [1, 12, 0]


def test_little_endian(spark):
    values = [0, 1, 255, 256, 0xC3A9, 1 << 40]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", to_little_endian(F.col("v")).alias("b"))
    got = df.select("v", F.hex("b").alias("h"), little_endian(F.col("b"), 0, 8).cast("long").alias("back")).collect()
    assert all(bytes.fromhex(r.h) == struct.pack("<q", r.v) and r.back == r.v for r in got)


ST = lambda header: struct.pack("<Q", len(header)) + header


@pytest.mark.parametrize(
    ("name", "head", "want"),
    [
        ("a", b"GGUF\x03\0\0\0", ("GGUF", 0.99, "v3", None, False)),
        ("a", ST(b"{}"), ("SafeTensors", 0.99, "1.0", None, False)),
        ("a", b"\0\0\0\0TFL3", ("TFLite", 0.99, "TFL3", None, False)),
        ("a", b"\xff\xfe\0\x01", (None, None, None, None, False)),
        ("a", ST(b'{"qweight":1,"qzeros":1,"scales":1}'), ("SafeTensors", 0.99, "1.0", "AWQ", True)),
        ("a", ST(b'{"x.lora_A":1}'), ("SafeTensors", 0.99, "1.0", "LoRA", True)),
        ("x.bin", b"PK\x03\x04", ("PyTorch", 0.9, None, "GGML", False)),
        ("x.onnx", b"\x08\x01", ("ONNX", 0.95, None, None, False)),
        ("x.pt", b"\x08\x01", ("PyTorch", 0.55, None, "ONNX", True)),
        ("x.gguf", b"", ("GGUF", 0.7, None, None, False)),
        ("x.bin", b"\x89HDF", ("KerasH5", 0.85, None, "PyTorch", False)),
        ("x.GGUF", b"zzzz", (None, None, None, None, False)),
        ("x.gguf", None, ("GGUF", 0.7, None, None, False)),
    ],
)
def test_detection(spark, name, head, want):
    df = spark.createDataFrame([(name, None if head is None else bytearray(head))], "path string, head binary")
    r = detect.detect(df).first()
    assert (r.format, r.confidence, r.version, r.runner_up, r.ambiguous) == want


GOLDEN = {
    ("AWQ", "CoreML"): (43, "AWQ>SafeTensors>CoreML"), ("GGML", "ExecuTorch"): (38, "GGML>GGUF>SafeTensors>PyTorch>ExecuTorch"), ("GGUF", "PyTorch"): (8, "GGUF>SafeTensors>PyTorch"),
    ("ONNX", "GGUF"): (16, "ONNX>SafeTensors>GGUF"), ("TFLite", "ExecuTorch"): (33, "TFLite>SafeTensors>PyTorch>ExecuTorch"), ("SafeTensors", "OpenVINO"): (35, "SafeTensors>OpenVINO"), ("GGUF", "GGUF"): (0, "GGUF"),
}


def test_routes(spark):
    got = {(r.source, r.target): (r.cost, ">".join(r.path)) for r in routes.routes(routes.edges(spark)).collect()}
    assert {k: got[k] for k in GOLDEN} == GOLDEN
    assert ("CoreML", "GGUF") not in got and len([k for k in got if k[0] != k[1]]) == 85


def test_safetensors(spark):
    rows = [("m", "b", "F32", [2], bytearray(struct.pack("<2f", 1, 2))), ("m", "é", "U8", [3], bytearray(b"\xc3\xa9\xff")), ("m", "a", "F16", [1, 1], bytearray(b"\0\x3c")), ("n", "x", "I8", [], bytearray(b"\x01"))]
    t = spark.createDataFrame(rows, "model_id string, name string, dtype string, shape array<bigint>, data binary")
    for limit, task in ((1 << 20, 1 << 30), (4, 1 << 30), (4, 5), (1 << 20, 5)):
        files = safetensors.shards(t, limit, task).withColumn("path", F.concat_ws("/", "model_id", F.col("shard").cast("string")))
        back = {(r.path[0], r.name): (r.dtype, r.shape, bytes(r.data)) for r in safetensors.tensors(files).collect()}
        assert back == {(r[0], r[1]): (r[2], r[3], bytes(r[4])) for r in rows}
    bad = ST(b'{"t":{"dtype":"F32","shape":[10000],"data_offsets":[0,40000]},"__metadata__":{"k":"v"}}') + b"1234"
    f = spark.createDataFrame([("p", bytearray(bad)), ("q", bytearray(b"\x02" + b"\0" * 7 + b"xx")), ("r", bytearray(b"")), ("s", None)], "path string, content binary")
    got = safetensors.tensors(f).collect()
    assert {(r.path, r.name, r.in_bounds, r.data) for r in got if r.error is None} == {("p", "t", False, None)} and len(got) == 4
    assert {r.path for r in got if r.error and not r.in_bounds} == {"q", "r", "s"}  # broken files have a row
    none = spark.createDataFrame([("e", bytearray(ST(b"{}")))], "path string, content binary")
    assert not safetensors.tensors(none).collect()
    assert [(r.key, r.value) for r in safetensors.file_metadata(f).collect()] == [("k", "v")]


def test_gguf(spark):
    data = gguf.write({"general.architecture": "phi", "phi.block_count": 2, "x": 0.1, "neg": -5, "flag": True}, [("w", [2, 3], "F32", bytes(range(24))), ("q", [32], "Q4_0", bytes(18))])
    f = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"nope")), ("c", bytearray(data[:-10])), ("d", bytearray(b"GGUF" + struct.pack("<I", 99)))], "path string, content binary")
    t = {(r.path, r.name): r for r in gguf.tensors(f).filter("error is null").collect()}
    assert bytes(t["a", "w"].data) == bytes(range(24)) and t["a", "w"].shape == [2, 3] and t["a", "q"].byte_len == 18
    assert not t["c", "q"].in_bounds and set(t) == {(p, n) for p in "ac" for n in "wq"}
    m = {r.key: r.value for r in gguf.metadata(f).filter("path = 'a'").collect()}
    assert m["phi.block_count"] == "2" and m["neg"] == "-5" and float(m["x"]) == pytest.approx(0.1) and m["flag"] == "true"
    assert gguf.rows(f).filter("row = 'error'").count() == 2
    assert {r.path for r in gguf.tensors(f).filter("error is not null").collect()} == {"b", "d"}  # broken files have a row
    v1 = b"GGUF" + struct.pack("<III", 1, 0, 0)
    assert list(gguf.walk(v1)) == []


def test_numeric(spark):
    b = spark.createDataFrame([(1, "x", [1.0, 2.0]), (1, "n", [float("nan"), 1.0]), (1, "short", [1.0]), (1, "none", [])], "model_id int, name string, data array<float>")
    a = spark.createDataFrame([(1, "x", [1.0000001, 4.0]), (1, "n", [0.0, 1.5]), (1, "short", [1.0, 2.0]), (1, "none", [])], "model_id int, name string, data array<float>")
    got = {r.name: r for r in validate.numeric(b, a, 1e-5).collect()}
    assert set(got) == {"x", "n"} and got["x"].max_abs == 2.0 and not got["x"].passed
    assert got["n"].max_abs == 0.5 and math.isnan(got["n"].mean_abs)
    pairs = spark.createDataFrame([("F32", "F32"), ("F32", "F16"), ("BF16", "F32"), ("Q8_0", "F32"), ("Q4_K_M", "F32"), ("I8", "F32")], "a string, b string")
    assert [r[0] for r in pairs.select(validate.numeric_threshold(F.col("a"), F.col("b"))).collect()] == [0, 1e-3, 2e-2, 1e-3, 1e-2, 1e-4]


def test_lora(spark):
    w = spark.createDataFrame([("l", r, c, 1.0 if r == c else 0.0) for r in range(2) for c in range(3)] + [("free", 0, 0, 5.0)], "layer string, r int, c int, w double")
    a = spark.createDataFrame([("l", k, c, 0.1 if k == c else 0.0) for k in range(2) for c in range(3)], "layer string, k int, c int, v double")
    b = spark.createDataFrame([("l", r, k, 1.0 if r == k else 0.0) for r in range(2) for k in range(2)], "layer string, r int, k int, v double")
    s = spark.createDataFrame([("l", 2.0, 2)], "layer string, alpha double, rank int")
    got = {(r.layer, r.r, r.c): r.w for r in lora.merge(w, a, b, s).collect()}
    assert got["l", 0, 0] == pytest.approx(1.1) and got["l", 1, 1] == pytest.approx(1.1) and got["l", 0, 2] == 0 and got["free", 0, 0] == 5


def test_provenance(spark):
    rows = [(m, i, f"step {m} {i}") for m in (1, 2) for i in range(4)]
    e = spark.createDataFrame(rows, "model_id long, seq long, content string")
    chain = provenance.append(e, provenance.root_hash(F.lit(1), F.lit("p")), F.col("content")).cache()
    assert {r.model_id: r.valid for r in provenance.verify(chain, F.col("content")).collect()} == {1: True, 2: True}
    edited = F.when((F.col("model_id") == 2) & (F.col("seq") == 2), "other").otherwise(F.col("content"))
    assert {r.model_id: r.valid for r in provenance.verify(chain, edited).collect()} == {1: True, 2: False}
    none = provenance.append(spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "b"), (None, 0, "c")], e.schema), provenance.root_hash(F.lit(1), F.lit("p")), F.col("content"))
    assert {r.seq: r.chain_hash is None for r in none.collect()} == {0: False, 1: True, 2: True}
    last = hashlib.sha256(b"ROOT_1_p").hexdigest()
    for i in range(4):
        last = hashlib.sha256((last + hashlib.sha256(f"step 1 {i}".encode()).hexdigest()).encode()).hexdigest()
        assert chain.filter(f"model_id = 1 and seq = {i}").first().chain_hash == last


def test_names(spark):
    df = spark.createDataFrame([("/a.b/c.tar.gz", "base_model.model.x.lora_A.weight"), ("/a.b/c", "y.bias")], "p string, k string")
    got = df.select(names.extension(F.col("p")), names.adapter_side(F.col("k")), names.base_key(names.adapter_layer(F.col("k"))), names.extension_key_valid(F.lit("GGUF@v3/field")), names.extension_key_valid(F.lit("GGUF/v3@field")), names.sanitized(F.lit("a b/ç?" + "x" * 200)))
    one, two = got.collect()
    assert tuple(one)[:5] == ("gz", "A", "x.weight", True, False) and two[0] == "" and two[1] is None and len(one[5]) == 128


def test_jobs(spark):
    j = spark.createDataFrame([(i, i % 3, ["queued", "done", "running"][i % 3], f"2024-01-0{1 + i % 7}") for i in range(30)], "job_id long, user_id int, status string, created_at string")
    first, second = (jobs.listing(j, F.lit(0), limit=4, offset=o).collect() for o in (0, 4))
    keys = [(r.created_at, -r.job_id) for r in [*first, *second]]
    assert keys == sorted(keys, reverse=True) and len({r.job_id for r in [*first, *second]}) == 8
    asked = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "job_id long, user_id int")
    after = {r.job_id: r.status for r in jobs.cancelled(j, asked).collect()}
    assert (after[0], after[1], after[2]) == ("cancelled", "done", "running")


def test_stream_like_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = progress.as_progress(progress.read_stream(spark, f"{tmp_path}/in", events.schema, 1))
    query = progress.start(progress.of_job(stream, 1), "parquet", f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    assert query.awaitTermination(120) and query.exception() is None
    want = sorted(map(tuple, progress.of_job(progress.as_progress(events), 1).collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want
    assert progress.framed(events.limit(1)).first().frame.startswith("data: {")


def test_ops(spark):
    x = spark.createDataFrame([(float(v),) for v in (-4, -0.5, 0, 0.5, 2.5, 7)], "x double")
    got = x.select(*[ops.ELEMENTWISE[n](F.col("x")).alias(n) for n in ("Relu6", "Silu", "HardSwish", "Round", "Elu")]).collect()
    for r, (v,) in zip(got, x.collect(), strict=True):
        assert r.Relu6 == min(max(v, 0), 6) and r.Silu == pytest.approx(v / (1 + math.exp(-v))) and r.Round == round(v)
        assert r.HardSwish == pytest.approx(v * min(max(v + 3, 0), 6) / 6) and r.Elu == pytest.approx(v if v >= 0 else math.expm1(v))
    eye = spark.createDataFrame([(i, i, 1.0) for i in range(3)], "r long, k long, v double")
    b = spark.createDataFrame([(k, c, float(3 * k + c)) for k in range(3) for c in range(3)], "k long, c long, v double")
    assert {(r.r, r.c): r.v for r in ops.matmul(eye, b).collect()} == {(k, c): float(3 * k + c) for k in range(3) for c in range(3)}


def test_canonical(spark):
    one = spark.createDataFrame([(bytearray(b"\x21\x43"), [1.0], [0.0])], "d binary, s array<double>, z array<double>")
    col = lambda bits, order, block: canonical.dequantize(F.col("d"), bits, order, block, F.col("s"), F.col("z"))
    assert one.select(col(4, "block", 4)).first()[0] == [1.0, 2.0, 3.0, 4.0]
    two = spark.createDataFrame([(bytearray([2, 4, 6]), [0.5], [])], "d binary, s array<double>, z array<double>")
    assert two.select(col(8, "sequential", 3)).first()[0] == [1.0, 2.0, 3.0]
    assert two.select(col(2, "sequential", 100)).first()[0] == [1.0, 0, 0, 0, 0, 0.5, 0, 0, 1.0, 0.5, 0, 0]
    assert one.select(col(4, "interleaved", 4)).first()[0] == [1.0, 2.0, 3.0, 4.0]
    empty = spark.createDataFrame([(bytearray(), [1.0], [0.0]), (None, None, None)], "d binary, s array<double>, z array<double>")
    assert [r[0] for r in empty.select(col(4, "block", 4)).collect()] == [[], None]


ENTRIES = [("w", [2, 3], "F32", bytes(range(24))), ("b", [], "I64", bytes(8)), ("h.é", [4], "F16", bytes(range(8)))]


@pytest.mark.parametrize("module", [onnx, pytorch, tflite])
def test_walked_formats(spark, module):
    data = module.write(ENTRIES)
    f = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"nope")), ("c", None)], "path string, content binary")
    got = {(r.path, r.name): r for r in walked.tensors(f, module.walk).collect()}
    assert {n: (r.dtype, r.shape, bytes(r.data)) for (p, n), r in got.items() if p == "a"} == {n: (d, s, x) for n, s, d, x in ENTRIES}
    assert got["b", None].error and got["c", None].error


@pytest.mark.parametrize("module", [onnx, pytorch, tflite])
def test_tensors_without_elements_are_kept(module):
    entries = [("w", [0], "U8", b""), ("v", [1, 0], "I8", b""), ("b", [2], "U8", b"ab")]
    assert sorted((f[0], f[1], f[2], f[4]) for f in module.walk(module.write(entries))) == sorted((n, d, s, len(x)) for n, s, d, x in entries)


def test_tflite_tensors_whose_data_comes_at_run_time_are_none():
    assert [f[0] for f in tflite.walk(tflite.write([("x", [2], "U8", b""), ("s", [], "F32", b""), ("b", [1], "U8", b"a")]))] == ["b"]


def test_tflite_query_keeps_empty_texts(spark, tmp_path):
    rows = [(1, "a", ""), (2, "a", None), (3, None, "é")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.tflite_round_trip(spark, str(tmp_path)).collect()
    assert sorted((r.path, r.dtype, r["rank"], r.byte_len, r.in_bounds, r.error) for r in got) == [(f"doc.{i}", t, n, 2 * (i == 3), True, None) for i in (1, 2, 3) for t, n in (("I8", 2), ("U8", 1))]


def test_onnx_typed_fields():
    t = onnx._field(1, 2) + onnx._field(2, 1) + onnx._field(8, b"x") + onnx._field(4, struct.pack("<2f", 1, 2))
    u = onnx._field(2, 3) + onnx._field(8, b"y") + onnx._field(5, b"\x01\xff\x01")
    skipped = onnx._field(2, 8) + onnx._field(8, b"z") + onnx._field(9, b"s")
    found = list(onnx.walk(onnx._field(7, b"".join(onnx._field(5, m) for m in (t, u, skipped)))))
    assert [(f[0], f[1], f[2], f[5]) for f in found] == [("x", "F32", [2], struct.pack("<2f", 1, 2)), ("y", "I8", [], b"\x01\xff")]


def test_pickles_are_not_run(tmp_path):
    import io
    import pickle
    import zipfile

    class Bad:
        def __reduce__(self):
            return (open, (str(tmp_path / "made"), "w"))

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("m/data.pkl", pickle.dumps({"x": Bad(), "y": [1, {"z": None}]}, protocol=4))
    assert list(pytorch.walk(out.getvalue())) == [] and not (tmp_path / "made").exists()
