"""Registered queries over the given tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.functions import canonical, dtypes, kernels, names, ops
from tensorloom.operators import detect, inspect, jobs, lora, provenance, routes, validate
from tensorloom.plans import derived, operator_queries
from tensorloom.plans.derived import table
from tensorloom.plans.oracles import oracle_sql as _oracle_sql
from tensorloom.sources import gguf, onnx, pytorch, safetensors, sidecars, tflite, walked
from tensorloom.streaming import progress


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural_validation(spark, sf_dir)


def detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(derived.files(spark, sf_dir)).drop("head", "path")


def route_planning(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = routes.plan_jobs(derived.jobs(spark, sf_dir), routes.edges(spark))
    return planned.groupBy("source", "target").agg(F.count("*").alias("jobs"), F.max("cost").alias("cost"), F.max("hops").alias("hops"), F.max("all_native").alias("all_native"), F.max(F.array_join("path", ">")).alias("path"))


def api_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs per edge of the complete reader x writer relation, edges without jobs included."""
    pairs = spark.createDataFrame([(r, w) for r in derived.READERS for w in derived.WRITERS if r != w], "source string, target string")
    counts = derived.jobs(spark, sf_dir).groupBy("source", "target").agg(F.count("*").alias("jobs"))
    return pairs.join(counts, ["source", "target"], "left").select("source", "target", F.coalesce("jobs", F.lit(0)).alias("jobs"))


def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.summary(derived.tensors(spark, sf_dir).drop("data"))


def first_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.first_tensors(derived.tensors(spark, sf_dir).drop("data", "shape"), 10)


def architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.architecture(derived.metadata(spark, sf_dir), derived.ARCHITECTURE)


def typed_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    value = F.when(F.col("event_id") % 4 == 0, k).when(F.col("event_id") % 4 == 1, F.concat(F.lit('"'), k, F.lit('"'))).when(F.col("event_id") % 4 == 2, "true").otherwise("{broken")
    got = [F.count(inspect.typed_get(F.col("v"), kind)).alias(kind.lower()) for kind in ("BIGINT", "STRING", "BOOLEAN")]
    return e.select("event_type", value.alias("v")).groupBy("event_type").agg(*got, F.sum(inspect.typed_get(F.col("v"), "BIGINT")).alias("total"))


def shared_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived.tensors(spark, sf_dir)
    target = F.when(F.col("ordinal") % 4 == 1, F.concat(F.lit("layers."), (F.col("ordinal") - 1).cast("string"), F.lit(".weight")))
    t = t.select("model_id", "name", target.alias("target"), F.when(target.isNull(), 256 + F.col("ordinal")).alias("bytes"))
    return inspect.shared_resolved(t)


def structural_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = derived.tensors(spark, sf_dir)
    return validate.structural(before, derived.converted(before))


def numeric_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = derived.tensors(spark, sf_dir)
    return validate.numeric(before, derived.converted(before), 9e-4).withColumn("mean_abs", F.round("mean_abs", 9))


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = derived.tensors(spark, sf_dir)
    after = derived.converted(before).withColumn("shape", F.array(F.lit(64).cast("bigint")))
    return validate.certificates(validate.structural(before, after), validate.numeric_report(validate.numeric(before, after, 1e-3)))


def lora_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lora.pairs(derived.adapter_keys(spark, sf_dir))


def lora_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops.elements(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("layer"), F.col("embedding").alias("data")))
    base = e.select("layer", F.floor(F.col("i") / 8).alias("r"), (F.col("i") % 8).alias("c"), F.col("x").cast("double").alias("w"))
    a = e.filter("i < 16").select("layer", F.floor(F.col("i") / 8).alias("k"), (F.col("i") % 8).alias("c"), F.col("x").cast("double").alias("v"))
    b = e.filter("i >= 16 and i < 32").select("layer", F.floor((F.col("i") - 16) / 2).alias("r"), (F.col("i") % 2).cast("long").alias("k"), F.col("x").cast("double").alias("v"))
    scale = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("layer"), F.when(F.col("label") % 2 == 0, 4.0).alias("alpha"), F.when(F.col("label") % 3 == 0, 2).alias("rank"))
    return lora.merge(base, a, b, scale).withColumn("w", F.round("w", 9))


def metadata_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lora.last_per_key(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


def provenance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("model_id"), F.col("turn").alias("seq"), F.concat_ws("|", "role", "text").alias("content"))
    chain = provenance.append(c, provenance.root_hash(F.lit(1700000000), F.col("model_id").cast("string")), F.col("content"))
    last = chain.groupBy("model_id").agg(F.max_by("chain_hash", "seq").alias("last"))
    # one model in three is tampered with
    checked = provenance.verify(chain, F.when((F.col("model_id") % 3 == 0) & (F.col("seq") == 1), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return checked.join(last, "model_id")


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.pages(derived.jobs(spark, sf_dir), 3).select("user_id", "place", "job_id", "status")


def job_cancellation(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = derived.jobs(spark, sf_dir)
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_orderkey") % 10 + F.col("l_linenumber")).alias("user_id"))
    asked = asked.unionByName(j.filter(F.col("source") == "GGUF").select("job_id", "user_id"))
    return jobs.cancelled(j, asked).groupBy("source", "status").agg(F.count("*").alias("n"))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return jobs.latest_state(e.select(F.col("user_id").alias("job_id"), "event_id", "ts", F.col("event_type").alias("status")))


def token_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = derived.jobs(spark, sf_dir).select("job_id", "user_id", (F.col("status") == "done").alias("revoked"), (F.col("created_at") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return jobs.valid_tokens(tokens, users, F.lit("1996-01-01").cast("timestamp")).groupBy("c_mktsegment").agg(F.count("*").alias("tokens"), F.countDistinct("user_id").alias("users"))


def users_with_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    return jobs.exists(derived.jobs(spark, sf_dir), users, ["user_id"]).groupBy("c_nationkey").agg(F.count("*").alias("users"))


def orphan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return jobs.orphans(table(spark, sf_dir, "events"), users, "user_id").groupBy("event_type").agg(F.count("*").alias("n"))


def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200, as the history keeps them."""
    return derived.jobs(spark, sf_dir).orderBy(F.desc("created_at"), "job_id").limit(200).select("job_id", "user_id", "status")


def progress_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = progress.as_progress(table(spark, sf_dir, "events"))
    return p.groupBy("job_id", "status").agg(F.count("*").alias("n"), F.round(F.max("progress"), 6).alias("progress"))


def progress_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = progress.by_minute(progress.as_progress(table(spark, sf_dir, "events")))
    return out.select(F.col("window.start").cast("timestamp").cast("long").alias("minute"), "status", "n", F.round("progress", 6).alias("progress"))


def elementwise_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / 10).alias("p"), (F.col("l_quantity") / 10 - 2.5).alias("x"))
    positive = {"Sqrt", "Rsqrt", "Log"}
    return rows.groupBy("l_returnflag").agg(*[F.round(F.sum(f(F.col("p") if name in positive else x)), 4).alias(name) for name, f in ops.ELEMENTWISE.items()])


def row_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops.elements(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("data"))).withColumn("x", F.col("x").cast("double"))
    keys = ["vec_id"]
    e = ops.softmax(e, keys, "x")
    e = ops.softmax(e, keys, "x", "log_softmax", log=True)
    e = ops.layer_norm(e, keys, "x", "layer_norm")
    e = ops.rms_norm(e, keys, "x", "rms_norm")
    return e.select("vec_id", "i", *[F.round(c, 6).alias(c) for c in ("softmax", "log_softmax", "layer_norm", "rms_norm")])


def reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops.elements(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("data")))
    sums = e.groupBy("vec_id").agg(*[F.round(f(F.col("x").cast("double")), 9).alias(name) for name, f in ops.REDUCE.items()])
    return sums.join(ops.arg_extremes(e, ["vec_id"], "x", "i"), "vec_id")


def top_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops.elements(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("data")))
    return ops.top_k(e, ["vec_id"], "x", "i", 3).select("vec_id", "i", "place")


def matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops.elements(table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("data"))).withColumn("x", F.col("x").cast("double"))
    b = e.groupBy(F.col("i").alias("k"), F.col("label").alias("c")).agg(F.avg("x").alias("v"))
    return ops.matmul(e.select(F.col("vec_id").alias("r"), F.col("i").alias("k"), F.col("x").alias("v")), b).withColumn("v", F.round("v", 6))


def safetensors_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = safetensors.shards(derived.text_tensors(spark, sf_dir), 4 << 20)
    files = shards.select(F.concat_ws("/", F.coalesce("model_id", F.lit("none")), F.col("shard").cast("string")).alias("path"), "content")
    read = safetensors.tensors(files)
    return read.select(F.split("path", "/")[0].alias("model_id"), "name", "dtype", "byte_len", "in_bounds", F.sha2("data", 256).alias("sha256"))


def gguf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived.text_tensors(spark, sf_dir)
    files = t.select(F.col("name").alias("path"), derived.gguf_file("name", "data").alias("content"))
    return gguf.tensors(files).select("path", "name", "dtype", "byte_len", "in_bounds", F.size("shape").alias("rank"), F.sha2("data", 256).alias("sha256"))


def _walked(spark: SparkSession, sf_dir: str, make, walk) -> DataFrame:
    t = derived.text_tensors(spark, sf_dir)
    read = walked.tensors(t.select(F.col("name").alias("path"), make("name", "data").alias("content")), walk)
    return read.select("path", "name", "dtype", "byte_len", "in_bounds", F.size("shape").alias("rank"), F.sha2("data", 256).alias("sha256"), "error")


def onnx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir, derived.onnx_file, onnx.walk)


def pytorch_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir, derived.pytorch_file, pytorch.walk)


def tflite_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir, derived.tflite_file, tflite.walk)


def gguf_to_safetensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversion from end to end: files of one format in, shards of another out, and the structural report over both."""
    t = derived.text_tensors(spark, sf_dir)
    source = gguf.tensors(t.select(F.concat_ws("/", F.coalesce("model_id", F.lit("none")), "name").alias("path"), derived.gguf_file("name", "data").alias("content")))
    before = source.select(F.split("path", "/")[0].alias("model_id"), "name", "dtype", "shape", "data")
    files = safetensors.shards(before, 4 << 20)
    after = safetensors.tensors(files.select("model_id", F.concat_ws("/", "model_id", F.col("shard").cast("string")).alias("path"), "content"), metadata_only=True)
    return validate.structural(before, after.select(F.split("path", "/")[0].alias("model_id"), "name", "dtype", "shape"))


def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), names.extension(F.col("url")).alias("ext"), names.sanitized(F.col("url")).alias("name"))


def file_xxh64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", kernels.xxh64(F.col("html").cast("binary")).alias("xxh64"))


def dequantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' bytes as blocks of each type in turn."""
    dtype = derived.pick(list(kernels.KERNELS), F.col("doc_id") % len(kernels.KERNELS))
    d = table(spark, sf_dir, "documents").select("doc_id", dtype.alias("dtype"), F.encode(F.col("text"), "UTF-8").alias("data"))
    values = d.select("doc_id", "dtype", kernels.dequantize(F.col("dtype"), F.col("data")).alias("v"))
    finite = F.filter("v", lambda x: ~F.isnan(x) & (F.abs(x) < 1e30))
    return values.select("doc_id", "dtype", F.size("v").cast("long").alias("n"), F.size(finite).cast("long").alias("n_finite"), F.array_max(finite).alias("greatest"))


def row_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (F.col("l_partkey") % 36).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(kind.alias("type_id"), (F.col("l_quantity") * 32).cast("long").alias("n"))
    size = dtypes.ggml_row_size(F.col("type_id"), F.col("n"))
    return rows.groupBy("type_id").agg(F.max(dtypes.ggml_dtype(F.col("type_id"))).alias("dtype"), F.sum(size).alias("bytes"), F.count(size).alias("whole"), F.count("*").alias("n"))


def adapter_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers and key validity of adapters' names."""
    k = derived.adapter_keys(spark, sf_dir)
    return k.groupBy(names.adapter_side(F.col("key")).alias("side"), names.layer_number(F.col("key")).alias("layer")).agg(F.count("*").alias("n"), F.sum(names.extension_key_valid(F.concat(F.lit("v1@x/"), F.col("key"))).cast("long")).alias("valid"))


def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each tensor would begin in one file per model, in order of name."""
    t = derived.tensors(spark, sf_dir).drop("data").withColumn("size", dtypes.byte_size(F.col("shape"), F.col("dtype")))
    w = Window.partitionBy("model_id").orderBy("name")
    return t.select("model_id", "name", "size", (F.sum(names.round_up(F.col("size"), 32)).over(w) - names.round_up(F.col("size"), 32)).alias("offset"))


def conversion_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors by type: width, requantization, and whether going to F32 loses nothing."""
    t = derived.tensors(spark, sf_dir)
    d = F.col("dtype")
    return t.groupBy("dtype").agg(F.count("*").alias("n")).select("dtype", "n", dtypes.bit_width(d).alias("bits"), dtypes.requantization(d).alias("policy"), dtypes.lossless_upcast(d, F.lit("F32")).alias("lossless"), dtypes.is_quantized(d).alias("quantized"))


def canonical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names' bytes as 4-bit and 8-bit groups."""
    data = F.encode(F.col("p_name"), "UTF-8")
    scales, zeros = F.array(F.lit(0.5), F.lit(0.25)), F.array(F.lit(8.0))
    rows = table(spark, sf_dir, "part").select("p_partkey", canonical.dequantize(data, 4, "block", 16, scales, zeros).alias("four"), canonical.dequantize(data, 8, "sequential", 8, scales, zeros).alias("eight"))

    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, v: a + v)

    return rows.select("p_partkey", F.size("four").cast("long").alias("n"), total("four").alias("four"), total("eight").alias("eight"))


def sidecar_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter and quantization settings out of JSON whose keys differ."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    config = F.when(key % 3 == 0, F.concat(F.lit('{"w_bit":'), size, F.lit(',"q_group_size":64,"r":'), size, F.lit(',"lora_alpha":2.5}'))).when(key % 3 == 1, F.concat(F.lit('{"bits":'), size, F.lit(',"rank":4,"target_modules":["q","v"],"peft_type":"X"}'))).otherwise("{}")
    p = table(spark, sf_dir, "part").select("p_partkey", config.alias("config"))
    out = sidecars.lora(sidecars.awq(p))
    return out.select("p_partkey", "scheme", "bits", "group_size", "rank", "alpha", F.size("target_modules").alias("modules"), "adapter_type")


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    detection, route_planning, api_edges, model_summary, first_tensors, architecture, typed_metadata, shared_tensors, structural_validation, numeric_validation, certificates,
    lora_pairs, lora_merge, metadata_upserts, provenance_chain, job_pages, job_cancellation, job_states, token_validity, users_with_jobs, orphan_events, job_history,
    progress_states, progress_by_minute, elementwise_ops, row_ops, reductions, top_elements, matmul, safetensors_round_trip, gguf_round_trip, onnx_round_trip, pytorch_round_trip, tflite_round_trip, gguf_to_safetensors, file_hashes, file_xxh64,
    dequantized, row_sizes, adapter_inspection, running_offsets, conversion_policy, canonical_groups, sidecar_configs,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES} | operator_queries.queries()


def oracle_sql() -> dict[str, str]:
    return _oracle_sql() | operator_queries.oracle_sql()
