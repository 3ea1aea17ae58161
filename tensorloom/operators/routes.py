"""Conversion routes: least-cost paths in a small weighted graph, by repeated relaxation joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.shared import checkpointed

# Source, target, cost, and whether no external tool is needed.
EDGES = [
    ("GGUF", "GGUF", 1.0, True), ("GGUF", "SafeTensors", 5.0, True), ("SafeTensors", "GGUF", 8.0, True), ("SafeTensors", "PyTorch", 3.0, True), ("PyTorch", "SafeTensors", 3.0, True),
    ("GGUF", "ONNX", 15.0, True), ("SafeTensors", "ONNX", 12.0, True), ("PyTorch", "ONNX", 10.0, True), ("ONNX", "SafeTensors", 8.0, True), ("ONNX", "GGUF", 18.0, True),
    ("ONNX", "TFLite", 20.0, True), ("TFLite", "ONNX", 15.0, True), ("GGML", "GGUF", 10.0, True), ("AWQ", "SafeTensors", 8.0, True), ("GPTQ", "SafeTensors", 8.0, True),
    ("SafeTensors", "TFLite", 12.0, True), ("TFLite", "SafeTensors", 10.0, True), ("PyTorch", "GGUF", 12.0, True), ("GGUF", "PyTorch", 12.0, True), ("AWQ", "ONNX", 18.0, True),
    ("GPTQ", "ONNX", 18.0, True), ("ONNX", "CoreML", 25.0, False), ("SafeTensors", "CoreML", 35.0, False), ("ONNX", "TensorRT", 30.0, False), ("SafeTensors", "TensorRT", 40.0, False),
    ("ONNX", "OpenVINO", 25.0, False), ("SafeTensors", "OpenVINO", 35.0, False), ("ONNX", "ExecuTorch", 30.0, False), ("PyTorch", "ExecuTorch", 20.0, False),
    ("LoRA", "SafeTensors", 3.0, True), ("PEFT", "SafeTensors", 3.0, True),
]

def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "source string, target string, cost double, native boolean")


def edges_from(graph: DataFrame, node: str | None = None) -> DataFrame:
    """Edges out of a node, or of every node."""
    return graph if node is None else graph.filter(F.col("source") == node)


def has_edge(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target) pairs with ``direct``: whether an edge joins them."""
    return pairs.join(graph.select("source", "target").distinct().withColumn("direct", F.lit(True)), ["source", "target"], "left").withColumn("direct", F.coalesce("direct", F.lit(False)))


def register(graph: DataFrame, new: DataFrame) -> DataFrame:
    """The graph with further edges; of edges between the same nodes, the cheapest counts in routes."""
    return graph.unionByName(new.select(*graph.columns))


def formats(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("source").alias("format")).union(graph.select("target")).distinct()


def _settled(found: DataFrame) -> tuple[DataFrame, tuple]:
    """A small table computed once, and what tells whether it has changed."""
    kept = checkpointed(found)
    return kept, tuple(kept.agg(F.count("*"), F.sum(F.xxhash64(*kept.columns).cast("decimal(38,0)"))).first())


def routes(graph: DataFrame) -> DataFrame:
    """(source, target, cost, hops, all_native, path) of the least-cost route of every reachable pair.

    A node reaches itself with no hop and no cost.  Ties go to fewer hops, then to the greater path.
    The best routes known are extended by an edge each until none gets better; costs aren't negative.
    """
    nodes = formats(graph).select(F.col("format").alias("n"))
    found = nodes.select(F.col("n").alias("source"), F.col("n").alias("target"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(True).alias("all_native"), F.array("n").alias("path"))
    step = graph.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("cost").alias("c"), "native")
    best = Window.partitionBy("source", "target").orderBy("cost", "hops", F.desc("path"))
    found, mark = _settled(found)
    while True:
        longer = found.join(step, (F.col("target") == F.col("a")) & ~F.array_contains("path", F.col("b")))
        longer = longer.select("source", F.col("b").alias("target"), (F.col("cost") + F.col("c")).alias("cost"), (F.col("hops") + 1).alias("hops"), (F.col("all_native") & F.col("native")).alias("all_native"), F.concat("path", F.array("b")).alias("path"))
        better = found.unionByName(longer).withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
        found, now = _settled(better)
        if now == mark:
            return found
        mark = now


def attributes(found: DataFrame) -> DataFrame:
    """Routes with ``is_direct`` (one hop) and their steps as text."""
    return found.withColumns({"is_direct": F.col("hops") == 1, "steps": F.array_join("path", " -> ")})


def acyclic(graph: DataFrame) -> bool:
    """Whether no node reaches itself: nodes that nothing leads to are taken away until none is left to take."""
    left, n = checkpointed(graph.select("source", "target").filter("source is not null and target is not null").distinct()), None
    while True:
        now = left.count()
        if not now or now == n:
            return not now
        n = now
        left = left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        left = checkpointed(left)


def plan_jobs(jobs: DataFrame, graph: DataFrame) -> DataFrame:
    """Jobs (source, target, ...) with their routes; cost is null where there is none. The route table, at most nodes squared, is
    broadcast by Spark where it is small."""
    return jobs.join(routes(graph), ["source", "target"], "left")
