"""Graph operators as Spark expressions: a table of elementwise functions, reductions and row-wise norms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


ELEMENTWISE: dict[str, Callable[[Column], Column]] = {
    "Sqrt": F.sqrt, "Rsqrt": lambda x: 1 / F.sqrt(x), "Abs": F.abs, "Neg": lambda x: -x, "Exp": F.exp, "Log": F.ln, "Tanh": F.tanh, "Sigmoid": sigmoid,
    "Sign": F.signum, "Ceil": lambda x: F.ceil(x).cast("double"), "Floor": lambda x: F.floor(x).cast("double"), "Round": F.rint,
    "Relu": lambda x: F.greatest(x, F.lit(0.0)), "Relu6": lambda x: clip(x, 0.0, 6.0), "LeakyRelu": lambda x: F.when(x < 0, x * 0.01).otherwise(x),
    "GeluApprox": lambda x: 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))), "Silu": lambda x: x * sigmoid(x), "QuickGelu": lambda x: x * sigmoid(1.702 * x),
    "HardSwish": lambda x: x * clip(x + 3, 0.0, 6.0) / 6, "HardSigmoid": lambda x: clip(x / 6 + 0.5, 0.0, 1.0), "Mish": lambda x: x * F.tanh(F.ln(1 + F.exp(x))),
    "Elu": lambda x: F.when(x < 0, F.exp(x) - 1).otherwise(x), "Identity": lambda x: x, "Dropout": lambda x: x, "Clip": lambda x: clip(x, -1.0, 1.0),
}

BINARY: dict[str, Callable[[Column, Column], Column]] = {"Add": lambda a, b: a + b, "Sub": lambda a, b: a - b, "Mul": lambda a, b: a * b, "Div": lambda a, b: a / b, "Pow": F.pow}

REDUCE: dict[str, Callable[[Column], Column]] = {"ReduceSum": F.sum, "ReduceMean": F.avg, "ReduceMax": F.max, "ReduceMin": F.min}


def softmax(rows: DataFrame, keys: list[str], x: str, out: str = "softmax", log: bool = False) -> DataFrame:
    w = Window.partitionBy(*keys)
    shifted = rows.withColumn("_s", F.col(x) - F.max(x).over(w))
    total = F.sum(F.exp("_s")).over(w)
    return shifted.withColumn(out, F.col("_s") - F.ln(total) if log else F.exp("_s") / total).drop("_s")


def layer_norm(rows: DataFrame, keys: list[str], x: str, out: str = "norm", eps: float = 1e-5) -> DataFrame:
    w = Window.partitionBy(*keys)
    return rows.withColumn(out, (F.col(x) - F.avg(x).over(w)) / F.sqrt(F.var_pop(x).over(w) + eps))


def rms_norm(rows: DataFrame, keys: list[str], x: str, out: str = "norm", eps: float = 1e-6) -> DataFrame:
    return rows.withColumn(out, F.col(x) / F.sqrt(F.avg(F.col(x) * F.col(x)).over(Window.partitionBy(*keys)) + eps))


def top_k(rows: DataFrame, keys: list[str], x: str, index: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(x), index)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def arg_extremes(rows: DataFrame, keys: list[str], x: str, index: str) -> DataFrame:
    """First index of the greatest and of the least value."""
    return rows.groupBy(*keys).agg(F.min_by(index, F.struct(-F.col(x), F.col(index))).alias("argmax"), F.min_by(index, F.struct(F.col(x), F.col(index))).alias("argmin"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(r, c, v) of a (r, k, v) times b (k, c, v): one equi-join, one sum."""
    return a.alias("a").join(b.alias("b"), "k").groupBy("r", "c").agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v"))


def elements(tensors: DataFrame, data: str = "data") -> DataFrame:
    """A row per element, for operators that reduce at once."""
    return tensors.select(*[c for c in tensors.columns if c != data], F.posexplode(data).alias("i", "x"))
