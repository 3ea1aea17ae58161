"""Graph operators on whole tensors held as arrays in row-major order.

Shapes are known when the plan is built, as they are in a graph; the arrays' values stay in Catalyst as
higher-order functions, so no element becomes a row and nothing is shuffled.  Operators that mix rows
(batch statistics, attention, experts, look-ups) are joins, windows and aggregations of such rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ops import sigmoid


def places(n: int) -> Column:
    """0 to n - 1."""
    return F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")


def by_place(n: int, value: Callable[[Column], Column]) -> Column:
    return F.transform(places(n), value)


def quotient(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where lambdas in it would compute it for each element."""
    return F.get(F.transform(F.array(value), body), 0)


# --- pointwise ----------------------------------------------------------------------------------
def erf(x: Column) -> Column:
    """Error function by the five-term rational approximation of Hastings; within 1.5e-7."""
    # fixed values of that approximation
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + p * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def swish(x: Column, beta: float = 1.0) -> Column:
    return x * sigmoid(beta * x)


def where(condition: Column, a: Column, b: Column) -> Column:
    """``a`` where the condition holds, else ``b``, also where it is null."""
    return F.when(condition, a).otherwise(b)


#: Element types and the Spark types that hold them.
CASTS = {"F64": "double", "F32": "float", "I64": "long", "I32": "int", "I16": "smallint", "I8": "tinyint", "BOOL": "boolean"}


def cast(x: Column, to: str) -> Column:
    """Null where the value doesn't fit the type."""
    return x.try_cast(CASTS[to])


def reduce_prod(x: Column) -> Column:
    """Product of an array, as an aggregate of its rows' logarithms would lose signs and zeros."""
    return F.aggregate(x, F.lit(1.0), lambda a, v: a * v.cast("double"))


# --- shapes -------------------------------------------------------------------------------------
def reshape(shape: list[int], to: list[int]) -> list[int]:
    """The new shape, with one -1 filled in; data in row-major order stays as it is."""
    n = math.prod(shape)
    known = math.prod(d for d in to if d != -1)
    if to.count(-1) > 1 or (-1 in to and (not known or n % known)) or (-1 not in to and known != n):
        raise ValueError(f"{shape} doesn't go into {to}")
    return [n // known if d == -1 else d for d in to]


def flatten(shape: list[int], axis: int = 1) -> list[int]:
    return [math.prod(shape[:axis]), math.prod(shape[axis:])]


def squeeze(shape: list[int], axes: list[int] | None = None) -> list[int]:
    if axes is not None and any(shape[a] != 1 for a in axes):
        raise ValueError("only axes of size 1 go")
    gone = {a % len(shape) for a in axes} if axes is not None else {i for i, d in enumerate(shape) if d == 1}
    return [d for i, d in enumerate(shape) if i not in gone]


def unsqueeze(shape: list[int], axes: list[int]) -> list[int]:
    out = list(shape)
    for a in sorted(axes):
        out.insert(a, 1)
    return out


def transpose(x: Column, rows: int, columns: int) -> Column:
    return by_place(rows * columns, lambda i: F.get(x, (i % rows) * columns + quotient(i, rows)))


def slice_(x: Column, shape: tuple[int, int], begins: tuple[int, int], ends: tuple[int, int], steps: tuple[int, int] = (1, 1)) -> Column:
    """Rows and columns from ``begins`` to before ``ends``, every ``steps``-th."""
    n, m = (len(range(b, e, s)) for b, e, s in zip(begins, ends, steps, strict=True))
    return by_place(n * m, lambda i: F.get(x, (begins[0] + quotient(i, m) * steps[0]) * shape[1] + begins[1] + (i % m) * steps[1]))


def split(x: Column, sizes: list[int]) -> list[Column]:
    """Consecutive pieces of the given sizes along the first axis of row-major data."""
    at = [sum(sizes[:k]) for k in range(len(sizes))]
    return [F.slice(x, a + 1, n) for a, n in zip(at, sizes, strict=True)]


def concat_columns(a: Column, b: Column, rows: int, wide: int, wide_b: int) -> Column:
    """Two matrices side by side."""
    m = wide + wide_b
    return by_place(rows * m, lambda i: F.when(i % m < wide, F.get(a, quotient(i, m) * wide + i % m)).otherwise(F.get(b, quotient(i, m) * wide_b + i % m - wide)))


def gather(x: Column, indices: Column, columns: int) -> Column:
    """Rows of a matrix by index; negative ones count from the end, those outside give nulls."""
    n = F.floor(F.size(x) / columns).cast("int")
    each = F.transform(indices, lambda r: F.transform(places(columns), lambda c: F.get(x, F.when(r < 0, r + n).otherwise(r) * columns + c)))
    return F.flatten(each)


def tile(x: Column, rows: int, columns: int, times: tuple[int, int]) -> Column:
    m = columns * times[1]
    return by_place(rows * times[0] * m, lambda i: F.get(x, (quotient(i, m) % rows) * columns + i % m % columns))


def expand(x: Column, rows: int, columns: int, to: tuple[int, int]) -> Column:
    """An axis of size 1 is repeated; other sizes must agree."""
    if any(a not in (1, b) for a, b in zip((rows, columns), to, strict=True)):
        raise ValueError("only axes of size 1 expand")
    return by_place(to[0] * to[1], lambda i: F.get(x, (F.lit(0) if rows == 1 else quotient(i, to[1]) * columns) + (F.lit(0) if columns == 1 else i % to[1])))


def pad(x: Column, rows: int, columns: int, before: tuple[int, int], after: tuple[int, int], value: float = 0.0) -> Column:
    m = before[1] + columns + after[1]

    def at(i: Column) -> Column:
        r, c = quotient(i, m) - before[0], i % m - before[1]
        inside = (r >= 0) & (r < rows) & (c >= 0) & (c < columns)
        return F.when(inside, F.get(x, r * columns + c)).otherwise(F.lit(value))

    return by_place((before[0] + rows + after[0]) * m, at)


# --- images -------------------------------------------------------------------------------------
def _window(height: int, width: int, size: int, stride: int) -> tuple[int, int]:
    return (height - size) // stride + 1, (width - size) // stride + 1


def _taps(x: Column, i: Column, columns: int, width: int, size: int, stride: int) -> list[Column]:
    top, left = quotient(i, columns) * stride, i % columns * stride
    return [F.get(x, (top + a) * width + left + b).cast("double") for a in range(size) for b in range(size)]


def conv2d(x: Column, height: int, width: int, kernel: Column, size: int, stride: int = 1) -> Column:
    """Cross-correlation of one channel with a square kernel, no padding (see :func:`pad`)."""
    rows, columns = _window(height, width, size, stride)
    return by_place(rows * columns, lambda i: sum(t * F.get(kernel, k).cast("double") for k, t in enumerate(_taps(x, i, columns, width, size, stride))))


def conv_transpose2d(x: Column, height: int, width: int, kernel: Column, size: int, stride: int = 1) -> Column:
    """The adjoint of :func:`conv2d`: each input spreads the kernel over the output."""
    rows, columns = (height - 1) * stride + size, (width - 1) * stride + size

    def at(i: Column) -> Column:
        out = F.lit(0.0)
        for a in range(size):
            for b in range(size):
                r, c = quotient(i, columns) - a, i % columns - b
                there = (r >= 0) & (c >= 0) & (r % stride == 0) & (c % stride == 0) & (r < height * stride) & (c < width * stride)
                out = out + F.when(there, F.get(x, quotient(r, stride) * width + quotient(c, stride)).cast("double") * F.get(kernel, a * size + b).cast("double")).otherwise(0.0)
        return out

    return by_place(rows * columns, at)


def max_pool2d(x: Column, height: int, width: int, size: int, stride: int) -> Column:
    rows, columns = _window(height, width, size, stride)
    return by_place(rows * columns, lambda i: F.greatest(*_taps(x, i, columns, width, size, stride)))


def average_pool2d(x: Column, height: int, width: int, size: int, stride: int) -> Column:
    rows, columns = _window(height, width, size, stride)
    return by_place(rows * columns, lambda i: sum(_taps(x, i, columns, width, size, stride)) / (size * size))


def global_average_pool(x: Column) -> Column:
    return total(x) / F.size(x)


def global_max_pool(x: Column) -> Column:
    return F.array_max(x)


# --- linear algebra -----------------------------------------------------------------------------
def linear(x: Column, weights: Column, bias: Column) -> Column:
    """x W' + b: ``weights`` is an array of output rows."""
    return F.zip_with(F.transform(weights, lambda row: dot(x, row)), bias, lambda v, b: v + b.cast("double"))


def gemm(a: DataFrame, b: DataFrame, c: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha A B + beta C of (r, k, v), (k, c, v) and (r, c, v) rows; what C lacks counts as 0."""
    product = a.alias("a").join(b.alias("b"), "k").groupBy("r", "c").agg((alpha * F.sum(F.col("a.v") * F.col("b.v"))).alias("p"))
    return product.join(c.select("r", "c", "v"), ["r", "c"], "left").select("r", "c", (F.col("p") + beta * F.coalesce("v", F.lit(0.0))).alias("v"))


def embedding(ids: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Vectors of ids: an equi-join; ids that the table lacks keep a null vector."""
    return ids.join(table, on, "left")


# --- norms --------------------------------------------------------------------------------------
def _normal(x: Column, mean: Column, variance: Column, eps: float) -> Column:
    return F.transform(x, lambda v: (v.cast("double") - mean) / F.sqrt(variance + eps))


def group_norm(x: Column, n: int, groups: int, eps: float = 1e-5) -> Column:
    """Each of ``groups`` equal stretches of n values gets mean 0 and variance 1."""
    def normal(part: Column) -> Column:
        def of(mean: Column) -> Column:
            variance = total(F.transform(part, lambda v: (v.cast("double") - mean) * (v.cast("double") - mean))) / F.size(part)
            return let(variance, lambda var: _normal(part, mean, var, eps))

        return let(total(part) / F.size(part), of)

    each = by_place(groups, lambda g: F.slice(x, g * (n // groups) + 1, F.lit(n // groups)))
    return F.flatten(F.transform(each, normal))


def instance_norm(x: Column, n: int, channels: int, eps: float = 1e-5) -> Column:
    """A group per channel."""
    return group_norm(x, n, channels, eps)


def batch_norm(rows: DataFrame, x: str, n: int, channels: int, out: str = "norm", eps: float = 1e-5) -> DataFrame:
    """Each channel gets mean 0 and variance 1 over all rows.

    The statistics are one aggregate row of 2 * channels numbers, combined in tasks before it is sent on.
    """
    size = n // channels
    parts = [F.slice(F.col(x), c * size + 1, size) for c in range(channels)]
    sums = [F.sum(total(p)).alias(f"s{c}") for c, p in enumerate(parts)] + [F.sum(dot(p, p)).alias(f"q{c}") for c, p in enumerate(parts)]
    stats = rows.agg(F.count("*").alias("rows"), *sums)
    m = F.col("rows") * size
    means = F.array(*[F.col(f"s{c}") / m for c in range(channels)]).alias("_mean")
    squares = F.array(*[F.col(f"q{c}") / m for c in range(channels)]).alias("_square")
    joined = rows.join(F.broadcast(stats.select(means, squares)), how="cross")  # one row
    mean, square = (lambda i, k=k: F.get(k, quotient(i, size)) for k in ("_mean", "_square"))
    value = F.transform(F.col(x), lambda v, i: (v.cast("double") - mean(i)) / F.sqrt(square(i) - mean(i) * mean(i) + eps))
    return joined.withColumn(out, value).drop("_mean", "_square")


# --- attention ----------------------------------------------------------------------------------
def rotary(x: Column, position: Column, n: int, base: float = 10000.0) -> Column:
    """Pairs (2k, 2k + 1) of n values turned by position / base ** (2k / n)."""

    def turned(i: Column) -> Column:
        k = quotient(i, 2) * 2
        angle = position / F.pow(F.lit(base), k / n)
        a, b = F.get(x, k).cast("double"), F.get(x, k + 1).cast("double")
        return F.when(i % 2 == 0, a * F.cos(angle) - b * F.sin(angle)).otherwise(a * F.sin(angle) + b * F.cos(angle))

    return by_place(n, turned)


def alibi(head: Column, heads: int, query: Column, key: Column) -> Column:
    """Penalty of distance: the slopes of the heads are powers of 2 ** (-8 / heads)."""
    return -F.pow(F.lit(2.0), -8.0 * (head + 1) / heads) * F.abs(query - key)


def attention(tokens: DataFrame, sequence: str, position: str, q: str, k: str, v: str, width: int, heads: int = 1, kv_heads: int | None = None, bias: Callable[[Column, Column, Column], Column] | None = None, causal: bool = False) -> DataFrame:
    """(sequence, position, head, out): scaled dot-product attention of each head of each token.

    ``q`` holds ``heads`` stretches of ``width`` values, ``k`` and ``v`` hold ``kv_heads`` (by default as
    many), each of which serves heads / kv_heads heads in a row.  One equi-join on the sequence, then one
    window over a query's keys; ``bias`` (head, query position, key position) is added to the scores.
    """
    share = heads // (kv_heads or heads)
    queries = tokens.select(sequence, F.col(position).alias("_i"), F.posexplode(by_place(heads, lambda h: F.slice(F.col(q), h * width + 1, F.lit(width)))).alias("head", "_q"))
    keys = tokens.select(sequence, F.col(position).alias("_j"), F.col(k).alias("_k"), F.col(v).alias("_v"))
    own = quotient(F.col("head"), share) * width + 1
    met = queries.join(keys, sequence).withColumns({"_k": F.slice("_k", own, F.lit(width)), "_v": F.slice("_v", own, F.lit(width))})
    met = met.filter(F.col("_j") <= F.col("_i")) if causal else met
    score = dot(F.col("_q"), F.col("_k")) / math.sqrt(width)
    score = score + bias(F.col("head"), F.col("_i"), F.col("_j")) if bias else score
    here = Window.partitionBy(sequence, "_i", "head")
    met = met.withColumn("_s", score).withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(here)))
    weight = F.col("_e") / F.sum("_e").over(here)
    met = met.withColumn("_w", weight)
    sums = F.array(*[F.sum(F.col("_w") * F.get("_v", d).cast("double")) for d in range(width)])
    return met.groupBy(sequence, F.col("_i").alias(position), "head").agg(sums.alias("out"))


def mixture_of_experts(x: Column, gate: Column, experts: Column, k: int = 2) -> Column:
    """The k experts of highest gate score (ties to the first), weighted by the softmax of these scores.

    ``gate`` has a row of weights for each expert, ``experts`` a scale and a shift for each.
    """
    scored = F.transform(gate, lambda row, e: F.struct((-dot(x, row)).alias("s"), e.alias("e")))

    def mixed(best: Column) -> Column:
        raised = F.transform(best, lambda b: F.exp(-b["s"] + best[0]["s"]))
        sum_ = F.aggregate(raised, F.lit(0.0), lambda a, r: a + r)
        weights = F.zip_with(raised, best, lambda r, b: F.struct((r / sum_).alias("p"), experts[b["e"]]["scale"].alias("scale"), experts[b["e"]]["shift"].alias("shift")))
        return let(weights, lambda w: F.transform(x, lambda v: F.aggregate(w, F.lit(0.0), lambda a, b: a + b["p"] * (v.cast("double") * b["scale"] + b["shift"]))))

    return let(F.slice(F.array_sort(scored), 1, k), mixed)
