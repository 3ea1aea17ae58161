"""Queries of the graph operators on whole tensors, of accounts and of catalogues, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.functions import ops
from tensorloom.functions import tensor_ops as t
from tensorloom.operators import accounts, catalogue, routes, store
from tensorloom.plans import derived
from tensorloom.plans.derived import table


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def weighted(x: Column) -> Column:
    """A sum that tells places apart."""
    return t.total(F.transform(x, lambda v, i: v * (i + 1)))


def signature(x: Column) -> Column:
    return F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v, F.lit(0)))


_X = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"
_Q = "SELECT vec_id, list_transform(embedding, lambda v: CAST(round(CAST(v AS DOUBLE) * 1000) AS BIGINT)) AS q FROM embeddings"


def _sum(of: str) -> str:
    return f"list_sum(list_transform({of}, lambda v, i: v * i))"


def _places(n: int, of: str) -> str:
    return f"list_transform(range({n}), lambda i: {of})"


def pointwise_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators of two values, and those that take a condition, a type or a constant."""
    p, y = F.col("l_quantity") / 10, F.col("l_discount") * 10 + 0.5
    x = p - 2.5
    columns = {k: f(p if k == "Pow" else x, y) for k, f in ops.BINARY.items()}
    columns |= {"Where": t.where(x > y, x, y), "Erf": t.erf(x), "Gelu": t.gelu(x), "Swish": t.swish(x, 1.5), "Cast": t.cast(x, "I32"), "Constant": F.lit(0.25)}
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag").agg(*[F.round(F.sum(v.cast("double")), 4).alias(k) for k, v in columns.items()])


def _pointwise_sql() -> str:
    def erf(x: str) -> str:
        s = f"(1 / (1 + 0.3275911::DOUBLE * abs({x})))"
        poly = f"(((((1.061405429::DOUBLE * {s} - 1.453152027::DOUBLE) * {s}) + 1.421413741::DOUBLE) * {s} - 0.284496736::DOUBLE) * {s} + 0.254829592::DOUBLE) * {s}"
        return f"(sign({x}) * (1 - {poly} * exp(-({x}) * ({x}))))"

    sql = {
        "Add": "x + y", "Sub": "x - y", "Mul": "x * y", "Div": "x / y", "Pow": "pow(p, y)", "Where": "CASE WHEN x > y THEN x ELSE y END",
        "Erf": erf("x"), "Gelu": f"0.5::DOUBLE * x * (1 + {erf('(x / sqrt(2::DOUBLE))')})", "Swish": "x / (1 + exp(-1.5::DOUBLE * x))", "Cast": "trunc(x)", "Constant": "0.25::DOUBLE",
    }
    sums = ", ".join(f'round(sum(CAST({v} AS DOUBLE)), 4) AS "{k}"' for k, v in sql.items())
    return f"WITH r AS (SELECT l_returnflag, l_quantity / 10 AS p, l_quantity / 10 - 2.5::DOUBLE AS x, l_discount * 10 + 0.5::DOUBLE AS y FROM lineitem) SELECT l_returnflag, {sums} FROM r GROUP BY l_returnflag"


def shape_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 64-vector as an 8 x 8 matrix of whole numbers, put into other shapes."""
    q = F.col("q")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double") * 1000).cast("long")).alias("q"))
    wide = t.reshape([8, 8], [4, -1])
    columns = {
        "Reshape": t.slice_(q, tuple(wide), (1, 0), (3, wide[1])), "Flatten": F.slice(q, 1, t.flatten([2, 4, 8], 2)[0]), "Squeeze": F.slice(q, 1, len(t.squeeze([1, 8, 1, 8]))), "Unsqueeze": F.slice(q, 1, len(t.unsqueeze([8, 8], [0, 2]))),
        "Transpose": t.transpose(q, 8, 8), "Slice": t.slice_(q, (8, 8), (1, 2), (7, 8), (2, 3)), "Split": t.split(q, [16, 40, 8])[1], "Concat": t.concat_columns(q, F.slice(q, 1, 16), 8, 8, 2),
        "Gather": t.gather(q, F.array(F.lit(3), F.lit(-1), F.lit(0)), 8), "Tile": t.tile(q, 8, 8, (2, 3)), "Expand": t.expand(F.slice(q, 1, 8), 1, 8, (4, 8)), "Pad": t.pad(q, 8, 8, (1, 2), (0, 1), 7),
    }
    return rows.select("vec_id", *[signature(v.cast("array<long>")).alias(k) for k, v in columns.items()])


def _shape_sql() -> str:
    sql = {
        "Reshape": "q[17:48]", "Flatten": "q[1:8]", "Squeeze": "q[1:2]", "Unsqueeze": "q[1:4]",
        "Transpose": _places(64, "q[i % 8 * 8 + i // 8 + 1]"), "Slice": _places(6, "q[(1 + i // 2 * 2) * 8 + 2 + i % 2 * 3 + 1]"), "Split": "q[17:56]",
        "Concat": _places(80, "CASE WHEN i % 10 < 8 THEN q[i // 10 * 8 + i % 10 + 1] ELSE q[i // 10 * 2 + i % 10 - 8 + 1] END"), "Gather": "list_concat(list_concat(q[25:32], q[57:64]), q[1:8])",
        "Tile": _places(384, "q[i // 24 % 8 * 8 + i % 24 % 8 + 1]"), "Expand": _places(32, "q[i % 8 + 1]"),
        "Pad": _places(99, "CASE WHEN i // 11 BETWEEN 1 AND 8 AND i % 11 BETWEEN 2 AND 9 THEN q[(i // 11 - 1) * 8 + i % 11 - 2 + 1] ELSE 7 END"),
    }
    return f"SELECT vec_id, {', '.join(f'CAST({_sum(v)} AS BIGINT) AS "{k}"' for k, v in sql.items())} FROM ({_Q})"


def image_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an 8 x 8 image; its first values are the kernel."""
    x = F.col("x")
    columns = {
        "Conv2D": t.conv2d(x, 8, 8, F.slice(x, 1, 9), 3), "ConvTranspose2D": t.conv_transpose2d(x, 8, 8, F.slice(x, 1, 4), 2, 2),
        "MaxPool2D": t.max_pool2d(x, 8, 8, 3, 2), "AveragePool2D": t.average_pool2d(x, 8, 8, 2, 2),
    }
    sums = [F.round(weighted(v), 4).alias(k) for k, v in columns.items()]
    return vectors(spark, sf_dir).select("vec_id", *sums, F.round(t.global_average_pool(x), 6).alias("GlobalAveragePool"), t.global_max_pool(x).alias("GlobalMaxPool"), F.round(t.reduce_prod(F.slice(x, 1, 3)) * 1000, 4).alias("ReduceProd"))


def _image_sql() -> str:
    conv = _places(36, "list_sum(list_transform(range(9), lambda k: x[(i // 6 + k // 3) * 8 + i % 6 + k % 3 + 1] * x[k + 1]))")
    spread = _places(256, "x[i // 32 * 8 + i % 16 // 2 + 1] * x[i // 16 % 2 * 2 + i % 2 + 1]")
    most = _places(9, "list_max(list_transform(range(9), lambda k: x[(i // 3 * 2 + k // 3) * 8 + i % 3 * 2 + k % 3 + 1]))")
    mean = _places(16, "list_avg(list_transform(range(4), lambda k: x[(i // 4 * 2 + k // 2) * 8 + i % 4 * 2 + k % 2 + 1]))")
    sums = ", ".join(f'round({_sum(v)}, 4) AS "{k}"' for k, v in (("Conv2D", conv), ("ConvTranspose2D", spread), ("MaxPool2D", most), ("AveragePool2D", mean)))
    return f'SELECT vec_id, {sums}, round(list_avg(x), 6) AS "GlobalAveragePool", list_max(x) AS "GlobalMaxPool", round(x[1] * x[2] * x[3] * 1000, 4) AS "ReduceProd" FROM ({_X})'


def norm_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms over groups and channels of a vector, and over the channels of all vectors."""
    rows = t.batch_norm(vectors(spark, sf_dir), "x", 64, 8, "batch")
    columns = {"GroupNorm": t.group_norm(F.col("x"), 64, 4), "InstanceNorm": t.instance_norm(F.col("x"), 64, 8), "BatchNorm": F.col("batch")}
    return rows.select("vec_id", *[F.round(weighted(v), 3).alias(k) for k, v in columns.items()])


def _norm_sql() -> str:
    def group(n: int) -> str:
        part = f"x[i // {n} * {n} + 1:i // {n} * {n} + {n}]"
        return _places(64, f"(x[i + 1] - list_avg({part})) / sqrt(list_var_pop({part}) + 1e-5)")

    batch = _places(64, "(x[i + 1] - m[i // 8 + 1]) / sqrt(s[i // 8 + 1] + 1e-5)")
    return f"""WITH r AS ({_X}), c AS (SELECT (p - 1) // 8 AS c, avg(v) AS m, var_pop(v) AS s FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS p FROM r) GROUP BY ALL),
a AS (SELECT list(m ORDER BY c) AS m, list(s ORDER BY c) AS s FROM c)
SELECT vec_id, round({_sum(group(16))}, 3) AS "GroupNorm", round({_sum(group(8))}, 3) AS "InstanceNorm", round({_sum(batch)}, 3) AS "BatchNorm" FROM r, a"""


def linear_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer per label: its first four vectors are the weights; also look-ups and experts."""
    rows = vectors(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    first = rows.withColumn("place", place).filter("place <= 4")
    layers = first.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("w"))  # four rows a label
    joined = rows.join(layers, "label")
    looked = rows.select((F.col("vec_id") + 1).alias("at"), "vec_id").join(rows.select(F.col("vec_id").alias("at"), F.col("x").alias("next")), "at", "left").select("vec_id", "next")
    experts = F.array(*[F.struct(F.lit(0.5 * (e + 1)).alias("scale"), F.lit(0.25 * e).alias("shift")) for e in range(4)])
    x = F.col("x")
    out = t.embedding(joined, looked, "vec_id")
    return out.select(
        "vec_id", F.round(weighted(t.linear(x, F.col("w"), F.slice(x, 1, F.size("w")))), 4).alias("Linear"), F.round(F.coalesce(weighted(F.col("next")), F.lit(0.0)), 4).alias("Embedding"),
        F.round(F.when(F.size("w") == 4, weighted(t.mixture_of_experts(x, F.col("w"), experts))), 3).alias("MoeLayer"),
    )


_LINEAR = f"""WITH r AS ({_X}), f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 4),
l AS (SELECT label, list(x ORDER BY vec_id) AS w FROM f GROUP BY label),
d AS (SELECT r.vec_id, x, w, list_transform(w, lambda o: list_dot_product(x, o)) AS d FROM r JOIN l USING (label)),
g AS (SELECT vec_id, x, list_transform(list_sort(list_transform(d, lambda s, e: {{'s': -s, 'e': e}}))[1:2], lambda p: {{'s': -p.s, 'e': p.e}}) AS b FROM d WHERE len(w) = 4),
e AS (SELECT vec_id, x, b, 1 / (1 + exp(b[2].s - b[1].s)) AS p FROM g),
m AS (SELECT vec_id, round({_sum("list_transform(x, lambda v: p * (v * 0.5::DOUBLE * b[1].e + 0.25::DOUBLE * (b[1].e - 1)) + (1 - p) * (v * 0.5::DOUBLE * b[2].e + 0.25::DOUBLE * (b[2].e - 1)))")}, 3) AS v FROM e)
SELECT d.vec_id, round({_sum("list_transform(d, lambda s, j: s + d.x[j])")}, 4) AS "Linear", round(coalesce({_sum("n.x")}, 0), 4) AS "Embedding", m.v AS "MoeLayer"
FROM d LEFT JOIN r n ON n.vec_id = d.vec_id + 1 LEFT JOIN m ON m.vec_id = d.vec_id"""


def gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors' first eight values times a matrix out of eight vectors, plus half of their last values."""
    e = ops.elements(vectors(spark, sf_dir).drop("label"), "x")
    a = e.filter("i < 8").select(F.col("vec_id").alias("r"), F.col("i").alias("k"), F.col("x").alias("v"))
    b = e.filter("vec_id < 8 and i < 4").select(F.col("vec_id").cast("int").alias("k"), F.col("i").alias("c"), F.col("x").alias("v"))
    c = e.filter("i >= 60").select(F.col("vec_id").alias("r"), (F.col("i") - 60).alias("c"), F.col("x").alias("v"))
    out = t.gemm(a, F.broadcast(b), c, 2.0, 0.5)  # 32 rows
    return out.select("r", "c", F.round("v", 5).alias("v"))


_GEMM = f"""WITH e AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM ({_X})),
p AS (SELECT a.vec_id AS r, b.i AS c, sum(a.v * b.v) AS s FROM e a JOIN e b ON a.i = b.vec_id AND a.i < 8 AND b.i < 4 AND b.vec_id < 8 GROUP BY ALL)
SELECT r, CAST(c AS INTEGER) AS c, round(2 * s + 0.5::DOUBLE * coalesce(e.v, 0), 5) AS v FROM p LEFT JOIN e ON e.vec_id = r AND e.i = c + 60"""

_ATTENTION = {"ScaledDotProduct": (1, 1, 64, False, False), "MultiHead": (4, 4, 16, False, True), "GroupedQuery": (4, 2, 16, True, True)}


def attention_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of eight vectors: one head; heads with rotary positions; heads that share keys, with linear biases, causal."""
    rows = vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 8).cast("long").alias("s"), (F.col("vec_id") % 8).cast("int").alias("p"), "x")
    rows = rows.withColumn("turned", t.rotary(F.col("x"), F.col("p"), 64))
    out = None
    for name, (heads, kv, width, causal, rotary) in _ATTENTION.items():
        bias = (lambda h, i, j: t.alibi(h, 4, i, j)) if causal else None
        got = t.attention(rows, "s", "p", "turned" if rotary else "x", "x", "x", width, heads, kv, bias, causal)
        got = got.groupBy("s", "p").agg(F.round(F.sum((F.col("head") + 1) * weighted(F.col("out"))), 3).alias(name))
        out = got if out is None else out.join(got, ["s", "p"])
    return out


def _attention_sql() -> str:
    turned = "CASE WHEN i % 2 = 0 THEN x[i + 1] * cos(a[i + 1]) - x[i + 2] * sin(a[i + 1]) ELSE x[i] * sin(a[i + 1]) + x[i + 1] * cos(a[i + 1]) END"
    parts = []
    for name, (heads, kv, width, causal, rotary) in _ATTENTION.items():
        own = f"h // {heads // kv} * {width}"
        score = f"list_dot_product(a.{'q' if rotary else 'x'}[h * {width} + 1:h * {width} + {width}], b.x[{own} + 1:{own} + {width}]) / {width**0.5}"
        score += " - pow(2, -2.0 * (h + 1)) * abs(a.p - b.p)" if causal else ""
        near = " AND b.p <= a.p" if causal else ""
        parts.append(f"""{name}_ AS (SELECT a.s, a.p, h, {score} AS e, {_sum(f"b.x[{own} + 1:{own} + {width}]")} AS v FROM r a JOIN r b ON a.s = b.s{near}, range({heads}) t(h)),
{name} AS (SELECT s, p, round(sum((h + 1) * w * v), 3) AS v FROM (SELECT s, p, h, v, exp(e) / sum(exp(e)) OVER (PARTITION BY s, p, h) AS w FROM {name}_) GROUP BY ALL)""")
    names = ", ".join(f'{n}.v AS "{n}"' for n in _ATTENTION)
    joins = " ".join(f"JOIN {n} USING (s, p)" for n in list(_ATTENTION)[1:])
    return f"""WITH b AS (SELECT vec_id // 8 AS s, CAST(vec_id % 8 AS INTEGER) AS p, x, {_places(64, "(vec_id % 8) / pow(10000, i // 2 * 2 / 64)")} AS a FROM ({_X})),
r AS (SELECT s, p, x, {_places(64, turned)} AS q FROM b), {", ".join(parts)} SELECT s, p, {names} FROM {next(iter(_ATTENTION))} {joins}"""


# --- accounts, catalogues, stores ----------------------------------------------------------------
def account_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users after sign-ups, log-ins and revocations, per nation."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lower(F.translate("c_name", "#", "")), F.lit("@example.org")).alias("email"), F.col("c_nationkey").alias("nation"))
    signups = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7).alias("user_id"), F.concat(F.lower(F.translate("s_name", "#", "")), F.lit("@example.org")).alias("email"), F.col("s_nationkey").alias("nation"))
    events = table(spark, sf_dir, "events")
    users = accounts.insert(users.withColumn("last_login_at", F.lit(None).cast("timestamp")), signups.withColumn("last_login_at", F.lit(None).cast("timestamp")), ["user_id"])
    users = accounts.logged_in(users, events.select("user_id", F.col("ts").alias("at")))
    tokens = events.select(F.col("event_id").cast("string").alias("token"), "user_id", F.lit(False).alias("revoked"))
    tokens = accounts.revoked(accounts.issued(tokens), events.filter("event_id % 3 = 0").select(F.sha2(F.col("event_id").cast("string"), 256).alias("token_hash")))
    live = tokens.filter("not revoked").groupBy("user_id").agg(F.count("*").alias("live"))
    joined = users.join(live, "user_id", "left")
    return joined.groupBy("nation").agg(F.count("*").alias("users"), F.count("last_login_at").alias("seen"), F.max("last_login_at").alias("last"), F.sum(F.coalesce("live", F.lit(0))).cast("long").alias("live"), F.countDistinct("email").alias("emails"))


_ACCOUNTS = """WITH u AS (SELECT c_custkey AS user_id, lower(replace(c_name, '#', '')) AS email, c_nationkey AS nation FROM customer
  UNION ALL SELECT s_suppkey * 7, lower(replace(s_name, '#', '')), s_nationkey FROM supplier WHERE s_suppkey * 7 NOT IN (SELECT c_custkey FROM customer)),
l AS (SELECT user_id, max(ts) AS moment, count(*) FILTER (event_id % 3 != 0) AS live FROM events GROUP BY user_id)
SELECT nation, count(*) AS users, count(moment) AS seen, max(moment) AS last, CAST(coalesce(sum(live), 0) AS BIGINT) AS live, count(DISTINCT email) AS emails FROM u LEFT JOIN l USING (user_id) GROUP BY nation"""


def account_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and jobs asked for by key: owners of jobs, and whether the asker is one."""
    jobs = derived.jobs(spark, sf_dir)
    asked = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("job_id"), (F.col("l_orderkey") % 10).alias("user_id"))
    return accounts.owners(jobs, asked).groupBy("status").agg(F.count("*").alias("asked"), F.sum(F.col("own").cast("long")).alias("own"), F.countDistinct("owner").alias("owners"))


_LOOKUPS = """SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'queued' END AS status, count(*) AS asked, CAST(count(*) FILTER (o_custkey = l_orderkey % 10) AS BIGINT) AS own, count(DISTINCT o_custkey) AS owners
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1 GROUP BY ALL"""


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of finished jobs that their owners may fetch."""
    jobs = derived.jobs(spark, sf_dir).withColumn("output_path", F.concat(F.lit("/out/"), F.col("job_id").cast("string"), F.lit("."), F.lower("target")))
    return accounts.downloads(jobs).groupBy("user_id").agg(F.count("*").alias("files"), F.max("output_path").alias("last"))


def _downloads_sql() -> str:
    names = ", ".join(f"'{n}'" for n in derived.NODES)
    return f"""SELECT o_custkey AS user_id, count(*) AS files, max('/out/' || o_orderkey || '.' || lower(([{names}])[o_custkey % {len(derived.NODES)} + 1])) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL"""


def format_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs per format of the catalogue, with what it can do and whether a direct edge leads there."""
    graph = routes.edges(spark)
    jobs = derived.jobs(spark, sf_dir).withColumn("direct", F.lit(1))
    direct = jobs.join(F.broadcast(routes.edges_from(graph).select("source", "target").withColumn("edge", F.lit(True))), ["source", "target"], "left")
    counts = direct.groupBy(F.col("target").alias("name")).agg(F.count("*").alias("jobs"), F.count("edge").alias("direct"))
    formats = catalogue.formats(spark).select("slug", "name", "can_read", "can_write", "native", F.size("extensions").alias("extensions"))
    return formats.join(counts, "name", "left").withColumns({"jobs": F.coalesce("jobs", F.lit(0)), "direct": F.coalesce("direct", F.lit(0))})


def _catalogue_sql() -> str:
    names = ", ".join(f"'{n}'" for n in derived.NODES)
    rows = ", ".join(f"('{s}', '{n}', {str(r).lower()}, {str(w).lower()}, {str(v).lower()}, {len(e)})" for s, n, r, w, v, e, _ in catalogue.FORMATS)
    edges = ", ".join(f"('{a}', '{b}')" for a, b, _, _ in routes.EDGES)
    at = f"([{names}])"
    return f"""WITH f(slug, name, can_read, can_write, native, extensions) AS (VALUES {rows}), e(s, d) AS (VALUES {edges}),
j AS (SELECT {at}[o_orderkey % {len(derived.NODES)} + 1] AS s, {at}[o_custkey % {len(derived.NODES)} + 1] AS d FROM orders)
SELECT f.*, coalesce(n, 0) AS jobs, coalesce(k, 0) AS direct FROM f LEFT JOIN (SELECT d AS name, count(*) AS n, count(*) FILTER ((s, d) IN (SELECT (s, d) FROM e)) AS k FROM j GROUP BY d) USING (name)"""


def model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspection of each model as one JSON document (its first tensors only), and its bytes in memory."""
    return store.inspect_json(derived.tensors(spark, sf_dir), 3)


_JSON = """WITH o AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
p AS (SELECT label, CASE WHEN (vec_id + label) % 3 = 0 THEN (['F16', 'BF16', 'Q4_0', 'F32'])[vec_id % 4 + 1] WHEN label % 2 = 0 THEN 'Q4_K_M' ELSE 'Q8_0' END AS t, vec_id, n FROM o)
SELECT label AS model_id, '{"tensor_count":' || count(*) || ',"parameters":' || count(*) * 64 || ',"tensors":[' || string_agg('{"name":"layers.' || vec_id || '.weight","dtype":"' || t || '","shape":[8,8],"num_elements":64}', ',' ORDER BY vec_id) FILTER (n <= 3) || ']}' AS json,
  count(*) * 256 / 1048576 AS mib FROM p GROUP BY label"""


def extension_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values set under namespaced keys until a user's store is full: what stays, and its bytes."""
    key = F.concat(F.lit("fmt"), (F.col("event_id") % 5).cast("string"), F.lit("@1/"), F.col("event_type"))
    writes = table(spark, sf_dir, "events").select(F.col("user_id").alias("model_id"), F.col("event_id").alias("seq"), key.alias("key"), F.col("props").alias("value"))
    return store.extension_writes(writes, 200)


_STORE = """WITH RECURSIVE w AS (SELECT user_id, event_id, 'fmt' || event_id % 5 AS f, event_type AS p, strlen(props) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM events),
s(user_id, o, total, kept) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), MAP {}::MAP(VARCHAR, BIGINT) FROM w
  UNION ALL SELECT s.user_id, w.o, CASE WHEN total + n > 200 THEN total ELSE total - coalesce(kept[f || '/' || p], 0) + n END, CASE WHEN total + n > 200 THEN kept ELSE map_concat(kept, MAP {f || '/' || p: n}) END
  FROM s JOIN w ON w.user_id = s.user_id AND w.o = s.o + 1)
SELECT user_id AS model_id, CAST(len(map_keys(kept)) AS INTEGER) AS entries, total AS total_bytes FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY o DESC) = 1"""


QUERIES: dict[Callable[[SparkSession, str], DataFrame], str] = {
    pointwise_ops: _pointwise_sql(), shape_ops: _shape_sql(), image_ops: _image_sql(), norm_ops: _norm_sql(), linear_ops: _LINEAR, gemm: _GEMM, attention_ops: _attention_sql(),
    account_writes: _ACCOUNTS, account_lookups: _LOOKUPS, downloads: _downloads_sql(), format_catalogue: _catalogue_sql(), model_json: _JSON, extension_store: _STORE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {q.__name__: sql for q, sql in QUERIES.items()}
