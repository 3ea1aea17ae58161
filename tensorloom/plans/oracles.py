"""The registered queries in SQL for DuckDB, over the same tables."""

from __future__ import annotations

from tensorloom.functions.dtypes import DTYPES, GGML
from tensorloom.operators.routes import EDGES
from tensorloom.plans.derived import ARCHITECTURE, EXTENSIONS, HEADS, NODES, READERS, WRITERS


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_EDGES = "edges(source, target, cost, native) AS (VALUES " + ", ".join(f"('{s}', '{t}', CAST({c} AS DOUBLE), {n})" for s, t, c, n in EDGES) + ")"
_JOBS = f"""jobs AS (SELECT o_orderkey AS job_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'queued' END AS status,
  o_orderdate AS created_at, {_list(NODES)}[o_orderkey % {len(NODES)} + 1] AS source, {_list(NODES)}[o_custkey % {len(NODES)} + 1] AS target FROM orders)"""
_TENSORS = """tensors AS (SELECT label AS model_id, vec_id AS ordinal, 'layers.' || vec_id || '.weight' AS name, 64 AS elements,
  CASE WHEN (vec_id + label) % 3 = 0 THEN ['F16', 'BF16', 'Q4_0', 'F32'][vec_id % 4 + 1] WHEN label % 2 = 0 THEN 'Q4_K_M' ELSE 'Q8_0' END AS dtype, embedding AS data FROM embeddings)"""
_AFTER = """after AS (SELECT model_id, name, CASE WHEN ordinal % 7 = 0 THEN 64 WHEN ordinal % 13 = 0 THEN 32 ELSE 64 END AS elements, CASE WHEN ordinal % 5 = 0 THEN 'F16' ELSE dtype END AS dtype,
  list_transform(data, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) / 1024 AS FLOAT)) AS data FROM tensors WHERE NOT (model_id % 2 = 0 AND ordinal % 11 = 0))"""
_SIZES = "sizes(dtype, per) AS (VALUES " + ", ".join(f"('{k}', {v[0]})" for k, v in DTYPES.items()) + ")"
_NUMERIC = """d AS (SELECT t.model_id, t.name, list_transform(list_zip(t.data, a.data), lambda z: abs(CAST(z[1] - z[2] AS FLOAT))) AS d FROM tensors t JOIN after a USING (model_id, name)),
  numeric AS (SELECT model_id, name, len(d) AS n, CAST(list_max(d) AS DOUBLE) AS max_abs, list_sum(list_transform(d, lambda v: CAST(v AS DOUBLE))) / len(d) AS mean_abs FROM d)"""
_STRUCT = """structure AS (SELECT model_id, count(*) AS tensors_before, count(*) FILTER (a.name IS NULL) AS missing, count(*) FILTER (a.elements != t.elements) AS shape_mismatches,
  count(*) FILTER (a.dtype != t.dtype) AS dtype_changes, count(a.name) AS tensors_after FROM tensors t LEFT JOIN after a USING (model_id, name) GROUP BY model_id)"""
_ADAPTERS = """adapters AS (SELECT l_suppkey % 20 AS model_id, l_orderkey * 10 + l_linenumber AS seq,
  'base_model.model.layers.' || (l_partkey % 50) || '.attn.' || ['lora_A', 'lora_B', 'lora_a', 'bias'][l_linenumber % 4 + 1] || '.weight' AS key FROM lineitem)"""
_META = "meta AS (SELECT user_id % 200 AS model_id, CASE WHEN event_id % 2 = 0 THEN 'phi.' ELSE 'llama.' END || event_type AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events)"
_PROGRESS = """p AS (SELECT event_id, ts, user_id AS job_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
  CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'error' THEN 0.0::DOUBLE ELSE (floor(abs(value)) % 100) / 100::DOUBLE * 0.95::DOUBLE END AS progress FROM events)"""
_ELEMENTS = "e AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"

_ST_LIKE = "k IN (6, 7)"
_SCORES = f"""
  [CASE WHEN k = 0 THEN 0.99 WHEN ext = 'gguf' THEN 0.7 ELSE 0 END, CASE WHEN k = 1 THEN 0.99 WHEN ext = 'bin' THEN 0.2 ELSE 0 END, CASE WHEN k = 2 THEN 0.99 WHEN ext = 'tflite' THEN 0.75 ELSE 0 END,
   CASE WHEN k = 3 AND ext = 'h5' THEN 0.99 WHEN k = 3 THEN 0.85 ELSE 0 END, CASE WHEN k = 4 AND ext = 'onnx' THEN 0.95 WHEN k = 4 THEN 0.5 WHEN ext = 'onnx' THEN 0.8 ELSE 0 END,
   CASE WHEN k = 5 AND ext IN ('pt', 'bin') THEN 0.9 WHEN k = 5 THEN 0.4 WHEN ext IN ('pt', 'bin') THEN 0.55 ELSE 0 END, CASE WHEN ext = 'model' THEN 0.75 ELSE 0 END,
   CASE WHEN k = 7 OR ({_ST_LIKE} AND contains(head, 'scales') AND contains(head, 'zeros')) THEN 0.95 ELSE 0 END, CASE WHEN k = 7 THEN 0.95 ELSE 0 END, 0,
   CASE WHEN {_ST_LIKE} THEN 0.99 WHEN ext = 'safetensors' THEN 0.75 ELSE 0 END, 0]"""

#: Bytes 5 to 8 of a file known by its name only, as a little-endian number out of the head's hex digits.
_HEX = "(" + _list([h.hex().upper() for h in HEADS]) + "[doc_id % 9 + 1] || hex(encode(left(text, 100))))"
_VERSION = "CASE WHEN length(h) >= 16 THEN 'v' || CAST(list_sum(list_transform(range(0, 8), lambda i: (instr('0123456789ABCDEF', substr(h, 9 + i, 1)) - 1) * 16 ** [1, 0, 3, 2, 5, 4, 7, 6][i + 1])) AS BIGINT) END"

_DETECT = f"""
WITH f AS (SELECT doc_id, doc_id % 9 AS k, {_list(EXTENSIONS)}[doc_id // 9 % 10 + 1] AS ext, left(text, 100) AS head, {_HEX} AS h FROM documents),
s AS (SELECT doc_id, k, {_SCORES} AS scores FROM f),
r AS (SELECT doc_id, k, unnest(['GGUF', 'GGML', 'TFLite', 'KerasH5', 'ONNX', 'PyTorch', 'SentencePiece', 'AWQ', 'GPTQ', 'LoRA', 'SafeTensors', 'Diffusers']) AS format,
  unnest(scores) AS score, unnest([1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 1, 3]) AS prio, unnest(range(0, 12)) AS reg FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, prio, reg) AS place FROM r WHERE score > 0),
w AS (SELECT doc_id, any_value(k) AS k, max(format) FILTER (place = 1) AS format, max(score) FILTER (place = 1) AS confidence, max(prio) FILTER (place = 1) AS prio,
  max(format) FILTER (place = 2) AS runner_up, max(score) FILTER (place = 2) AS second FROM o GROUP BY doc_id)
SELECT f.doc_id, w.format, CAST(confidence AS DOUBLE) AS confidence, CASE prio WHEN 1 THEN 'MagicBytes' WHEN 2 THEN 'HeaderStructure' END AS method,
  CASE w.format WHEN 'GGUF' THEN CASE WHEN f.k = 0 THEN 'v3' ELSE {_VERSION} END WHEN 'TFLite' THEN CASE WHEN f.k = 2 THEN 'TFL3' END WHEN 'SafeTensors' THEN '1.0' WHEN 'AWQ' THEN 'AWQ-4bit' WHEN 'GPTQ' THEN 'GPTQ-4bit' END AS version,
  runner_up, coalesce(round(confidence - second, 6) < 0.1, false) AS ambiguous
FROM f LEFT JOIN w USING (doc_id)
"""


def _elementwise() -> str:
    sigmoid = "(1 / (1 + exp(-x)))"
    clip6 = "least(greatest(x + 3, 0), 6)"
    sql = {
        "Sqrt": "sqrt(p)", "Rsqrt": "1 / sqrt(p)", "Abs": "abs(x)", "Neg": "-x", "Exp": "exp(x)", "Log": "ln(p)", "Tanh": "tanh(x)", "Sigmoid": sigmoid, "Sign": "sign(x)", "Ceil": "ceil(x)", "Floor": "floor(x)",
        "Round": "round_even(x, 0)", "Relu": "greatest(x, 0)", "Relu6": "least(greatest(x, 0), 6)", "LeakyRelu": "CASE WHEN x < 0 THEN x * 0.01::DOUBLE ELSE x END",
        "GeluApprox": "0.5 * x * (1 + tanh(0.7978845608028654::DOUBLE * (x + 0.044715::DOUBLE * x * x * x)))", "Silu": f"x * {sigmoid}", "QuickGelu": "x / (1 + exp(-(1.702::DOUBLE * x)))", "HardSwish": f"x * {clip6} / 6",
        "HardSigmoid": "least(greatest(x / 6 + 0.5, 0), 1)", "Mish": "x * tanh(ln(1 + exp(x)))", "Elu": "CASE WHEN x < 0 THEN exp(x) - 1 ELSE x END", "Identity": "x", "Dropout": "x", "Clip": "least(greatest(x, -1), 1)",
    }
    return f"""WITH r AS (SELECT l_returnflag, l_quantity / 10 AS p, l_quantity / 10 - 2.5::DOUBLE AS x FROM lineitem)
SELECT l_returnflag, {", ".join(f'round(sum(CAST({v} AS DOUBLE)), 4) AS "{k}"' for k, v in sql.items())} FROM r GROUP BY l_returnflag"""


def _architecture() -> str:
    columns = [f"coalesce({', '.join(f'''max(value) FILTER (key = '{k}')''' for k in keys)}, 0) AS {field}" for field, keys in ARCHITECTURE.items()]
    wanted = ", ".join(f"'{k}'" for keys in ARCHITECTURE.values() for k in keys)
    return f"WITH {_META} SELECT model_id, {', '.join(columns)} FROM meta WHERE key IN ({wanted}) GROUP BY model_id"


def oracle_sql() -> dict[str, str]:
    pairs = ", ".join(f"('{r}', '{w}')" for r in READERS for w in WRITERS if r != w)
    ggml = ", ".join(f"({k}, '{v[0]}', {v[1]}, {v[2]})" for k, v in GGML.items())
    history = f"WITH {_JOBS} SELECT job_id, user_id, status FROM jobs ORDER BY created_at DESC, job_id LIMIT 200"
    return {
        "detection": _DETECT,
        "route_planning": f"""WITH RECURSIVE {_EDGES}, {_JOBS}, nodes AS (SELECT source AS n FROM edges UNION SELECT target FROM edges),
walk AS (SELECT n AS source, n AS target, 0.0::DOUBLE AS cost, 0 AS hops, true AS all_native, [n] AS path FROM nodes
  UNION ALL SELECT w.source, e.target, w.cost + e.cost, hops + 1, all_native AND native, list_append(path, e.target) FROM walk w JOIN edges e ON w.target = e.source WHERE NOT list_contains(path, e.target)),
best AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY cost, hops, path DESC) = 1)
SELECT j.source, j.target, count(*) AS jobs, max(cost) AS cost, max(hops) AS hops, bool_or(all_native) AS all_native, max(array_to_string(path, '>')) AS path
FROM jobs j LEFT JOIN best b ON j.source = b.source AND j.target = b.target GROUP BY ALL""",
        "api_edges": f"WITH {_JOBS}, p(source, target) AS (VALUES {pairs}) SELECT source, target, (SELECT count(*) FROM jobs j WHERE j.source = p.source AND j.target = p.target) AS jobs FROM p",
        "model_summary": f"""WITH {_TENSORS}, {_SIZES} SELECT model_id, count(*) AS tensor_count, CAST(count(*) * 64 AS BIGINT) AS parameters, CAST(sum(ceil(64 * per)) AS BIGINT) AS nominal_bytes,
  CASE WHEN 2 * count(*) FILTER (dtype = 'Q4_K_M') > count(*) THEN 'Q4_K_M' WHEN 2 * count(*) FILTER (dtype = 'Q4_K_S') > count(*) THEN 'Q4_K_S' WHEN 2 * count(*) FILTER (dtype = 'Q5_K_M') > count(*) THEN 'Q5_K_M'
  WHEN 2 * count(*) FILTER (dtype IN ('Q8_0', 'Q8_K')) > count(*) THEN 'Q8_0' END AS scheme, printf('%.2fB', count(*) * 64 / 1e9) AS billions FROM tensors JOIN sizes USING (dtype) GROUP BY model_id""",
        "first_tensors": f"WITH {_TENSORS} SELECT model_id, ordinal, name, dtype, CAST(row_number() OVER (PARTITION BY model_id ORDER BY ordinal) AS INTEGER) AS place FROM tensors QUALIFY place <= 10",
        "architecture": _architecture(),
        "typed_metadata": """SELECT event_type, count(*) FILTER (event_id % 4 = 0) AS bigint, count(*) FILTER (event_id % 4 = 1) AS string, count(*) FILTER (event_id % 4 = 2) AS boolean,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) FILTER (event_id % 4 = 0) AS BIGINT) AS total FROM events GROUP BY event_type""",
        "shared_tensors": """WITH t AS (SELECT label AS model_id, 'layers.' || vec_id || '.weight' AS name, CASE WHEN vec_id % 4 = 1 THEN 'layers.' || (vec_id - 1) || '.weight' END AS target, 256 + vec_id AS b FROM embeddings)
SELECT t.model_id, t.name, t.target, CASE WHEN t.target IS NULL THEN t.b ELSE u.b END AS bytes, t.target IS NULL OR u.b IS NOT NULL AS resolved
FROM t LEFT JOIN t u ON t.target = u.name AND t.model_id = u.model_id AND u.target IS NULL""",
        "structural_validation": f"WITH {_TENSORS}, {_AFTER}, {_STRUCT} SELECT *, missing = 0 AND shape_mismatches = 0 AS passed FROM structure",
        "numeric_validation": f"WITH {_TENSORS}, {_AFTER}, {_NUMERIC} SELECT model_id, name, n, max_abs, round(mean_abs, 9) AS mean_abs, max_abs <= 9e-4 AS passed FROM numeric",
        "certificates": f"""WITH {_TENSORS}, {_AFTER}, {_STRUCT}, {_NUMERIC}, b AS (SELECT model_id, sha256(concat_ws('|', model_id, tensors_before, dtype_changes, 'true')) AS h
  FROM structure WHERE missing = 0 AND NOT EXISTS (SELECT 1 FROM numeric n WHERE n.model_id = structure.model_id AND max_abs > 1e-3))
SELECT model_id, 2 AS guarantees, h AS body_hash, 'self-certified:' || left(h, 16) AS signature FROM b""",
        "lora_pairs": f"""WITH {_ADAPTERS}, s AS (SELECT *, regexp_extract(key, '^(.*?)\\.lora_[AaBb]', 1) AS layer, upper(regexp_extract(key, '\\.lora_([AaBb])', 1)) AS side FROM adapters WHERE key LIKE '%.lora\\__%' ESCAPE '\\')
SELECT model_id, layer, regexp_replace(layer, '^base_model\\.model\\.', '') || '.weight' AS base, arg_max(key, seq) FILTER (side = 'A') AS a, arg_max(key, seq) FILTER (side = 'B') AS b FROM s GROUP BY model_id, layer HAVING a IS NOT NULL AND b IS NOT NULL""",
        "lora_merge": f"""WITH {_ELEMENTS}, a AS (SELECT vec_id, i // 8 AS k, i % 8 AS c, x FROM e WHERE i < 16), b AS (SELECT vec_id, (i - 16) // 2 AS r, i % 2 AS k, x FROM e WHERE i >= 16 AND i < 32),
p AS (SELECT vec_id, r, c, sum(a.x * b.x) AS delta FROM a JOIN b USING (vec_id, k) GROUP BY ALL)
SELECT e.vec_id AS layer, e.i // 8 AS r, CAST(e.i % 8 AS INTEGER) AS c, round(x + delta * coalesce(CASE WHEN label % 2 = 0 THEN 4.0::DOUBLE END, coalesce(CASE WHEN label % 3 = 0 THEN 2 END, 8)) / coalesce(CASE WHEN label % 3 = 0 THEN 2 END, 8), 9) AS w
FROM e JOIN p ON e.vec_id = p.vec_id AND e.i // 8 = p.r AND e.i % 8 = p.c""",
        "metadata_upserts": """SELECT user_id, event_type, event_id, value, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_place FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""",
        "provenance_chain": """WITH c AS (SELECT conv_id AS model_id, list(sha256(concat_ws('|', role, text)) ORDER BY turn) AS h, count(*) AS n, bool_or(turn = 1) AS one FROM conversations GROUP BY conv_id)
SELECT model_id, NOT (model_id % 3 = 0 AND one) AS valid, n, list_reduce(list_prepend(sha256('ROOT_1700000000_' || model_id), h), lambda a, x: sha256(a || x)) AS last FROM c""",
        "job_pages": f"WITH {_JOBS} SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, job_id) AS INTEGER) AS place, job_id, status FROM jobs QUALIFY place <= 3",
        "job_cancellation": f"""WITH {_JOBS}, asked AS (SELECT l_orderkey AS job_id, l_orderkey % 10 + l_linenumber AS user_id FROM lineitem UNION SELECT job_id, user_id FROM jobs WHERE source = 'GGUF')
SELECT source, CASE WHEN (job_id, user_id) IN (SELECT (job_id, user_id) FROM asked) AND status NOT IN ('done', 'failed', 'cancelled') THEN 'cancelled' ELSE status END AS status, count(*) AS n FROM jobs GROUP BY ALL""",
        "job_states": "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS events FROM events GROUP BY user_id",
        "token_validity": f"""WITH {_JOBS} SELECT c_mktsegment, count(*) AS tokens, count(DISTINCT user_id) AS users FROM jobs JOIN customer ON c_custkey = user_id
WHERE status != 'done' AND created_at + INTERVAL 7 DAYS > TIMESTAMP '1996-01-01' GROUP BY c_mktsegment""",
        "users_with_jobs": "SELECT c_nationkey, count(*) AS users FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY c_nationkey",
        "orphan_events": "SELECT event_type, count(*) AS n FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id) GROUP BY event_type",
        "job_history": history,
        "progress_states": f"WITH {_PROGRESS} SELECT job_id, status, count(*) AS n, round(max(progress), 6) AS progress FROM p GROUP BY job_id, status",
        "progress_by_minute": f"WITH {_PROGRESS} SELECT CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute, status, count(*) AS n, round(avg(progress), 6) AS progress FROM p GROUP BY ALL",
        "elementwise_ops": _elementwise(),
        "row_ops": f"""WITH {_ELEMENTS}, m AS (SELECT *, x - max(x) OVER w AS s, avg(x) OVER w AS mean, var_pop(x) OVER w AS var, avg(x * x) OVER w AS sq FROM e WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, CAST(i AS INTEGER) AS i, round(exp(s) / sum(exp(s)) OVER w, 6) AS softmax, round(s - ln(sum(exp(s)) OVER w), 6) AS log_softmax, round((x - mean) / sqrt(var + 1e-5), 6) AS layer_norm, round(x / sqrt(sq + 1e-6), 6) AS rms_norm FROM m WINDOW w AS (PARTITION BY vec_id)""",
        "reductions": f"""WITH {_ELEMENTS} SELECT vec_id, round(sum(x), 9) AS "ReduceSum", round(avg(x), 9) AS "ReduceMean", round(max(x), 9) AS "ReduceMax", round(min(x), 9) AS "ReduceMin",
  CAST(arg_min(i, (-x, i)) AS INTEGER) AS argmax, CAST(arg_min(i, (x, i)) AS INTEGER) AS argmin FROM e GROUP BY vec_id""",
        "top_elements": f"WITH {_ELEMENTS} SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS INTEGER) AS place FROM e QUALIFY place <= 3",
        "matmul": f"WITH {_ELEMENTS}, b AS (SELECT i, label AS c, avg(x) AS v FROM e GROUP BY i, label) SELECT e.vec_id AS r, b.c, round(sum(e.x * b.v), 6) AS v FROM e JOIN b USING (i) GROUP BY ALL",
        "safetensors_round_trip": "SELECT coalesce(source, 'none') AS model_id, 'doc.' || doc_id AS name, 'U8' AS dtype, strlen(coalesce(text, '')) AS byte_len, true AS in_bounds, sha256(coalesce(text, '')) AS sha256 FROM documents",
        "gguf_round_trip": """SELECT 'doc.' || doc_id AS path, 'doc.' || doc_id || suffix AS name, 'I8' AS dtype, strlen(coalesce(text, '')) AS byte_len, true AS in_bounds, CAST(rank AS INTEGER) AS rank, sha256(coalesce(text, '')) AS sha256
FROM documents, (VALUES ('', 1), ('.again', 2)) t(suffix, rank)""",
        **{f"{kind}_round_trip": """SELECT 'doc.' || doc_id AS path, 'doc.' || doc_id || suffix AS name, dtype, strlen(coalesce(text, '')) AS byte_len, true AS in_bounds, CAST(rank AS INTEGER) AS rank, sha256(coalesce(text, '')) AS sha256, CAST(NULL AS VARCHAR) AS error
FROM documents, (VALUES ('', 1, 'U8'), ('.again', 2, 'I8')) t(suffix, rank, dtype)""" for kind in ("onnx", "pytorch", "tflite")},
        "gguf_to_safetensors": """SELECT coalesce(source, 'none') AS model_id, 2 * count(*) AS tensors_before, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS shape_mismatches, CAST(0 AS BIGINT) AS dtype_changes,
  2 * count(*) AS tensors_after, true AS passed FROM documents GROUP BY ALL""",
        "file_hashes": r"SELECT page_id, sha256(html) AS sha256, regexp_extract(url, '[^/]\.([^./]*)$', 1) AS ext, left(regexp_replace(url, '[^\p{L}\p{N}._-]', '', 'g'), 128) AS name FROM pages",
        "row_sizes": f"""WITH g(type_id, dtype, elements, size) AS (VALUES {ggml}), r AS (SELECT l_partkey % 36 AS type_id, CAST(l_quantity * 32 AS BIGINT) AS n FROM lineitem)
SELECT CAST(r.type_id AS INTEGER) AS type_id, max(dtype) AS dtype, CAST(sum(n // elements * size) FILTER (n % elements = 0) AS BIGINT) AS bytes, count(*) FILTER (n % elements = 0) AS whole, count(*) AS n FROM r LEFT JOIN g USING (type_id) GROUP BY r.type_id""",
        "adapter_inspection": f"""WITH {_ADAPTERS} SELECT nullif(upper(regexp_extract(key, '\\.lora_([AaBb])', 1)), '') AS side, CAST(regexp_extract(key, 'layers\\.(\\d+)', 1) AS BIGINT) AS layer, count(*) AS n, count(*) AS valid FROM adapters GROUP BY ALL""",
        "running_offsets": f"""WITH {_TENSORS}, {_SIZES}, s AS (SELECT model_id, name, CAST(ceil(64 * per) AS BIGINT) AS size FROM tensors JOIN sizes USING (dtype))
SELECT model_id, name, size, CAST(sum((size + 31) // 32 * 32) OVER (PARTITION BY model_id ORDER BY name) - (size + 31) // 32 * 32 AS BIGINT) AS "offset" FROM s""",
        "conversion_policy": f"""WITH {_TENSORS} SELECT dtype, count(*) AS n, CASE dtype WHEN 'Q4_0' THEN 4 WHEN 'Q4_K_M' THEN 4 WHEN 'Q8_0' THEN 8 ELSE 0 END AS bits, 'Supported' AS policy, dtype IN ('F16', 'BF16', 'F32') AS lossless, dtype LIKE 'Q%' AS quantized FROM tensors GROUP BY dtype""",
        "canonical_groups": """WITH h AS (SELECT p_partkey, p_name, hex(encode(p_name)) AS h FROM part),
d AS (SELECT p_partkey, h, list_transform(range(1, length(h) + 1), lambda i: instr('0123456789ABCDEF', substr(h, i, 1)) - 1) AS d FROM h),
q AS (SELECT p_partkey, list_transform(range(0, len(d)), lambda i: d[i + 2 - i % 2 * 2]) AS four, list_transform(range(0, len(d) // 2), lambda i: d[2 * i + 1] * 16 + d[2 * i + 2]) AS eight FROM d)
SELECT p_partkey, len(four) AS n, list_sum(list_transform(four, lambda v, i: CASE (i - 1) // 16 WHEN 0 THEN 0.5::DOUBLE * (v - 8) WHEN 1 THEN 0.25::DOUBLE * v ELSE v END)) AS four,
  list_sum(list_transform(eight, lambda v, i: CASE (i - 1) // 8 WHEN 0 THEN 0.5::DOUBLE * (v - 8) WHEN 1 THEN 0.25::DOUBLE * v ELSE v END)) AS eight FROM q""",
        "sidecar_configs": """SELECT p_partkey, 'AwqGemm4' AS scheme, CASE WHEN p_partkey % 3 < 2 THEN p_size::BIGINT ELSE 4 END AS bits, CASE WHEN p_partkey % 3 = 0 THEN 64 ELSE 128 END::BIGINT AS group_size,
  CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN 4 ELSE 8 END::BIGINT AS rank, CASE p_partkey % 3 WHEN 0 THEN 2.5 WHEN 1 THEN 4 ELSE 8 END::DOUBLE AS alpha, CASE WHEN p_partkey % 3 = 1 THEN 2 ELSE 0 END AS modules, CASE WHEN p_partkey % 3 = 1 THEN 'X' ELSE 'LORA' END AS adapter_type FROM part""",
    }
