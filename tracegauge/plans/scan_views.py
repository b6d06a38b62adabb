"""Facts of many source scans, derived from customer, orders, supplier, part and documents.

``scan`` is one repository; every operator works on all scans at once. Each view reads the same in
both engines.
"""

from __future__ import annotations

from tracegauge.operators.scan import DEPENDENCIES

#: Customers to a scan: scans, and the files in them, grow with the data; the facts of one scan do not.
PER_SCAN = 40
SCANS = f"(SELECT greatest(4, CAST(floor(count(*) / {PER_SCAN}) AS BIGINT)) FROM {{customer}})"
from tracegauge.plans.registry import shared_view

# every known package occurs, in the first scans
_PACKAGES = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(DEPENDENCIES))

shared_view(
    "fn",
    f"""SELECT c_custkey AS c, k, CAST(floor(c_custkey / k) AS BIGINT) AS i, 's' || CAST(c_custkey % k AS STRING) AS scan,
      'component:' || CASE WHEN c_custkey % 11 = 5 THEN 'tests/test_m' ELSE 'app/m' END || CAST(c_custkey % 7 AS STRING) || '.py::fn' || CAST(c_custkey AS STRING) AS key,
      'fn' || CAST(c_custkey AS STRING) AS name,
      CASE WHEN c_custkey % 11 = 5 THEN 'tests/test_m' ELSE 'app/m' END || CAST(c_custkey % 7 AS STRING) || '.py' AS path,
      c_custkey % 11 = 5 AS is_test, c_custkey % 97 * 10 + 1 AS line_start, c_custkey % 97 * 10 + 9 AS line_end, c_acctbal, c_mktsegment
    FROM (SELECT *, {SCANS} AS k FROM {{customer}})""",
)
shared_view(
    "call_edge",
    """SELECT DISTINCT f.scan, f.key AS src_key, g.key AS dst_key FROM {orders} o JOIN {fn} f ON f.c = o.o_custkey
      JOIN {fn} g ON g.c = f.c + f.k * (f.i + 1) * (o.o_orderkey % 3 + 1)""",
    "fn",
    # a customer's orders become one row with a bit for each remainder before the joins, which would else move every order
    spark="""SELECT DISTINCT e.scan, e.key AS src_key, g.key AS dst_key FROM (
        SELECT f.*, explode(filter(array(-2, -1, 0, 1, 2), r -> o.seen & shiftleft(1, r + 2) <> 0)) AS r
        FROM (SELECT o_custkey, bit_or(shiftleft(1, CAST(o_orderkey % 3 AS INT) + 2)) AS seen FROM {orders} GROUP BY o_custkey) o JOIN {fn} f ON f.c = o.o_custkey) e
      JOIN {fn} g ON g.c = e.c + e.k * (e.i + 1) * (e.r + 1)""",
)
shared_view(
    "route",
    """SELECT scan, 'route:' || path || '::GET /r' || CAST(c AS STRING) AS key, 'GET /r' || CAST(c AS STRING) AS label, path, key AS handler_key
      FROM {fn} WHERE c % 31 = 3 AND NOT is_test""",
    "fn",
)
shared_view(
    "llm_client",
    """SELECT scan, 'endpoint:app/clients.py::client' || CAST(i AS STRING) || '@' || scan AS key, CASE WHEN i % 3 < 2 THEN 'openai' ELSE 'anthropic' END AS sdk,
      CASE i % 3 WHEN 0 THEN 'http://vllm-' || scan || ':8000/v1' WHEN 1 THEN CASE WHEN c % 2 = 0 THEN 'http://localhost:' || CAST(8100 + c % k AS STRING) ELSE 'http://10.0.0.5:11434/v1' END
        ELSE CASE WHEN c % 3 = 0 THEN CASE i % 4 WHEN 0 THEN 'https://api.groq.com/openai/v1' WHEN 1 THEN 'HTTPS://user@API.mistral.ai/v1' WHEN 2 THEN 'http://[::1]:8104/v1' ELSE 'https://openrouter.ai?v=1' END
          WHEN c % 3 = 1 THEN 'http://10.1.1.1:9999' END END AS base_url,
      c % 4 = 0 AS has_timeout, c AS id FROM {fn}""",
    "fn",
)
shared_view(
    "llm_call",
    """SELECT scan, key || '#llm0' AS key, key AS function_key, path, line_start AS line, is_test, 'chat.completions.create' AS api,
      'endpoint:app/clients.py::client' || CAST(i AS STRING) || '@' || scan AS endpoint_key,
      CASE c % 5 WHEN 0 THEN 'lab' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'Qwen2.5-0.5B' ELSE NULL END AS model_effective,
      c % 8 = 1 AS has_timeout, c % 3 = 0 AS stream, c AS id FROM {fn} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND (NOT is_test OR c % k * 25 < 12 * k)""",
    "fn",
)
shared_view(
    "retriever",
    """SELECT scan, key || '#retriever' AS key, key AS function_key, path, line_start AS line, CASE WHEN c % 2 = 0 THEN 'bm25' ELSE 'pgvector' END AS store,
      CASE WHEN c % 3 = 0 THEN c % 10 + 1 END AS top_k_literal, c AS id FROM {fn} WHERE c_acctbal > 7500""",
    "fn",
)
shared_view(
    "side_effect_fn",
    """SELECT scan, 'tool:' || path || '::' || name AS key, key AS function_key, name, path, line_start AS line,
      CASE c % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'external' END AS side_effect, c % 2 = 0 AS gated, c_acctbal > 5500 AND c % 3 = 0 AS observability_only, c AS id
      FROM {fn} WHERE c_mktsegment = 'AUTOMOBILE' OR c_acctbal < 0""",
    "fn",
)
shared_view(
    "prompt",
    """SELECT scan, 'prompt:' || path || '::P' || CAST(c AS STRING) AS key, 'P' || CAST(c AS STRING) AS name, path, line_start AS line, is_test,
      CAST(round(abs(c_acctbal)) AS BIGINT) AS static_chars, c % 4 <> 0 AS inline,
      CASE WHEN c % 5 = 0 THEN 'Answer from the context and cite the documents as [doc:id].' ELSE 'Answer briefly.' END AS text, key AS function_key, c AS id
      FROM {fn} WHERE c_mktsegment = 'FURNITURE'""",
    "fn",
)
shared_view(
    "system_message",
    """SELECT scan, 'prompt:' || path || '::' || name || '#system' AS key, key AS component_key, name AS function, path, line_start AS line,
      CAST(round(abs(c_acctbal)) AS BIGINT) AS static_chars, CAST(round(abs(c_acctbal) / 2) AS BIGINT) AS static_prefix_chars, c % 4 = 1 AS dynamic_head,
      'P' || CAST(c + k AS STRING) AS ref_prompt, c AS id FROM {fn} WHERE c_mktsegment = 'HOUSEHOLD' AND NOT is_test""",
    "fn",
)
shared_view(
    "serving",
    f"""SELECT 's' || CAST(s_suppkey % k AS STRING) AS scan, file, 'serving:' || file || '::vllm-s' || CAST(s_suppkey % k AS STRING) || '#' || CAST(s_suppkey AS STRING) AS key,
      CASE WHEN s_suppkey < k THEN '' ELSE 'spare' || CAST(s_suppkey AS STRING) || '-' END || 'vllm-s' || CAST(s_suppkey % k AS STRING) AS service,
      CASE WHEN s_suppkey % 4 = 3 THEN 'sglang' ELSE 'vllm' END AS engine, 8100 + s_suppkey AS host_port, s_suppkey AS id,
      'Qwen2.5-' || CAST(s_nationkey % 3 AS STRING) || 'B' AS model,
      'serve Qwen2.5-' || CAST(s_nationkey % 3 AS STRING) || 'B' || CASE WHEN s_suppkey % 3 = 0 THEN ' --max-model-len ' || CAST(1024 * (s_suppkey % 4 + 1) AS STRING) ELSE '' END
        || CASE WHEN s_suppkey % 5 = 0 THEN ' --no-enable-prefix-caching' WHEN s_suppkey % 5 = 1 THEN ' --enable-prefix-caching' ELSE '' END
        || CASE WHEN s_suppkey % 2 = 0 THEN ' --served-model-name=lab' ELSE '' END || ' --port 8000' AS command
    FROM (SELECT *, {SCANS} AS k, CASE s_suppkey % 3 WHEN 1 THEN 'deploy/compose.gpu.yml' ELSE 'docker-compose.yml' END AS file FROM {{supplier}})""",
)
shared_view(
    "dependency",
    f"""SELECT 's' || CAST(p_partkey % k AS STRING) AS scan, p_partkey AS id,
      CASE WHEN p_type = 'ECONOMY' THEN 'rank_bm25' WHEN p_type = 'STANDARD' THEN 'PgVector[extra]' WHEN p_type = 'PROMO' AND p_partkey % k * 25 < 15 * k THEN 'opentelemetry-sdk' WHEN p_type = 'SMALL' THEN 'tenacity' WHEN p_type = 'MEDIUM' AND p_partkey % k * 25 < 8 * k THEN 'deepeval' WHEN p_partkey % k * 25 < 8 * k THEN CASE CAST(floor(p_partkey / k) AS BIGINT) % {len(DEPENDENCIES)} {_PACKAGES} END ELSE 'left-pad' END
        || CASE WHEN p_size % 3 = 0 THEN '>=' || CAST(p_size AS STRING) || '.0' WHEN p_size % 3 = 1 THEN ' == 1.2 # pinned' ELSE '' END AS line, p_brand, p_size
    FROM (SELECT *, {SCANS} AS k FROM {{part}})""",
)
# retry libraries that a scan's files import; some scans depend on one and import none, or another
shared_view(
    "retry_import",
    """SELECT DISTINCT scan, path, CASE WHEN c % k * 25 < 10 * k THEN 'tenacity' ELSE 'backoff' END AS library FROM {fn} WHERE c % k * 25 < 16 * k AND c_acctbal > 5000""",
    "fn",
)
shared_view(
    "config_key",
    f"""SELECT scan, 'config:' || file || '#' || keypath AS key, file, keypath, CAST(v AS STRING) AS value, id FROM (
      SELECT 's' || CAST(s_suppkey % k AS STRING) AS scan, s_suppkey AS id, CASE s_suppkey % 4 WHEN 3 THEN 'conf/app.toml' ELSE 'config.yaml' END AS file, CASE CAST(floor(s_suppkey / k) AS BIGINT) % 4 WHEN 0 THEN 'retrieval.top_k' WHEN 1 THEN 'retrieval.max_context_chars'
        WHEN 2 THEN 'generation.max_tokens' ELSE 'server.debug' END AS keypath, CAST(abs(round(s_acctbal)) AS BIGINT) + 1 AS v FROM (SELECT *, {SCANS} AS k FROM {{supplier}}))""",
)
shared_view(
    "config_access",
    """SELECT scan, key, CASE c % 4 WHEN 0 THEN 'retrieval.top_k' WHEN 1 THEN 'retrieval.max_context_chars' WHEN 2 THEN 'generation.max_tokens' ELSE 'server.port' END AS keypath, c AS id
      FROM {fn} WHERE c_acctbal BETWEEN 0 AND 2500""",
    "fn",
)
# call sites that go through a gateway with a second endpoint
shared_view("fallback", "SELECT DISTINCT scan, 'gateway:' || path AS key FROM {fn} WHERE c % 97 = 5", "fn")
# documents as files of the scans
shared_view(
    "files",
    f"""SELECT 's' || CAST(doc_id % {SCANS} AS STRING) AS scan, doc_id AS id, text, lang, source,
      CASE doc_id % 12 WHEN 0 THEN 'README.md' WHEN 1 THEN 'docs/' || source || '.md' WHEN 2 THEN 'app/' || source || '.py' WHEN 3 THEN 'tests/test_' || source || '.py'
        WHEN 4 THEN 'requirements-' || source || '.txt' WHEN 5 THEN '.github/workflows/' || lang || '.yml' WHEN 6 THEN 'web/' || source || '.tsx' WHEN 7 THEN 'assets/' || source || '.PNG'
        WHEN 8 THEN 'data/' || source || '.csv' WHEN 9 THEN 'LICENSE' WHEN 10 THEN 'architecture-' || source || '.md' ELSE 'evals/datasets/' || source || '.jsonl' END AS path
    FROM {{documents}}""",
)
shared_view(
    "doc_mention",
    """SELECT scan, id, path, CASE WHEN lang = 'en' THEN 'vllm' WHEN lang = 'de' THEN 'ollama' ELSE 'tgi' END AS engine,
      CASE WHEN lang = 'fr' THEN 'gpt-4o-mini' WHEN lang = 'es' THEN 'claude-3' END AS model FROM {files} WHERE path LIKE 'architecture%' OR path LIKE 'README%'""",
    "files",
)
shared_view(
    "hunks",
    f"""SELECT 's' || CAST(o_custkey % {SCANS} AS STRING) AS scan, 'app/m' || CAST(o_custkey % 7 AS STRING) || '.py' AS path, o_orderkey AS hunk_id,
      o_orderkey * 13 % 970 + 1 AS new_start, o_orderkey % 4 AS new_lines, o_orderkey * 13 % 970 + 1 + o_orderkey % 2 AS old_start, o_custkey % 3 AS old_lines
    FROM {{orders}}""",
)
shared_view(
    "spans",
    """SELECT scan, key, 'function' AS kind, path, line_start, line_end FROM {fn}
      UNION ALL SELECT scan, key, 'llm_call', path, line, line + 2 FROM {llm_call}
      UNION ALL SELECT scan, key, 'prompt', path, line, line FROM {prompt}
      UNION ALL SELECT scan, key, 'system_message', path, line, line + 1 FROM {system_message}""",
    "fn", "llm_call", "prompt", "system_message",
)
# head files of application code that do not parse, and what application code quotes: file names, as code reads them
shared_view("unparsed", "SELECT DISTINCT scan, path FROM {head_files} WHERE path LIKE 'app/%.py' AND id % 36 = 14", "head_files")
shared_view(
    "app_code",
    """SELECT scan, path, 'import os' || chr(10) || 'rows = open("data/' || CASE c % 5 WHEN 0 THEN 'src1.csv' WHEN 1 THEN 'src2.csv' WHEN 2 THEN 'none' ELSE 'x' || CAST(c AS STRING) END || '")' AS text
      FROM {fn} WHERE c % 17 < 3 AND NOT is_test""",
    "fn",
)
# attributes of nodes that are no positions, before and after the change; and the functions that facts belong to
shared_view(
    "head_attrs",
    """SELECT scan, key, CAST(dynamic_head AS STRING) AS digest FROM {system_message}
      UNION ALL SELECT scan, key, max(value) FROM {config_key} GROUP BY scan, key""",
    "system_message", "config_key",
)
shared_view("base_messages", "SELECT scan, key, path, dynamic_head AND id % 8 <> 1 AS dynamic_head FROM {system_message} WHERE id % 11 <> 3", "system_message")
shared_view(
    "base_attrs",
    """SELECT scan, key, CAST(dynamic_head AS STRING) AS digest FROM {base_messages}
      UNION ALL SELECT scan, key, max(CASE WHEN id % 6 = 0 THEN value || '0' ELSE value END) FROM {config_key} GROUP BY scan, key""",
    "base_messages", "config_key",
)
shared_view(
    "owners",
    """SELECT scan, key, function_key AS owner FROM {llm_call} UNION ALL SELECT scan, key, function_key FROM {prompt}
      UNION ALL SELECT scan, key, component_key FROM {system_message}""",
    "llm_call", "prompt", "system_message",
)
