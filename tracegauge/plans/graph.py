"""Graph queries over the derived scans: reach, components, endpoints, models, impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegauge.operators import claims as C
from tracegauge.operators import graph as G
from tracegauge.operators import scan as B
from tracegauge.plans.claims_joins import claims_ctes
from tracegauge.plans.registry import query, shared_view, sql_view, view
from tracegauge.session import written

ALL = tuple(n for n in B.Facts.names())


def facts(spark, d) -> B.Facts:
    return B.Facts(**{n: view(spark, d, n) for n in ALL})


REACH = """reach AS (SELECT scan, handler_key AS key, 0 AS hop FROM route
      UNION SELECT e.scan, e.dst_key, hop + 1 FROM reach r JOIN call_edge e ON e.scan = r.scan AND e.src_key = r.key),
    reached AS (SELECT scan, key, min(hop) AS hop FROM reach GROUP BY ALL)"""
NOT_APP = "(starts_with({k}, 'component:tests/') OR starts_with({k}, 'component:test_') OR starts_with({k}, 'component:scripts/'))"
# scans without a route accept any app function
ON_PATH = """(EXISTS (SELECT 1 FROM reached r WHERE r.scan = x.scan AND r.key = x.{k}) OR (NOT EXISTS (SELECT 1 FROM route r WHERE r.scan = x.scan) AND NOT {na}))"""


def on_path(k: str) -> str:
    return ON_PATH.format(k=k, na=NOT_APP.format(k=f"x.{k}"))


ACTIONS = f"actions AS (SELECT * FROM side_effect_fn x WHERE NOT observability_only AND {on_path('function_key')})"
INTERESTING = f"""interesting AS (SELECT scan, function_key AS key FROM llm_call UNION SELECT scan, function_key FROM retriever UNION SELECT scan, function_key FROM prompt
      UNION SELECT scan, component_key FROM system_message UNION SELECT scan, function_key FROM actions UNION SELECT scan, key FROM config_access x WHERE {on_path('key')}),
    leads AS (SELECT scan, key FROM interesting UNION SELECT e.scan, e.src_key FROM leads l JOIN call_edge e ON e.scan = l.scan AND e.dst_key = l.key),
    comps AS (SELECT f.scan, f.key FROM fn f WHERE EXISTS (SELECT 1 FROM reached r WHERE r.scan = f.scan AND r.key = f.key) AND EXISTS (SELECT 1 FROM leads l WHERE l.scan = f.scan AND l.key = f.key)
      UNION SELECT f.scan, f.key FROM fn f JOIN interesting i ON i.scan = f.scan AND i.key = f.key WHERE NOT {NOT_APP.format(k='f.key')})"""
SCAN = f"WITH {REACH}, {ACTIONS}, {INTERESTING}"


@query("G1_reachable_set", "route", "call_edge", sql=f"WITH {REACH} SELECT scan, key, hop::INTEGER AS hop FROM reached")
def g1(spark, d):
    return B.route_reach(facts(spark, d))


@query("G13_components", *ALL, sql=SCAN + " SELECT scan, key FROM comps")
def g13(spark, d):
    f = facts(spark, d)
    return B.components(f, B.route_reach(f)).select("scan", "key")


@query("G17_actions", *ALL, sql=f"""WITH {REACH}, {ACTIONS} SELECT scan, key, side_effect, gated,
    CASE WHEN gated THEN 'boundary:' || path || '::' || name || '#approval' END AS guarded_by FROM actions""")
def g17(spark, d):
    f = facts(spark, d)
    a = B.actions(f, B.route_reach(f))
    guard = F.when(F.col("gated"), F.concat(F.lit("boundary:"), "path", F.lit("::"), "name", F.lit("#approval")))
    return a.select("scan", "key", "side_effect", "gated", guard.alias("guarded_by"))


CLIENTS = r"""places AS (SELECT c.*, lower(split_part(regexp_replace(regexp_replace(coalesce(base_url, ''), '^.*://', ''), '[/?#].*$', ''), '@', -1)) AS place FROM llm_client c),
    clients AS (SELECT * EXCLUDE (place), CASE WHEN starts_with(place, '[') THEN split_part(substr(place, 2), ']', 1) ELSE split_part(place, ':', 1) END AS host,
      try_cast(regexp_extract(place, ':([0-9]+)$', 1) AS BIGINT) AS port FROM places),
    matched AS (SELECT scan, key, arg_min(skey, sid) AS serving_key, arg_min(seng, sid) AS s_engine FROM (
      SELECT c.scan, c.key, s.key AS skey, s.engine AS seng, s.id AS sid FROM clients c JOIN serving s ON s.scan = c.scan AND (lower(s.service) = lower(c.host) OR (c.host IN ('localhost', '127.0.0.1', '::1') AND s.host_port = c.port))) GROUP BY ALL),
    resolved AS (SELECT c.*, m.serving_key, coalesce(s_engine, CASE lower(host) WHEN 'api.openai.com' THEN 'openai' WHEN 'api.anthropic.com' THEN 'anthropic' WHEN 'api.groq.com' THEN 'groq' WHEN 'api.mistral.ai' THEN 'mistral' WHEN 'openrouter.ai' THEN 'openrouter' END,
      CASE port WHEN 11434 THEN 'ollama' WHEN 30000 THEN 'sglang' END, CASE WHEN base_url IS NULL THEN sdk END) AS engine FROM clients c LEFT JOIN matched m USING (scan, key)),
    eng_cand AS (SELECT scan || '/' || key AS subject, 'serving_engine' AS predicate, coalesce(engine, 'unknown') AS value, CASE WHEN serving_key IS NOT NULL THEN 'config' ELSE 'ast' END AS source, id AS fact_id, serving_key IS NULL AS direct, 1 AS n
      FROM resolved WHERE engine IS NOT NULL OR base_url IS NOT NULL
      UNION ALL SELECT r.scan || '/' || r.key, 'serving_engine', m.engine, 'readme', m.id, TRUE, 1 FROM resolved r JOIN doc_mention m ON m.scan = r.scan)"""


@query("J17_client_lookup", "llm_client", "serving", "doc_mention", sql=f"WITH {CLIENTS} SELECT scan, key, serving_key, engine FROM resolved")
def j17(spark, d):
    return B.resolve_clients(facts(spark, d)).select("scan", "key", "serving_key", "engine")


@query(
    "G11_endpoint_resolution", "llm_client", "serving", "doc_mention",
    sql=f"WITH {CLIENTS}, " + claims_ctes("eng_cand", "subject, predicate", "eng") + " SELECT subject, value, confidence, status, method, n_support FROM eng",
)
def g11(spark, d):
    f = facts(spark, d)
    cand = B.engine_candidates(f, B.resolve_clients(f)).withColumn("subject", F.concat_ws("/", "scan", "subject"))
    return C.reconcile(cand).select("subject", "value", "confidence", "status", "method", "n_support")


sql_view(
    "flags",
    r"""SELECT scan, key, substr(split_part(w[i], '=', 1), 3) AS flag, CASE WHEN contains(w[i], '=') THEN split_part(w[i], '=', 2) WHEN i < len(w) AND NOT starts_with(w[i + 1], '--') THEN w[i + 1] ELSE 'true' END AS value
      FROM (SELECT scan, key, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT scan, key, string_split(command, ' ') AS w FROM serving)) WHERE starts_with(w[i], '--')""",
    "serving",
)


@query("P27_serving_flags", "flags", sql="SELECT scan, key, flag, value FROM flags")
def p27(spark, d):
    return B.parse_flags(view(spark, d, "serving"))


@query("P27_positional_model", "serving", sql="SELECT scan, key, split_part(command, ' ', 2) AS model FROM serving")
def p27m(spark, d):
    return B.positional_model(view(spark, d, "serving"))


CALLS = CLIENTS + """, calls AS (SELECT c.scan, c.key, c.function_key, c.path, c.line, c.id, c.endpoint_key, c.stream, CASE WHEN ok THEN served_model ELSE model_effective END AS model,
      CASE WHEN ok THEN 'config' ELSE 'ast' END AS source, c.has_timeout OR coalesce(ct, FALSE) AS has_timeout FROM (
      SELECT c.*, s.model AS served_model, r.has_timeout AS ct, s.model IS NOT NULL AND (c.model_effective IS NULL OR f.value IS NULL OR c.model_effective = f.value) AS ok FROM llm_call c
      LEFT JOIN resolved r ON r.scan = c.scan AND r.key = c.endpoint_key LEFT JOIN serving s ON s.scan = c.scan AND s.key = r.serving_key
      LEFT JOIN flags f ON f.scan = c.scan AND f.key = r.serving_key AND f.flag = 'served-model-name') c WHERE NOT is_test)"""
CALL_VIEWS = ("llm_client", "serving", "doc_mention", "llm_call", "flags")


def _calls(f: B.Facts):
    clients = B.resolve_clients(f)
    return B.call_models(f, clients, B.parse_flags(f.serving))


@query("G12_call_sites", *CALL_VIEWS, sql=f"WITH {CALLS} SELECT scan, key, model, source, has_timeout FROM calls")
def g12(spark, d):
    return _calls(facts(spark, d)).select("scan", "key", "model", "source", "has_timeout")


APP_MODEL = CALLS + """, am AS (SELECT scan, model AS value, source, id AS fact_id, lower(trim(model)) AS nv FROM calls WHERE model IS NOT NULL
      UNION ALL SELECT scan, model, 'readme', id, lower(trim(model)) FROM doc_mention WHERE model IS NOT NULL),
    quiet AS (SELECT scan FROM am GROUP BY scan HAVING count(DISTINCT CASE WHEN source <> 'readme' THEN nv END) > 1
      AND scan NOT IN (SELECT a.scan FROM am a WHERE a.source = 'readme' AND NOT EXISTS (SELECT 1 FROM am b WHERE b.scan = a.scan AND b.source <> 'readme' AND b.nv = a.nv))),
    am_cand AS (SELECT scan AS subject, 'model' AS predicate, value, source, fact_id, TRUE AS direct FROM am WHERE scan NOT IN (SELECT scan FROM quiet))"""


@query("G12_app_model", *CALL_VIEWS, sql=f"WITH {APP_MODEL}, " + claims_ctes("am_cand", "subject, predicate", "amc") + " SELECT subject AS scan, value, confidence, status, n_support FROM amc")
def g12m(spark, d):
    f = facts(spark, d)
    cand = B.app_model_candidates(f, _calls(f))
    return C.reconcile(cand, ["scan", "predicate"]).select("scan", "value", "confidence", "status", "n_support")


_CATEGORY = " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in B.DEPENDENCIES.items())
DEPS = rf"""deps AS (SELECT scan, id, name, CASE name {_CATEGORY} ELSE 'other' END AS category
      FROM (SELECT scan, id, lower(replace(regexp_extract(line, '{B.DEPENDENCY_NAME}', 1), '_', '-')) AS name FROM dependency))"""


@query("P28_dependency_rows", "dependency", sql=f"WITH {DEPS} SELECT scan, id, name, category FROM deps")
def p28(spark, d):
    return B.dependency_names(facts(spark, d))


@query(
    "G15_retrieval_presence", "dependency", "retriever", "fn",
    sql=f"""WITH {DEPS}, rc AS (SELECT scan, 'true' AS value, 'ast' AS source, id AS fact_id FROM retriever UNION ALL SELECT scan, 'true', 'dependency', id FROM deps WHERE category IN ('retrieval', 'vector_store')),
      rc_cand AS (SELECT scan, 'uses_rag' AS predicate, value, source, fact_id, TRUE AS direct FROM rc UNION ALL SELECT DISTINCT scan, 'uses_rag', 'false', 'absence', 0, TRUE FROM fn WHERE scan NOT IN (SELECT scan FROM rc)),
      """ + claims_ctes("rc_cand", "scan, predicate", "rcc") + " SELECT scan, value, confidence, n_support FROM rcc",
)
def g15(spark, d):
    f = facts(spark, d)
    return C.reconcile(B.retrieval_candidates(f, B.dependency_names(f)), ["scan", "predicate"]).select("scan", "value", "confidence", "n_support")


@query(
    "G15_top_k", "retriever", "config_key", "config_access",
    sql="""WITH k AS (SELECT c.scan, arg_min(c.value, c.id)::BIGINT AS cfg FROM config_key c WHERE c.keypath = 'retrieval.top_k' AND EXISTS (SELECT 1 FROM config_access a WHERE a.scan = c.scan AND a.keypath = c.keypath) GROUP BY c.scan)
      SELECT r.scan, r.key, r.store, coalesce(cfg, top_k_literal) AS top_k, CASE WHEN cfg IS NOT NULL THEN 'config' WHEN top_k_literal IS NOT NULL THEN 'ast' END AS source FROM retriever r LEFT JOIN k USING (scan)""",
)
def g15k(spark, d):
    return B.retriever_top_k(facts(spark, d))


@query(
    "G16_config_links", *ALL, "flags",
    sql=SCAN + """ SELECT DISTINCT a.scan, a.key AS src_key, c.key AS dst_key FROM config_access a JOIN config_key c ON c.scan = a.scan AND c.keypath = a.keypath JOIN comps p ON p.scan = a.scan AND p.key = a.key
      UNION SELECT f.scan, f.key, 'config:' || s.file || '#' || s.service || '.--' || f.flag FROM flags f JOIN serving s ON s.scan = f.scan AND s.key = f.key""",
)
def g16(spark, d):
    """Config keys that reachable code reads, and one node per flag of a serving command."""
    f = facts(spark, d)
    comps = B.components(f, B.route_reach(f)).select("scan", "key")
    reads = f.config_access.join(comps, ["scan", "key"], "left_semi").join(f.config_key.select("scan", "keypath", F.col("key").alias("dst_key")), ["scan", "keypath"])
    flags = B.parse_flags(f.serving).join(f.serving.select("scan", "key", "file", "service"), ["scan", "key"])
    return reads.select("scan", F.col("key").alias("src_key"), "dst_key").unionByName(
        flags.select("scan", F.col("key").alias("src_key"), B.service_flag_key().alias("dst_key"))
    ).distinct()


@query(
    "G18_reliability", *CALL_VIEWS, "dependency", "retry_import", "fallback",
    sql=f"""WITH {CALLS}, {DEPS} SELECT DISTINCT scan, 'eval_framework' AS predicate, name AS value FROM deps WHERE category = 'eval'
      UNION SELECT DISTINCT scan, 'tracing_library', name FROM deps WHERE category = 'tracing'
      UNION SELECT DISTINCT d.scan, 'retry_library', name FROM deps d WHERE category = 'retry' AND EXISTS (SELECT 1 FROM retry_import i WHERE i.scan = d.scan AND i.library = d.name)
      UNION SELECT scan, 'llm_in_tests', 'tests call an LLM (' || count(*)::VARCHAR || ' call sites)' FROM llm_call WHERE is_test GROUP BY scan
      UNION SELECT scan, 'timeout', key FROM calls WHERE has_timeout UNION SELECT scan, 'fallback', key FROM fallback""",
)
def g18(spark, d):
    """Existing reliability measures; a retry dependency counts only where the code imports it."""
    f = facts(spark, d)
    deps = B.dependency_names(f).select("scan", "name", "category").distinct()
    row = lambda df, p, v: df.select("scan", F.lit(p).alias("predicate"), v.alias("value"))
    tests = f.llm_call.where(B.is_test_path(F.col("path"))).groupBy("scan").agg(F.count("*").alias("n"))
    return (
        row(deps.where("category = 'eval'"), "eval_framework", F.col("name"))
        .unionByName(row(deps.where("category = 'tracing'"), "tracing_library", F.col("name")))
        .unionByName(row(B.retry_libraries(f, deps), "retry_library", F.col("name")))
        .unionByName(row(tests, "llm_in_tests", F.concat(F.lit("tests call an LLM ("), F.col("n").cast("string"), F.lit(" call sites)"))))
        .unionByName(row(_calls(f).where("has_timeout"), "timeout", F.col("key")))
        .unionByName(row(f.fallback, "fallback", F.col("key")))
    )


# ---------------------------------------------------------------- workflows, prompts, node/edge tables

FLOW = """flow AS (SELECT scan, key AS source, handler_key AS key FROM route UNION SELECT f.scan, f.source, e.dst_key FROM flow f JOIN call_edge e ON e.scan = f.scan AND e.src_key = f.key),
    wf AS (SELECT f.scan, f.source, count(DISTINCT l.key) AS n_llm, count(DISTINCT t.key) AS n_retrievers, count(DISTINCT s.key) AS n_tools FROM flow f
      LEFT JOIN llm_call l ON l.scan = f.scan AND l.function_key = f.key LEFT JOIN retriever t ON t.scan = f.scan AND t.function_key = f.key
      LEFT JOIN side_effect_fn s ON s.scan = f.scan AND s.function_key = f.key AND NOT s.observability_only GROUP BY ALL)"""


def workflow_reach(f: B.Facts):
    """Per route: how many model calls, retrievers and tools its requests reach."""
    starts = f.route.select("scan", F.col("key").alias("source"), F.col("handler_key").alias("node"))
    reach = G.traverse(f.call_edge, starts, source="source").select("scan", "source", F.col("node").alias("function_key"))
    tag = lambda df, k: df.select("scan", "function_key", F.lit(k).alias("what"), "key")
    things = tag(f.llm_call, "llm").unionByName(tag(f.retriever, "retriever")).unionByName(tag(f.side_effect_fn.where("NOT observability_only"), "tool"))
    hits = reach.join(things, ["scan", "function_key"]).select("scan", "source", "what", "key").distinct()
    n = lambda k: F.count_if(F.col("what") == k)
    return hits.groupBy("scan", "source").agg(n("llm").alias("n_llm"), n("retriever").alias("n_retrievers"), n("tool").alias("n_tools"))


@query(
    "G3_workflow_reach", "route", "call_edge", "llm_call", "retriever", "side_effect_fn",
    sql=f"WITH {FLOW} SELECT scan, source, n_llm, n_retrievers, n_tools, CASE WHEN n_llm > 0 AND n_retrievers > 0 THEN 'rag_answer' WHEN n_llm > 0 THEN 'llm_generation' END AS capability FROM wf WHERE n_llm + n_retrievers + n_tools > 0",
)
def g3(spark, d):
    w = workflow_reach(facts(spark, d))
    cap = F.when((F.col("n_llm") > 0) & (F.col("n_retrievers") > 0), "rag_answer").when(F.col("n_llm") > 0, "llm_generation")
    return w.withColumn("capability", cap)


def node_writes(f: B.Facts):
    """Node writes in build order; a later write to the same key only adds attributes."""
    def w(df, seq, kind, key, label, conf, **attrs):
        m = F.create_map(*[x for k, v in attrs.items() for x in (F.lit(k), v.cast("string"))]) if attrs else F.create_map().cast("map<string,string>")
        return df.select("scan", key.alias("key"), F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), label.alias("label"), F.lit(conf).alias("confidence"),
                         F.map_filter(m, lambda k, v: v.isNotNull()).alias("attrs"))

    c = F.col
    parts = [
        w(f.fn, 1, "component", c("key"), c("name"), 1.0, path=c("path"), line=c("line_start")),
        w(f.llm_call, 2, "component", c("key"), c("api"), 1.0, path=c("path"), stream=c("stream")),
        w(f.llm_call, 3, "component", c("function_key"), F.lit("later"), 0.5, calls_model=F.lit(True), line=c("line")),
        w(f.route, 4, "route", c("key"), c("label"), 1.0, path=c("path")),
        w(f.prompt.where("NOT is_test"), 5, "prompt", c("key"), c("name"), 1.0, static_chars=c("static_chars")),
        w(f.system_message, 6, "prompt", c("key"), c("function"), 1.0, static_chars=c("static_chars"), dynamic_head=c("dynamic_head")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edge_writes(f: B.Facts):
    e = lambda df, seq, kind, src, dst, conf: df.select("scan", F.lit(kind).alias("kind"), src.alias("src_key"), dst.alias("dst_key"), F.lit(conf).alias("confidence"), F.lit(seq).alias("seq"))
    c = F.col
    refs = f.system_message.join(f.prompt.select("scan", c("name").alias("ref_prompt"), c("key").alias("prompt_key")), ["scan", "ref_prompt"])
    return (
        e(f.call_edge, 1, "calls", c("src_key"), c("dst_key"), 1.0)
        .unionByName(e(f.llm_call, 2, "calls", c("function_key"), c("key"), 1.0))
        .unionByName(e(f.route, 3, "routes_to", c("key"), c("handler_key"), 1.0))
        .unionByName(e(f.system_message, 4, "uses_prompt", c("component_key"), c("key"), 1.0))
        .unionByName(e(refs, 5, "depends_on", c("key"), c("prompt_key"), 1.0))
        .unionByName(e(f.prompt, 6, "uses_prompt", c("function_key"), c("key"), 1.0))
    )


EDGES = """ew AS (SELECT scan, 'calls' AS kind, src_key, dst_key FROM call_edge UNION SELECT scan, 'calls', function_key, key FROM llm_call UNION SELECT scan, 'routes_to', key, handler_key FROM route
      UNION SELECT scan, 'uses_prompt', component_key, key FROM system_message UNION SELECT s.scan, 'depends_on', s.key, p.key FROM system_message s JOIN prompt p ON p.scan = s.scan AND p.name = s.ref_prompt
      UNION SELECT scan, 'uses_prompt', function_key, key FROM prompt),
    nk AS (SELECT scan, key FROM fn UNION SELECT scan, key FROM llm_call UNION SELECT scan, key FROM route UNION SELECT scan, key FROM prompt WHERE NOT is_test UNION SELECT scan, key FROM system_message),
    edges AS (SELECT e.* FROM ew e JOIN nk a ON a.scan = e.scan AND a.key = e.src_key JOIN nk b ON b.scan = e.scan AND b.key = e.dst_key)"""
GRAPH_VIEWS = ("fn", "call_edge", "llm_call", "route", "system_message", "prompt")


@query(
    "G8_node_merge", *GRAPH_VIEWS,
    sql="""SELECT f.scan, f.key, 'component' AS kind, f.name AS label, 1.0::DOUBLE AS confidence, 'line=' || coalesce(l.line, f.line_start)::VARCHAR || CASE WHEN l.key IS NULL THEN '' ELSE ',calls_model=true' END AS attrs FROM fn f LEFT JOIN llm_call l ON l.scan = f.scan AND l.function_key = f.key
      UNION ALL SELECT scan, key, 'component', api, 1.0, '' FROM llm_call UNION ALL SELECT scan, key, 'route', label, 1.0, '' FROM route
      UNION ALL SELECT scan, key, 'prompt', name, 1.0, '' FROM prompt WHERE NOT is_test UNION ALL SELECT scan, key, 'prompt', function, 1.0, '' FROM system_message""",
)
def g8(spark, d):
    n = G.merge_nodes(node_writes(facts(spark, d)))
    shown = F.array_join(F.filter(F.array(
        F.when((F.col("kind") == "component") & F.col("attrs")["line"].isNotNull(), F.concat(F.lit("line="), F.col("attrs")["line"])),
        F.when(F.col("attrs")["calls_model"].isNotNull(), F.concat(F.lit("calls_model="), F.col("attrs")["calls_model"])),
    ), lambda x: x.isNotNull()), ",")
    return n.select("scan", "key", "kind", "label", "confidence", shown.alias("attrs"))


def graph(f: B.Facts):
    nodes = G.merge_nodes(node_writes(f))
    return nodes, G.insert_edges(edge_writes(f), nodes)


@query("G9_edge_insert", *GRAPH_VIEWS, sql=f"WITH {EDGES} SELECT scan, kind, src_key, dst_key FROM edges")
def g9(spark, d):
    return graph(facts(spark, d))[1].select("scan", "kind", "src_key", "dst_key")


@query(
    "G14_routes_and_prompts", *GRAPH_VIEWS,
    sql=f"WITH {EDGES} SELECT scan, kind, src_key, dst_key FROM edges WHERE kind IN ('routes_to', 'uses_prompt', 'depends_on')",
)
def g14(spark, d):
    return graph(facts(spark, d))[1].where(F.col("kind").isin("routes_to", "uses_prompt", "depends_on")).select("scan", "kind", "src_key", "dst_key")


# ---------------------------------------------------------------- impact on the order graph

shared_view(
    "og_nodes",
    """SELECT DISTINCT 'g' AS scan, 'part:' || CAST(p_partkey AS STRING) AS key, 'tool' AS kind, 1 AS layer FROM {part}
      UNION ALL SELECT 'g', 'order:' || CAST(o_orderkey AS STRING), 'component', 2 FROM {orders}
      UNION ALL SELECT 'g', 'customer:' || CAST(c_custkey AS STRING), 'component', 3 FROM {customer}
      UNION ALL SELECT 'g', 'nation:' || n_name, 'capability', 4 FROM {nation}
      UNION ALL SELECT 'g', 'region:' || r_name, 'workflow', 5 FROM {region}""",
)
shared_view(
    "og_edges",
    """SELECT 'g' AS scan, 'invokes_tool' AS kind, 'order:' || CAST(l_orderkey AS STRING) AS src_key, 'part:' || CAST(l_partkey AS STRING) AS dst_key FROM {lineitem}
      UNION SELECT 'g', 'calls', 'customer:' || CAST(o_custkey AS STRING), 'order:' || CAST(o_orderkey AS STRING) FROM {orders}
      UNION SELECT 'g', 'implements', 'customer:' || CAST(c_custkey AS STRING), 'nation:' || n_name FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey
      UNION SELECT 'g', 'implements', 'nation:' || n_name, 'region:' || r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
)
shared_view("og_touched", "SELECT 'g' AS scan, 'part:' || CAST(p_partkey AS STRING) AS key FROM {part} WHERE p_type = 'PROMO' AND p_size = 7")

AFFECTED = """up AS (SELECT src_key AS a, dst_key AS b FROM og_edges WHERE kind = 'implements' UNION SELECT dst_key, src_key FROM og_edges e WHERE kind <> 'implements'
      AND NOT EXISTS (SELECT 1 FROM og_nodes n WHERE n.key = e.dst_key AND n.kind IN ('capability', 'workflow'))),
    lv AS (SELECT key, 0 AS hop, [key] AS path FROM og_touched UNION ALL SELECT b, hop, min(path) FROM (SELECT up.b, lv.hop + 1 AS hop, list_append(lv.path, up.b) AS path FROM lv JOIN up ON up.a = lv.key) GROUP BY b, hop),
    aff AS (SELECT key, min(hop) AS hop, arg_min(path, hop) AS path FROM lv GROUP BY key)"""


def _affected(spark, d):
    return G.affected(view(spark, d, "og_nodes"), view(spark, d, "og_edges"), view(spark, d, "og_touched"))


@query(
    "G2_affected_ancestors", "og_nodes", "og_edges", "og_touched",
    sql=f"WITH {AFFECTED} SELECT key, hop::INTEGER AS hop, array_to_string(path, '>') AS path FROM aff",
)
def g2(spark, d):
    return _affected(spark, d).select(F.col("node").alias("key"), "hop", F.array_join("path", ">").alias("path"))


@query(
    "G4_hop_distance", "og_nodes", "og_edges", "og_touched",
    sql="""WITH r AS (SELECT e.src_key AS a, e.dst_key AS b FROM og_edges e JOIN og_nodes s ON s.key = e.src_key JOIN og_nodes t ON t.key = e.dst_key WHERE t.layer >= s.layer
        UNION SELECT e.dst_key, e.src_key FROM og_edges e JOIN og_nodes s ON s.key = e.src_key JOIN og_nodes t ON t.key = e.dst_key WHERE t.layer < s.layer),
      fw AS (SELECT key, 0 AS hop FROM og_touched UNION SELECT b, hop + 1 FROM fw JOIN r ON r.a = fw.key),
      bw AS (SELECT key, 0 AS hop FROM og_touched UNION SELECT a, hop + 1 FROM bw JOIN r ON r.b = bw.key)
      SELECT 'right' AS direction, key, min(hop)::INTEGER AS hop FROM fw GROUP BY key UNION ALL SELECT 'left', key, min(hop)::INTEGER FROM bw WHERE hop > 0 GROUP BY key""",
)
def g4(spark, d):
    h = G.hop_distance(view(spark, d, "og_nodes"), view(spark, d, "og_edges"), view(spark, d, "og_touched"))
    return h.select("direction", F.col("node").alias("key"), "hop")


@query(
    "G19_impact_subgraph", "og_nodes", "og_edges", "og_touched",
    sql=f"WITH {AFFECTED} SELECT e.kind, e.src_key, e.dst_key FROM og_edges e JOIN aff a ON a.key = e.src_key JOIN aff b ON b.key = e.dst_key",
)
def g19(spark, d):
    nodes, edges = view(spark, d, "og_nodes"), written(view(spark, d, "og_edges"), "graph")  # walked, then cut
    want = G.affected(nodes, edges, view(spark, d, "og_touched")).select("scan", F.col("node").alias("key"))
    _, e = G.induced_subgraph(nodes, edges, want)
    return e.select("kind", "src_key", "dst_key")


@query(
    "O1_merged_graph", "og_nodes",
    sql="""WITH h AS (SELECT * FROM og_nodes WHERE key NOT LIKE 'part:%7'), b AS (SELECT key, CASE WHEN kind = 'tool' THEN 'old' ELSE kind END AS kind FROM og_nodes WHERE key NOT LIKE 'order:%3')
      SELECT key, kind FROM h UNION ALL SELECT key, kind FROM b WHERE key NOT IN (SELECT key FROM h)""",
)
def o1(spark, d):
    n, e = view(spark, d, "og_nodes"), view(spark, d, "og_edges")
    head = n.where("key NOT LIKE 'part:%7'")
    base = n.where("key NOT LIKE 'order:%3'").withColumn("kind", F.when(F.col("kind") == "tool", "old").otherwise(F.col("kind")))
    return G.merged_graph(base, head, e, e)[0].select("key", "kind")


# ---------------------------------------------------------------- the whole application graph

FULL = f"""{REACH}, {ACTIONS}, {INTERESTING}, {CALLS},
  fl AS (SELECT scan, key AS route, handler_key AS fk FROM route UNION SELECT f.scan, f.route, e.dst_key FROM fl f JOIN call_edge e ON e.scan = f.scan AND e.src_key = f.fk),
  hit AS (SELECT DISTINCT fl.scan, route, 'llm' AS what, l.key AS member, NULL::VARCHAR AS name FROM fl JOIN llm_call l ON l.scan = fl.scan AND l.function_key = fk
    UNION SELECT fl.scan, route, 'retriever', l.key, NULL::VARCHAR FROM fl JOIN retriever l ON l.scan = fl.scan AND l.function_key = fk
    UNION SELECT fl.scan, route, 'tool', l.key, l.name FROM fl JOIN side_effect_fn l ON l.scan = fl.scan AND l.function_key = fk AND NOT l.observability_only),
  caps AS (SELECT * FROM (SELECT h.scan, h.route, 'workflow:' || r.path || '::' || r.label AS workflow, 'capability:' || h.route || '::' || CASE WHEN what = 'tool' THEN 'action_' || h.name WHEN p.l AND p.t THEN 'rag_answer' WHEN p.l AND what = 'llm' THEN 'llm_generation' END AS capability, member, r.handler_key
    FROM hit h JOIN (SELECT scan, route, bool_or(what = 'llm') AS l, bool_or(what = 'retriever') AS t FROM hit GROUP BY ALL) p ON p.scan = h.scan AND p.route = h.route JOIN route r ON r.scan = h.scan AND r.key = h.route) WHERE capability IS NOT NULL),
  sv AS (SELECT scan, key, serving_key FROM resolved WHERE serving_key IS NOT NULL),
  fr AS (SELECT f.scan, f.key, 'config:' || s.file || '#' || s.service || '.--' || f.flag AS fkey FROM flags f JOIN serving s USING (scan, key) WHERE EXISTS (SELECT 1 FROM sv WHERE sv.scan = f.scan AND sv.serving_key = f.key)),
  rd AS (SELECT a.scan, a.key, k.key AS config FROM config_access a JOIN comps c ON c.scan = a.scan AND c.key = a.key JOIN config_key k ON k.scan = a.scan AND k.keypath = a.keypath),
  gn AS (SELECT scan, key, 'component' AS kind FROM comps UNION SELECT scan, key, 'component' FROM calls UNION SELECT scan, key, 'route' FROM route UNION SELECT scan, key, 'prompt' FROM prompt WHERE NOT is_test
    UNION SELECT scan, key, 'prompt' FROM system_message UNION SELECT scan, key, 'endpoint' FROM llm_client UNION SELECT scan, serving_key, 'serving_config' FROM sv UNION SELECT scan, 'model:' || model, 'model' FROM calls WHERE model IS NOT NULL
    UNION SELECT scan, key, 'retriever' FROM retriever UNION SELECT scan, key, 'tool' FROM actions UNION SELECT scan, 'boundary:' || path || '::' || name || '#approval', 'security_boundary' FROM actions WHERE gated
    UNION SELECT scan, config, 'config_key' FROM rd UNION SELECT scan, fkey, 'config_key' FROM fr UNION SELECT scan, capability, 'capability' FROM caps UNION SELECT scan, workflow, 'workflow' FROM caps),
  ge AS (SELECT scan, 'calls' AS kind, src_key, dst_key FROM call_edge UNION SELECT scan, 'calls', function_key, key FROM calls UNION SELECT scan, 'routes_to', key, handler_key FROM route UNION SELECT scan, 'uses_prompt', component_key, key FROM system_message
    UNION SELECT scan, 'uses_prompt', function_key, key FROM prompt UNION SELECT s.scan, 'depends_on', s.key, p.key FROM system_message s JOIN prompt p ON p.scan = s.scan AND p.name = s.ref_prompt AND NOT p.is_test
    UNION SELECT scan, 'configured_by', key, serving_key FROM sv UNION SELECT scan, 'configured_by', key, config FROM rd UNION SELECT scan, 'configured_by', key, fkey FROM fr UNION SELECT scan, 'uses_model', key, 'model:' || model FROM calls WHERE model IS NOT NULL
    UNION SELECT scan, 'served_by', 'model:' || model, endpoint_key FROM calls WHERE model IS NOT NULL UNION SELECT scan, 'retrieves_via', function_key, key FROM retriever UNION SELECT scan, 'invokes_tool', function_key, key FROM actions
    UNION SELECT scan, 'guarded_by', key, 'boundary:' || path || '::' || name || '#approval' FROM actions WHERE gated UNION SELECT scan, 'implements', member, capability FROM caps UNION SELECT scan, 'implements', handler_key, capability FROM caps UNION SELECT scan, 'implements', capability, workflow FROM caps),
  gx AS (SELECT e.* FROM ge e WHERE EXISTS (SELECT 1 FROM gn n WHERE n.scan = e.scan AND n.key = e.src_key) AND EXISTS (SELECT 1 FROM gn n WHERE n.scan = e.scan AND n.key = e.dst_key))"""


@query("G8_application_nodes", *ALL, "flags", sql=f"WITH {FULL} SELECT scan, key, kind FROM gn")
def g8a(spark, d):
    return B.full_graph(facts(spark, d))[0]


@query("G9_application_edges", *ALL, "flags", sql=f"WITH {FULL} SELECT scan, kind, src_key, dst_key FROM gx")
def g9a(spark, d):
    return B.full_graph(facts(spark, d))[1]
