"""Build the application graph and its claims from facts, for many scans at once."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegauge.operators.graph import traverse

# Hosts, ports and clients whose serving engine is known; dependency categories.
LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "host.docker.internal")  # noqa: S104 - names matched in URLs
API_HOSTS = {
    "api.openai.com": "openai", "api.anthropic.com": "anthropic", "api.groq.com": "groq", "openrouter.ai": "openrouter",
    "generativelanguage.googleapis.com": "google", "api.mistral.ai": "mistral", "api.together.xyz": "together", "api.fireworks.ai": "fireworks",
}
ENGINE_PORTS = {11434: "ollama", 30000: "sglang"}
SDK_ENGINES = ("openai", "anthropic", "groq", "ollama", "bedrock", "cohere", "google", "huggingface", "llama_cpp", "mistral", "replicate")
# Names as they are after normalization (lower case, "-" for "_").
DEPENDENCIES = {
    "openai": "llm_sdk", "anthropic": "llm_sdk", "@anthropic-ai/sdk": "llm_sdk", "groq": "llm_sdk", "groq-sdk": "llm_sdk", "mistralai": "llm_sdk",
    "google-generativeai": "llm_sdk", "google-genai": "llm_sdk", "@google/genai": "llm_sdk", "cohere": "llm_sdk", "ollama": "llm_sdk", "litellm": "llm_sdk",
    "ai": "llm_framework", "@ai-sdk/openai": "llm_sdk", "langchain": "llm_framework", "langchain-openai": "llm_framework",
    "langchain-community": "llm_framework", "@langchain/openai": "llm_framework", "llama-index": "llm_framework",
    "instructor": "validation", "guardrails-ai": "validation", "vllm": "serving", "sglang": "serving", "transformers": "serving",
    "rank-bm25": "retrieval", "pgvector": "vector_store", "chromadb": "vector_store", "qdrant-client": "vector_store", "pinecone": "vector_store",
    "pinecone-client": "vector_store", "faiss-cpu": "vector_store", "weaviate-client": "vector_store", "sentence-transformers": "retrieval",
    "ragas": "eval", "deepeval": "eval", "promptfoo": "eval", "langfuse": "tracing", "langsmith": "tracing", "opentelemetry-api": "tracing",
    "opentelemetry-sdk": "tracing", "@opentelemetry/api": "tracing", "arize-phoenix": "tracing",
    "fastapi": "web", "flask": "web", "django": "web", "express": "web", "next": "web", "tenacity": "retry", "backoff": "retry",
    "pytest": "testing", "vitest": "testing", "jest": "testing",
}
#: A requirement line's name: a distribution, or a scoped package.
DEPENDENCY_NAME = r"^\s*(@[A-Za-z0-9._-]+/[A-Za-z0-9._-]+|[A-Za-z0-9][A-Za-z0-9._-]*)"


@dataclass
class Facts:
    """Fact tables of all scans, each with a ``scan`` column."""

    fn: DataFrame
    call_edge: DataFrame
    route: DataFrame
    llm_client: DataFrame
    llm_call: DataFrame
    retriever: DataFrame
    side_effect_fn: DataFrame
    prompt: DataFrame
    system_message: DataFrame
    serving: DataFrame
    dependency: DataFrame
    config_key: DataFrame
    config_access: DataFrame
    doc_mention: DataFrame
    retry_import: DataFrame
    fallback: DataFrame

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]


def non_app(key: Column) -> Column:
    return key.startswith("component:tests/") | key.startswith("component:test_") | key.startswith("component:scripts/")


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)tests?/") | path.rlike(r"(^|/)test_[^/]*$") | path.rlike(r"_test\.py$") | path.rlike(r"(^|/)conftest\.py$")


def route_reach(f: Facts) -> DataFrame:
    """Functions reachable from any route handler."""
    starts = f.route.select("scan", F.col("handler_key").alias("node"))
    return traverse(f.call_edge, starts).select("scan", F.col("node").alias("key"), "hop")


def _on_request_path(df: DataFrame, key: str, f: Facts, reach: DataFrame) -> DataFrame:
    """Rows whose function a request can reach; scans without routes accept any app function."""
    routed = f.route.select("scan").distinct()
    hit = df.join(reach.select("scan", F.col("key").alias(key)), ["scan", key], "left_semi")
    free = df.join(routed, "scan", "left_anti").where(~non_app(F.col(key)))
    return hit.unionByName(free)


def actions(f: Facts, reach: DataFrame) -> DataFrame:
    """Side-effecting functions that count as application actions (tools)."""
    return _on_request_path(f.side_effect_fn.where("NOT observability_only"), "function_key", f, reach)


def interesting(f: Facts, reach: DataFrame) -> DataFrame:
    """Functions with model calls, retrieval or prompts, plus actions and config reads on a request path."""
    col = lambda df, c: df.select("scan", F.col(c).alias("key"))
    core = col(f.llm_call, "function_key").unionByName(col(f.retriever, "function_key")).unionByName(
        col(f.prompt, "function_key")).unionByName(col(f.system_message, "component_key"))
    gated = col(actions(f, reach), "function_key").unionByName(col(_on_request_path(f.config_access, "key", f, reach), "key"))
    return core.unionByName(gated).distinct()


def components(f: Facts, reach: DataFrame) -> DataFrame:
    """Functions on a route-to-interesting path, and every interesting function of the app itself."""
    want = interesting(f, reach).checkpoint()
    back = f.call_edge.select("scan", F.col("dst_key").alias("src_key"), F.col("src_key").alias("dst_key"))
    leads = traverse(back, want.select("scan", F.col("key").alias("node"))).select("scan", F.col("node").alias("key"))
    keep = reach.select("scan", "key").join(leads, ["scan", "key"], "left_semi").unionByName(want.where(~non_app(F.col("key")))).distinct()
    return f.fn.join(keep, ["scan", "key"], "left_semi").select("scan", "key", "name", "path", F.col("line_start").alias("line"))


def resolve_clients(f: Facts) -> DataFrame:
    """Serving config and engine of each client: service host, published local port, API host, engine port."""
    authority = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/:?#\[\]]+)(?::(\d+))?"
    host = F.regexp_replace(F.lower(F.regexp_extract("base_url", authority, 1)), r"[\[\]]", "")
    port = F.regexp_extract("base_url", authority, 2)
    c = f.llm_client.withColumns({"host": host, "port": F.when(port != "", port.cast("long"))})
    s = f.serving.select("scan", F.col("key").alias("serving_key"), F.lower("service").alias("service"), "engine", "host_port", F.col("id").alias("serving_id"))
    pick = F.struct(F.lit(1).alias("rule"), "serving_id", "serving_key", "engine")
    by_host = c.join(s, (c.scan == s.scan) & (c.host == s.service)).select(c.scan, c.key, pick.alias("m"))
    by_port = c.where(F.col("host").isin(*LOCAL_HOSTS)).alias("c").join(
        s.alias("s"), (F.col("c.scan") == F.col("s.scan")) & (F.col("c.port") == F.col("s.host_port"))
    ).select("c.scan", "c.key", pick.alias("m"))
    best = by_host.unionByName(by_port).groupBy("scan", "key").agg(F.min("m").alias("m"))
    j = c.join(best, ["scan", "key"], "left")
    api = F.element_at(F.create_map(*[F.lit(x) for kv in API_HOSTS.items() for x in kv]), F.col("host"))
    eng = F.element_at(F.create_map(*[F.lit(x) for kv in ENGINE_PORTS.items() for x in kv]), F.coalesce(F.col("port"), F.lit(0)).cast("int"))
    return j.select(
        "scan", "key", "id", "sdk", "base_url", "has_timeout", F.col("m.serving_key").alias("serving_key"),
        F.coalesce(F.col("m.engine"), api, eng, F.when(F.col("base_url").isNull() & F.col("sdk").isin(*SDK_ENGINES), F.col("sdk"))).alias("engine"),
    )


def engine_candidates(f: Facts, clients: DataFrame) -> DataFrame:
    """Candidate serving engines per client: code or config evidence, and what the documents mention.

    Mentions are counted per (scan, engine) first; the claim needs their number, not each row.
    """
    code = clients.where("engine IS NOT NULL OR base_url IS NOT NULL").select(
        "scan", F.col("key").alias("subject"), F.lit("serving_engine").alias("predicate"), F.coalesce("engine", F.lit("unknown")).alias("value"),
        F.when(F.col("serving_key").isNotNull(), "config").otherwise("ast").alias("source"), F.col("id").alias("fact_id"),
        F.col("serving_key").isNull().alias("direct"), F.lit(1).cast("long").alias("n"),
    )
    said = f.doc_mention.groupBy("scan", "engine").agg(F.count("*").alias("n"), F.min("id").alias("fact_id"))
    docs = clients.select("scan", F.col("key").alias("subject")).join(said, "scan").select(
        "scan", "subject", F.lit("serving_engine").alias("predicate"), F.col("engine").alias("value"), F.lit("readme").alias("source"),
        "fact_id", F.lit(True).alias("direct"), "n",
    )
    return code.unionByName(docs)


def call_models(f: Facts, clients: DataFrame, flags: DataFrame) -> DataFrame:
    """App call sites with their real model: a served alias resolves to the model behind it."""
    served = clients.where("serving_key IS NOT NULL").select("scan", F.col("key").alias("endpoint_key"), "serving_key").join(
        f.serving.select("scan", F.col("key").alias("serving_key"), F.col("model").alias("served_model")), ["scan", "serving_key"]
    ).join(flags.where("flag = 'served-model-name'").select("scan", F.col("key").alias("serving_key"), F.col("value").alias("alias")), ["scan", "serving_key"], "left")
    timeouts = clients.select("scan", F.col("key").alias("endpoint_key"), F.col("has_timeout").alias("_ct"))
    c = f.llm_call.where(~is_test_path(F.col("path"))).join(served, ["scan", "endpoint_key"], "left").join(timeouts, ["scan", "endpoint_key"], "left")
    alias_ok = F.col("served_model").isNotNull() & (F.col("model_effective").isNull() | F.col("alias").isNull() | (F.col("model_effective") == F.col("alias")))
    return c.select(
        "scan", "key", "function_key", "path", "line", "id", "endpoint_key", "stream",
        F.when(alias_ok, F.col("served_model")).otherwise(F.col("model_effective")).alias("model"),
        F.when(alias_ok, "config").otherwise("ast").alias("source"),
        (F.col("has_timeout") | F.coalesce("_ct", F.lit(False))).alias("has_timeout"),
    )


def app_model_candidates(f: Facts, calls: DataFrame) -> DataFrame:
    """Code-derived models against documented ones, per scan.

    A scan whose code uses several models and whose documents name no other model is a multi-model
    app, not a disagreement, and yields nothing.
    """
    code = calls.where("model IS NOT NULL").select("scan", F.col("model").alias("value"), "source", F.col("id").alias("fact_id"))
    docs = f.doc_mention.where("model IS NOT NULL").select("scan", F.col("model").alias("value"), F.lit("readme").alias("source"), F.col("id").alias("fact_id"))
    norm = F.lower(F.trim("value"))
    code_models = code.select("scan", norm.alias("m")).distinct()
    many = code_models.groupBy("scan").agg(F.count("*").alias("_n")).where("_n > 1").select("scan")
    foreign = docs.select("scan", norm.alias("m")).distinct().join(code_models, ["scan", "m"], "left_anti").select("scan").distinct()
    quiet = many.join(foreign, "scan", "left_anti")
    return code.unionByName(docs).join(quiet, "scan", "left_anti").select(
        "scan", F.lit("app").alias("subject"), F.lit("model").alias("predicate"), "value", "source", "fact_id", F.lit(True).alias("direct")
    )


def retry_libraries(f: Facts, dependencies: DataFrame) -> DataFrame:
    """(scan, name) of the retry libraries that a scan depends on and its code imports.

    A dependency alone proves nothing: frozen requirements list what other packages pull in.
    """
    imported = f.retry_import.select("scan", F.col("library").alias("name")).distinct()
    return dependencies.where("category = 'retry'").select("scan", "name").distinct().join(imported, ["scan", "name"], "left_semi")


def service_flag_key() -> Column:
    """Key of a serving flag: the file that declares the service, the service, the flag."""
    return F.concat(F.lit("config:"), "file", F.lit("#"), "service", F.lit(".--"), "flag")


def dependency_names(f: Facts) -> DataFrame:
    """Requirement lines to normalized distribution names with their known category."""
    name = F.lower(F.regexp_replace(F.trim(F.regexp_extract("line", DEPENDENCY_NAME, 1)), "_", "-"))
    d = f.dependency.where(~F.trim("line").rlike(r"^[#-]")).withColumn("name", name).where("name <> ''")
    known = F.element_at(F.create_map(*[F.lit(x) for kv in DEPENDENCIES.items() for x in kv]), F.col("name"))
    return d.select("scan", "id", "name", F.coalesce(known, F.lit("other")).alias("category"))


def retrieval_candidates(f: Facts, deps: DataFrame) -> DataFrame:
    """Evidence that a scan retrieves documents; one 'absence' row where nothing says so."""
    mk = lambda df, source, direct=True: df.groupBy("scan").agg(F.count("*").alias("n"), F.min("id").alias("fact_id")).select(
        "scan", F.lit("true").alias("value"), F.lit(source).alias("source"), "fact_id", F.lit(direct).alias("direct"), "n"
    )
    found = mk(f.retriever, "ast").unionByName(mk(deps.where("category IN ('retrieval', 'vector_store')"), "dependency"))
    none = f.fn.select("scan").distinct().join(found.select("scan"), "scan", "left_anti").select(
        "scan", F.lit("false").alias("value"), F.lit("absence").alias("source"), F.lit(0).cast("long").alias("fact_id"), F.lit(True).alias("direct"), F.lit(1).cast("long").alias("n")
    )
    return found.unionByName(none).withColumns({"subject": F.lit("app"), "predicate": F.lit("uses_rag")})


def retriever_top_k(f: Facts) -> DataFrame:
    """top_k of each retriever: a config key read by code wins over the literal at the call."""
    leaf = F.element_at(F.split("keypath", r"\."), -1)
    read = f.config_access.where(leaf.isin("top_k", "k", "n_results")).select("scan", "keypath").distinct()
    cfg = f.config_key.join(read, ["scan", "keypath"], "left_semi").where(F.col("value").rlike(r"^\d+$")).groupBy("scan").agg(
        F.min_by("value", "id").alias("cfg")
    )
    return f.retriever.join(cfg, "scan", "left").select(
        "scan", "key", "store", F.coalesce(F.col("cfg").cast("long"), F.col("top_k_literal")).alias("top_k"),
        F.when(F.col("cfg").isNotNull(), "config").when(F.col("top_k_literal").isNotNull(), "ast").alias("source"),
    )


def parse_flags(serving: DataFrame) -> DataFrame:
    """Command line to (flag, value) rows: ``--a=b``, ``--a b`` and bare ``--a`` (value 'true')."""
    words = F.filter(F.split(F.trim("command"), r"\s+"), lambda w: w != "")
    at = F.transform(words, lambda w, i: F.struct(w.alias("w"), F.get(words, i + 1).alias("nxt")))
    s = serving.select("scan", "key", F.explode(at).alias("x")).where(F.col("x.w").startswith("--"))
    name = F.regexp_extract("x.w", r"^--([A-Za-z0-9][A-Za-z0-9-]*)", 1)
    inline = F.when(F.instr("x.w", "=") > 0, F.regexp_extract("x.w", r"^--[^=]+=(.*)$", 1))
    following = F.when(~F.col("x.nxt").startswith("--"), F.col("x.nxt"))
    return s.select("scan", "key", name.alias("flag"), F.coalesce(inline, following, F.lit("true")).alias("value"))


def positional_model(serving: DataFrame) -> DataFrame:
    """First positional word after the verb, i.e. neither a flag nor the value of one."""
    words = F.filter(F.split(F.trim("command"), r"\s+"), lambda w: w != "")
    kept = F.filter(
        F.transform(words, lambda w, i: F.struct(w.alias("w"), F.when(i > 0, F.get(words, i - 1)).alias("prev"))),
        lambda x: ~x["w"].startswith("--") & (x["w"] != "serve") & ~(F.coalesce(x["prev"].startswith("--") & ~x["prev"].contains("="), F.lit(False))),
    )
    return serving.select("scan", "key", F.get(kept, F.lit(0))["w"].alias("model"))


def _edge(df: DataFrame, kind: str, src: Column, dst: Column) -> DataFrame:
    return df.select("scan", F.lit(kind).alias("kind"), src.alias("src_key"), dst.alias("dst_key"))


def _node(df: DataFrame, kind: str, key: Column) -> DataFrame:
    return df.select("scan", key.alias("key"), F.lit(kind).alias("kind"))


def capabilities(f: Facts) -> DataFrame:
    """Capability members per route: (scan, route, workflow, capability, member).

    Calls with retrieval answer from documents, calls alone generate, and every tool a route reaches
    is an action of its own.
    """
    starts = f.route.select("scan", F.col("key").alias("source"), F.col("handler_key").alias("node"))
    reach = traverse(f.call_edge, starts, source="source").select("scan", F.col("source").alias("route"), F.col("node").alias("function_key"))
    tag = lambda df, what, name: df.select("scan", "function_key", F.lit(what).alias("what"), F.col("key").alias("member"), name.alias("name"))
    none = F.lit(None).cast("string")
    things = tag(f.llm_call, "llm", none).unionByName(tag(f.retriever, "retriever", none)).unionByName(
        tag(f.side_effect_fn.where("NOT observability_only"), "tool", F.col("name")))
    hits = reach.join(things, ["scan", "function_key"]).select("scan", "route", "what", "member", "name").distinct()
    per = hits.groupBy("scan", "route").agg(F.bool_or(F.col("what") == "llm").alias("_llm"), F.bool_or(F.col("what") == "retriever").alias("_ret"))
    j = hits.join(per, ["scan", "route"]).join(f.route.select("scan", F.col("key").alias("route"), "path", "label"), ["scan", "route"])
    kind = (
        F.when(F.col("what") == "tool", F.concat(F.lit("action_"), "name"))
        .when(F.col("_llm") & F.col("_ret"), "rag_answer")
        .when(F.col("_llm") & (F.col("what") == "llm"), "llm_generation")
    )
    key = F.concat(F.lit("capability:"), "route", F.lit("::"), kind)
    return j.where(kind.isNotNull()).select(
        "scan", "route", F.concat(F.lit("workflow:"), "path", F.lit("::"), "label").alias("workflow"), key.alias("capability"), "member"
    )


def full_graph(f: Facts) -> tuple[DataFrame, DataFrame]:
    """All nodes (scan, key, kind) and edges of the application graphs, from routes to workflows."""
    reach = route_reach(f)
    comps = components(f, reach).select("scan", "key").checkpoint()
    # derived facts that feed several kinds of nodes and edges are written once
    clients, flags = resolve_clients(f).checkpoint(), parse_flags(f.serving)
    tools, caps = actions(f, reach).checkpoint(), capabilities(f).checkpoint()
    calls = call_models(f, clients, flags).checkpoint()
    model = F.concat(F.lit("model:"), "model")
    boundary = F.concat(F.lit("boundary:"), "path", F.lit("::"), "name", F.lit("#approval"))
    served = clients.where("serving_key IS NOT NULL")
    flag_key = service_flag_key()
    flag_rows = flags.join(f.serving.select("scan", "key", "file", "service"), ["scan", "key"]).join(
        served.select("scan", F.col("serving_key").alias("key")).distinct(), ["scan", "key"], "left_semi"
    )
    reads = f.config_access.join(comps, ["scan", "key"], "left_semi").join(
        f.config_key.select("scan", "keypath", F.col("key").alias("config")), ["scan", "keypath"]
    )
    refs = f.system_message.join(f.prompt.where("NOT is_test").select("scan", F.col("name").alias("ref_prompt"), F.col("key").alias("prompt_key")), ["scan", "ref_prompt"])
    c = F.col
    nodes = [
        _node(comps, "component", c("key")), _node(calls, "component", c("key")), _node(f.route, "route", c("key")),
        _node(f.prompt.where("NOT is_test"), "prompt", c("key")), _node(f.system_message, "prompt", c("key")), _node(clients, "endpoint", c("key")),
        _node(served, "serving_config", c("serving_key")), _node(calls.where("model IS NOT NULL"), "model", model), _node(f.retriever, "retriever", c("key")),
        _node(tools, "tool", c("key")), _node(tools.where("gated"), "security_boundary", boundary), _node(reads, "config_key", c("config")),
        _node(flag_rows, "config_key", flag_key), _node(caps, "capability", c("capability")), _node(caps, "workflow", c("workflow")),
    ]
    handlers = caps.select("scan", c("route").alias("key"), "capability").distinct().join(f.route.select("scan", "key", "handler_key"), ["scan", "key"])
    edges = [
        _edge(f.call_edge, "calls", c("src_key"), c("dst_key")), _edge(calls, "calls", c("function_key"), c("key")), _edge(f.route, "routes_to", c("key"), c("handler_key")),
        _edge(f.system_message, "uses_prompt", c("component_key"), c("key")), _edge(f.prompt, "uses_prompt", c("function_key"), c("key")), _edge(refs, "depends_on", c("key"), c("prompt_key")),
        _edge(served, "configured_by", c("key"), c("serving_key")), _edge(reads, "configured_by", c("key"), c("config")), _edge(flag_rows, "configured_by", c("key"), flag_key),
        _edge(calls.where("model IS NOT NULL"), "uses_model", c("key"), model), _edge(calls.where("model IS NOT NULL"), "served_by", model, c("endpoint_key")),
        _edge(f.retriever, "retrieves_via", c("function_key"), c("key")), _edge(tools, "invokes_tool", c("function_key"), c("key")), _edge(tools.where("gated"), "guarded_by", c("key"), boundary),
        _edge(caps, "implements", c("member"), c("capability")), _edge(handlers, "implements", c("handler_key"), c("capability")), _edge(caps, "implements", c("capability"), c("workflow")),
    ]
    n, e = nodes[0], edges[0]
    for x in nodes[1:]:
        n = n.unionByName(x)
    for x in edges[1:]:
        e = e.unionByName(x)
    n = n.distinct().checkpoint()  # three readers below: both edge ends and the caller
    have = n.select("scan", "key").distinct()
    e = e.distinct().join(have.withColumnRenamed("key", "src_key"), ["scan", "src_key"], "left_semi").join(
        have.withColumnRenamed("key", "dst_key"), ["scan", "dst_key"], "left_semi"
    )
    return n, e.select("scan", "kind", "src_key", "dst_key")
