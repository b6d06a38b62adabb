"""Rule findings over the facts of many scans. No evidence, no row.

A rule is ``Facts -> DataFrame(scan, rule_id, priority, confidence, subject, n_sites, action)``.
A finding over a whole scan names the scan's ``app`` as subject and counts its sites; the sites are
rows of the rule's source table, not one array.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegauge.operators import claims as C
from tracegauge.operators import scan as B

Rule = Callable[["Context"], DataFrame]
RULES: dict[str, Rule] = {}

# Characters per token, citation wording, experimental rules, verifying artifacts.
CHARS_PER_TOKEN = 4
CITATION_INSTRUCTION = r"(?i)\bcit(e|ation)s?\b|\[doc:|\[source"
EXPERIMENTAL = ("sec.tool_approval_boundary",)
SELF_HOSTED = ("vllm", "sglang", "ollama", "tgi")
VERIFIED_BY = {
    "prefix_stability_test": "tests/*/test_prompt_prefix.py",
    "security_test_approval_gate": "tests/*/test_*_approval.py",
    "eval_citation_required": "evals/run_evals.py",
    "eval_grounding_judge": "evals/judges/ungrounded_answer.yaml",
    "eval_regression_suite": "evals/datasets/*.jsonl",
    "benchmark_workloads": "benchmarks/workloads.yaml",
}


@dataclass
class Context:
    facts: B.Facts
    _memo: dict[str, DataFrame] = field(default_factory=dict)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._memo:
            self._memo[name] = make()
        return self._memo[name]

    @property
    def reach(self) -> DataFrame:
        return self._once("reach", lambda: B.route_reach(self.facts))

    @property
    def tools(self) -> DataFrame:
        return self._once("tools", lambda: B.actions(self.facts, self.reach))

    @property
    def flags(self) -> DataFrame:
        return self._once("flags", lambda: B.parse_flags(self.facts.serving))

    @property
    def clients(self) -> DataFrame:
        return self._once("clients", lambda: B.resolve_clients(self.facts))

    @property
    def calls(self) -> DataFrame:
        return self._once("calls", lambda: B.call_models(self.facts, self.clients, self.flags))

    @property
    def dependencies(self) -> DataFrame:
        return self._once("deps", lambda: B.dependency_names(self.facts))

    def with_calls(self) -> DataFrame:
        return self.calls.groupBy("scan").agg(F.count("*").alias("n_sites"))


def rule(fn: Rule) -> Rule:
    RULES[fn.__name__] = fn
    return fn


def finding(df: DataFrame, rule_id: str, priority: str | Column, confidence: float | Column, action: str | None,
            subject: Column | None = None, n_sites: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        "scan", F.lit(rule_id).alias("rule_id"), lit(priority).alias("priority"), lit(confidence).cast("double").alias("confidence"),
        (F.lit("app") if subject is None else subject).alias("subject"),
        (F.lit(1) if n_sites is None else n_sites).cast("long").alias("n_sites"), F.lit(action).cast("string").alias("action"),
    )


def tokens(chars: Column) -> Column:
    return F.bround(chars / CHARS_PER_TOKEN).cast("long")


@rule
def tool_without_approval(c: Context) -> DataFrame:
    t = c.tools.where(F.col("side_effect").isin("write", "external") & ~F.col("gated"))
    conf = min(C.PRIORS["ast"], C.PRIORS["absence"])
    return finding(t, "sec.tool_approval_boundary", "P0", conf, "add_approval_boundary", F.col("key"))


@rule
def approval_regression_guard(c: Context) -> DataFrame:
    return finding(c.tools.where("gated"), "sec.approval_gate_regression_test", "P1", C.PRIORS["ast_heuristic"], "security_test_approval_gate", F.col("key"))


@rule
def call_without_timeout(c: Context) -> DataFrame:
    g = c.calls.where("NOT has_timeout").groupBy("scan").agg(F.count("*").alias("n"))
    return finding(g, "rel.llm_timeout", "P0", 0.9, "add_llm_timeout", n_sites=F.col("n"))


@rule
def no_fallback(c: Context) -> DataFrame:
    """Neither a retry library in use nor a second endpoint behind a gateway."""
    has = B.retry_libraries(c.facts, c.dependencies).select("scan").unionByName(c.facts.fallback.select("scan"))
    return finding(c.with_calls().join(has, "scan", "left_anti"), "rel.fallback_gateway", "P2", 0.8, None, n_sites=F.col("n_sites"))


@rule
def grounding(c: Context) -> DataFrame:
    claims = C.reconcile(B.retrieval_candidates(c.facts, c.dependencies), ["scan", "predicate"])
    present = C.top_claim(claims, ["scan", "predicate"]).where("value = 'true'").select("scan", "confidence")
    cites = c.facts.prompt.where(F.col("text").rlike(CITATION_INSTRUCTION)).groupBy("scan").agg(F.min_by("key", "id").alias("key"))
    contract = finding(cites.join(present, "scan"), "eval.citation_contract", "P1", 0.85, "eval_citation_required", F.col("key"))
    judge = finding(present, "eval.grounding_judge", "P1", F.col("confidence") * 0.9, "eval_grounding_judge")
    return contract.unionByName(judge)


@rule
def no_regression_suite(c: Context) -> DataFrame:
    evals = c.dependencies.where("category = 'eval'").select("scan").unionByName(
        c.facts.llm_call.where(B.is_test_path(F.col("path"))).select("scan")
    )
    return finding(c.with_calls().join(evals, "scan", "left_anti"), "eval.regression_suite", "P1", 0.85, "eval_regression_suite", n_sites=F.col("n_sites"))


@rule
def tracing_gap(c: Context) -> DataFrame:
    traced = c.dependencies.where("category = 'tracing'").select("scan")
    return finding(c.with_calls().join(traced, "scan", "left_anti"), "obs.genai_tracing", "P1", 0.85, "add_tracing", n_sites=F.col("n_sites"))


@rule
def inline_prompt(c: Context) -> DataFrame:
    return finding(c.facts.prompt.where("inline"), "obs.prompt_versioning", "P2", 0.95, "extract_prompt", F.col("key"))


@rule
def prefix_cache(c: Context) -> DataFrame:
    s = c.facts.system_message
    head = finding(s.where("dynamic_head"), "inf.prefix_instability", F.when(tokens(F.col("static_chars")) >= 500, "P0").otherwise("P1"), 0.9, "prefix_stability_fix", F.col("key"))
    guard = finding(s.where(~F.col("dynamic_head") & (tokens(F.col("static_prefix_chars")) >= 512)), "inf.prefix_stability_guard", "P1", 0.85, "prefix_stability_test", F.col("key"))
    off = c.facts.serving.where("engine = 'vllm'").join(c.flags.where("flag = 'no-enable-prefix-caching'").select("scan", "key"), ["scan", "key"], "left_semi")
    return head.unionByName(guard).unionByName(finding(off, "inf.prefix_caching_disabled", "P1", 0.9, None, F.col("key")))


@rule
def context_budget(c: Context) -> DataFrame:
    """Worst-case prompt: system + retrieved context + generated tokens, against the serving window."""
    sysm = c.facts.system_message.groupBy("scan").agg(F.min_by("static_chars", "id").alias("sys"))
    first = lambda end: F.min_by(F.when(F.col("keypath").endswith(end), F.col("value").cast("long")), F.when(F.col("keypath").endswith(end), F.col("id")))
    cfg = c.facts.config_key.groupBy("scan").agg(first("max_context_chars").alias("ctx"), first("max_tokens").alias("gen"))
    win = c.flags.where("flag = 'max-model-len'").join(c.facts.serving.select("scan", "key", "id"), ["scan", "key"]).groupBy("scan").agg(
        F.min_by(F.col("value").cast("long"), "id").alias("window")
    )
    j = sysm.join(cfg.where("ctx IS NOT NULL"), "scan").join(win, "scan", "left")
    worst = tokens(F.col("sys")) + tokens(F.col("ctx")) + F.coalesce("gen", F.lit(0))
    over = F.coalesce(worst > F.col("window"), F.lit(False))
    return finding(j, "inf.context_budget_gate", F.when(over, "P0").otherwise("P1"), 0.8, "benchmark_workloads", n_sites=worst)


@rule
def no_serving_baseline(c: Context) -> DataFrame:
    cand = B.engine_candidates(c.facts, c.clients)
    top = C.top_claim(C.reconcile(cand, ["scan", "subject", "predicate"]), ["scan", "subject", "predicate"])
    hosted = top.where(F.col("value").isin(*SELF_HOSTED)).groupBy("scan").agg(F.count("*").alias("n"))
    return finding(hosted, "inf.serving_baseline", "P1", 0.9, "benchmark_workloads", n_sites=F.col("n"))


def run_rules(facts: B.Facts) -> DataFrame:
    ctx = Context(facts)
    out = None
    for r in RULES.values():
        df = r(ctx)
        out = df if out is None else out.unionByName(df)
    return out


def glob_regex(pattern: str) -> str:
    """Anchored regex of a shell glob (* ? and [..])."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif close > 0:
            body = pattern[i + 1:close].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = close
        else:
            out += ch if ch.isalnum() or ch in "_/:#-" else "\\" + ch
        i += 1
    return f"(?s)^{out}$"


def glob_match(key: Column, pattern: str) -> Column:
    return key.rlike(glob_regex(pattern))


def unresolved(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Drop findings whose verifying artifact exists in the scan's files (the globs are a fixed list)."""
    hit = F.coalesce(*[F.when(glob_match(F.col("path"), g), a) for a, g in VERIFIED_BY.items()])
    done = files.select("scan", hit.alias("action")).where("action IS NOT NULL").distinct()
    return findings.join(done, ["scan", "action"], "left_anti")


def ranked(findings: DataFrame) -> DataFrame:
    """Priority, then confidence; experimental rules are marked so that a report can set them apart."""
    order = F.when(F.col("priority") == "P0", 0).when(F.col("priority") == "P1", 1).otherwise(2)
    return findings.withColumn("experimental", F.col("rule_id").isin(*EXPERIMENTAL)).orderBy(
        order, F.col("confidence").desc(), "scan", "rule_id", "subject"
    )


def validate_evidence(links: DataFrame, facts: DataFrame, files: DataFrame) -> DataFrame:
    """Problem of each finding-to-fact link, or 'ok'.

    ``facts``: fact_id, path, line_start, line_end, excerpt. ``files``: path, text. The excerpt must
    occur as stored, whitespace aside, in the cited lines widened by one on each side. Without lines the
    whole file is cited; a fact without a path has nothing to check. An excerpt equal to the path cites the file itself.
    """
    known = facts.withColumn("_known", F.lit(True))
    j = links.join(known, "fact_id", "left").join(files.select("path", "text"), "path", "left")
    lines = F.split("text", "\n")
    whole = F.col("line_start").isNull()
    last = F.coalesce("line_end", "line_start")
    lo = F.greatest(F.col("line_start") - 1, F.lit(1))
    cut = F.slice(lines, lo.cast("int"), F.greatest(last + 1 - lo + 1, F.lit(0)).cast("int"))
    cited = F.when(whole, F.col("text")).otherwise(F.array_join(cut, " "))
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    problem = (
        F.when(F.col("_known").isNull(), "missing fact")
        .when(F.col("path").isNull(), "ok")
        .when(F.col("text").isNull(), "missing file")
        .when(F.trim("excerpt") == F.col("path"), "ok")
        .when(~whole & ((F.col("line_start") < 1) | (F.col("line_start") > last) | (last > F.size(lines))), "range outside file")
        .when(~F.contains(squeeze(cited), squeeze(F.col("excerpt"))), "excerpt not at location")
        .otherwise("ok")
    )
    return j.select("finding_id", "fact_id", problem.alias("problem"))


def containment_candidates(expected: DataFrame, emitted: DataFrame) -> DataFrame:
    """Candidate pairs (t, p): same scan, rule and file, and the symbol is named or the line lies inside.

    ``expected``: t, scan, rule_id, file, symbol, line. ``emitted``: p, scan, rule_id, file, symbol_text, lo, hi.
    Both branches join on equality first; the containment test filters inside one rule and file.
    """
    j = expected.join(emitted, ["scan", "rule_id", "file"])
    named = F.contains("symbol_text", "symbol")
    inside = F.col("line").between(F.col("lo"), F.coalesce("hi", "lo"))
    return j.where(F.coalesce(named, F.lit(False)) | F.coalesce(inside, F.lit(False))).select("t", "p")


def call_site_candidates(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Candidate pairs (t, p) of labelled call sites and predicted keys: same file, and the function,
    an accepted alias or the qualified name agrees; a label for module level accepts any function.

    ``truth``: t, file, function, also_accept (array). ``pred``: p, key. Pair them with
    :func:`tracegauge.operators.joins.match_greedy`.
    """
    from tracegauge.functions.change import key_file, key_symbol, qualname

    k = pred.select("p", key_file(F.col("key")).alias("file"), key_symbol(F.col("key")).alias("_s"), qualname(F.col("key")).alias("_q"))
    names = F.concat(F.array("function"), F.coalesce("also_accept", F.array().cast("array<string>")))
    ok = (F.col("function") == "<module>") | F.array_contains(names, F.col("_s")) | F.array_contains(names, F.col("_q"))
    return truth.join(k, "file").where(ok).select("t", "p")
