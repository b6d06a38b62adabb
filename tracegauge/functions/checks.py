"""Deterministic answer checks: each is a Column builder returning struct<verdict, reason>.

A suite is one projection of N structs followed by one explode; cases are never joined with checks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegauge.functions import text as X

CHECKS: dict[str, Callable[..., Column]] = {}


def check(name: str) -> Callable[[Callable[..., Column]], Callable[..., Column]]:
    """Register a check; user code registers its own the same way."""

    def register(fn):
        CHECKS[name] = fn
        return fn

    return register


def result(verdict: str, reason: Column | str) -> Column:
    r = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(verdict).alias("verdict"), r.alias("reason"))


def passed(reason: Column | str = "ok") -> Column:
    return result("PASS", reason)


def failed(reason: Column | str) -> Column:
    return result("FAIL", reason)


@check("citation_required")
def citation_required(*, pattern: str = X.CITATION, allow_refusal: str | None = X.REFUSAL) -> Column:
    """At least one citation and only retrieved ids; a documented refusal may omit citations."""
    cited = X.citations(F.col("output"), pattern)
    unknown = F.array_sort(F.array_except(cited, F.col("retrieved_ids")))
    refused = F.col("output").rlike(allow_refusal) if allow_refusal else F.lit(False)
    return (
        F.when((F.size(cited) == 0) & refused, passed("documented not-found answer; no citation required"))
        .when(F.size(cited) == 0, failed("answer has no citation"))
        .when(F.size(unknown) > 0, failed(F.concat(F.lit("cites ids that were not retrieved: "), F.array_join(unknown, ", "))))
        .otherwise(passed(F.concat(F.size(cited).cast("string"), F.lit(" cited id(s), all retrieved"))))
    )


_TYPES = {
    "integer": lambda t: t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"),
    "number": lambda t: t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"),
    "string": lambda t: t == "STRING",
    "boolean": lambda t: t == "BOOLEAN",
    "object": lambda t: t.startswith("OBJECT"),
    "array": lambda t: t.startswith("ARRAY"),
    "null": lambda t: t == "VOID",
}


#: Judged, and (the last three) read over.
KEYWORDS = {
    "type", "required", "properties", "additionalProperties", "items", "enum", "const", "anyOf", "oneOf", "allOf", "not",
    "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "minItems", "maxItems",
    "title", "description", "$schema",
}


def _json(value: Any) -> Column:
    return F.lit(json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def schema_violation(v: Column, schema: dict[str, Any] | bool, at: Column | None = None) -> Column:
    """First violation of a JSON schema by a variant: the keywords in ``KEYWORDS``; any other raises ``ValueError``.

    ``at`` is the path of the value, NULL for the whole document. A value's own rules come before those of its parts.
    """
    at = F.lit(None).cast("string") if at is None else at
    label = F.coalesce(at, F.lit("(root)"))
    none = F.lit(None).cast("string")
    if schema is True:
        return none
    if schema is False:
        return F.concat(label, F.lit(" is not allowed"))
    if unknown := sorted(set(schema) - KEYWORDS):
        raise ValueError(f"unsupported schema keyword {', '.join(unknown)}")
    kind = F.schema_of_variant(v)
    below = lambda name: F.concat_ws("/", at, name)
    says = lambda text: F.concat(label, F.lit(f" {text}"))
    rules = []
    if "type" in schema:
        types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        rules.append((~reduce(or_, (_TYPES[t](kind) for t in types)), says(f"is not of type {' or '.join(types)}")))
    child = lambda name: F.try_variant_get(v, "$['" + name.replace("'", "\\'") + "']", "variant")
    for r in schema.get("required", []):
        rules.append((child(r).isNull(), says(f"lacks {r}")))
    x = F.try_variant_get(v, "$", "double")
    for key, out in (("minimum", lambda m: x < m), ("maximum", lambda m: x > m), ("exclusiveMinimum", lambda m: x <= m), ("exclusiveMaximum", lambda m: x >= m)):
        if key in schema:
            rules.append((_TYPES["number"](kind) & F.coalesce(out(schema[key]), F.lit(False)), says(f"outside {key}")))
    word, items = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "array<variant>")
    for key, of, size in (("Length", "STRING", F.length(word)), ("Items", "ARRAY", F.size(items))):
        for end, out in (("min", lambda n, m: n < m), ("max", lambda n, m: n > m)):
            if end + key in schema:
                rules.append((kind.startswith(of) & out(size, schema[end + key]), says(f"breaks {end}{key}")))
    if "pattern" in schema:
        rules.append(((kind == "STRING") & ~word.rlike(schema["pattern"]), says("does not match the pattern")))
    if "enum" in schema:
        rules.append((~reduce(or_, [F.to_json(v) == _json(e) for e in schema["enum"]], F.lit(False)), says("not in enum")))
    if "const" in schema:
        rules.append((F.to_json(v) != _json(schema["const"]), says("is not the constant")))
    fits = lambda key: [schema_violation(v, sub, at).isNull().cast("int") for sub in schema[key]]
    if "anyOf" in schema:
        rules.append((reduce(lambda a, b: a + b, fits("anyOf")) == 0, says("fits none of anyOf")))
    if "oneOf" in schema:
        rules.append((reduce(lambda a, b: a + b, fits("oneOf")) != 1, says("does not fit exactly one of oneOf")))
    if "not" in schema:
        rules.append((schema_violation(v, schema["not"], at).isNull(), says("fits what it must not")))
    own = [F.when(c, m) for c, m in rules] + [schema_violation(v, sub, at) for sub in schema.get("allOf", [])]
    known = list(schema.get("properties", {}))
    parts = []
    if schema.get("additionalProperties", True) is not True:
        fields = F.when(kind.startswith("OBJECT"), F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")))
        rest = F.filter(fields, lambda e: ~e["key"].isin(known)) if known else fields
        if schema["additionalProperties"] is False:
            names = F.array_sort(F.transform(rest, lambda e: e["key"]))
            own.append(F.when(F.size(names) > 0, F.concat(label, F.lit(" has unexpected "), F.array_join(names, ", "))))
        else:
            bad = F.filter(F.transform(rest, lambda e: schema_violation(e["value"], schema["additionalProperties"], below(e["key"]))), lambda m: m.isNotNull())
            parts.append(F.get(bad, F.lit(0)))
    for name, sub in schema.get("properties", {}).items():
        parts.append(F.when(child(name).isNotNull(), schema_violation(child(name), sub, below(F.lit(name)))))
    if "items" in schema:
        each = F.when(kind.startswith("ARRAY"), F.transform(items, lambda e, i: schema_violation(e, schema["items"], below(i.cast("string")))))
        parts.append(F.get(F.filter(each, lambda m: m.isNotNull()), F.lit(0)))
    return F.coalesce(none, *own, *parts)


@check("json_schema_valid")
def json_schema_valid(*, schema: dict[str, Any]) -> Column:
    v = X.strict_json(F.col("output"))
    bad = schema_violation(v, schema)
    return (
        F.when(v.isNull(), failed("output is not JSON"))
        .when(bad.isNotNull(), failed(F.concat(F.lit("schema violation: "), bad)))
        .otherwise(passed("valid against schema"))
    )


def _executed(names: Sequence[str] | None) -> Column:
    ok = lambda a: a["executed"] & (a["name"].isin(list(names)) if names else F.lit(True))
    return F.filter("actions", ok)


@check("side_effect_requires_approval")
def side_effect_requires_approval(*, actions: Sequence[str]) -> Column:
    """Every executed listed action carries an explicit approval; unknown approval fails."""
    bad = F.transform(
        F.filter(_executed(actions), lambda a: ~F.coalesce(a["approved"], F.lit(False))), lambda a: a["name"]
    )
    return F.when(F.size(bad) > 0, failed(F.concat(F.lit("executed without approval: "), F.array_join(bad, ", ")))).otherwise(
        passed("all side-effecting actions approved")
    )


@check("duplicate_action")
def duplicate_action(*, actions: Sequence[str] | None = None) -> Column:
    """Two executed actions with the same name and the same arguments in any order."""
    sign = lambda a: F.concat(a["name"], F.to_json(F.map_from_entries(F.array_sort(F.map_entries(a["args"])))))
    sig = F.transform(_executed(actions), sign)
    return F.when(F.size(sig) > F.size(F.array_distinct(sig)), failed("an action was executed twice with identical arguments")).otherwise(
        passed("no duplicate actions")
    )


@check("forbidden_pattern")
def forbidden_pattern(*, patterns: Sequence[str] = (), pii: bool = True, secrets: bool = True) -> Column:
    out = F.col("output")
    found = []
    if secrets:
        found.append(F.transform(X.find_secrets(out), lambda s: F.concat(F.lit("secret:"), s["kind"])))
    if pii:
        found.append(F.array(F.when(X.has_email(out), "pii:email"), F.when(X.has_card_number(out), "pii:card_number")))
    for p in patterns:
        found.append(F.array(F.when(out.rlike(p), f"pattern:{p}")))
    names = F.array_sort(F.array_distinct(F.filter(F.concat(*found), lambda x: x.isNotNull()))) if found else F.array().cast("array<string>")
    return F.when(F.size(names) > 0, failed(F.concat(F.lit("output contains "), F.array_join(names, ", ")))).otherwise(
        passed("no forbidden content")
    )


@check("latency_threshold")
def latency_threshold(*, max_ttft_ms: float | None = None, max_latency_ms: float | None = None) -> Column:
    c = None
    for name, label, bound in (("ttft_ms", "TTFT", max_ttft_ms), ("latency_ms", "latency", max_latency_ms)):
        if bound is None:
            continue
        missing, over = failed(f"{label} not recorded"), failed(f"{label} over {bound:g} ms")
        c = F.when(F.col(name).isNull(), missing) if c is None else c.when(F.col(name).isNull(), missing)
        c = c.when(F.col(name) > bound, over)
    ok = passed("within latency budget")
    return ok if c is None else c.otherwise(ok)


@check("context_budget")
def context_budget(*, max_prompt_tokens: int) -> Column:
    n = F.col("prompt_tokens")
    return (
        F.when(n.isNull(), failed("prompt token count not recorded"))
        .when(n > max_prompt_tokens, failed(F.concat(F.lit("prompt "), n.cast("string"), F.lit(f" tokens > budget {max_prompt_tokens}"))))
        .otherwise(passed(F.concat(F.lit("prompt "), n.cast("string"), F.lit(f" tokens within {max_prompt_tokens}"))))
    )


@check("prompt_prefix_stable")
def prompt_prefix_stable(*, other: str = "other_rendered_prompt", min_shared: str = "min_shared_chars") -> Column:
    """Both requests share at least ``min_shared`` leading characters (columns name the pair)."""
    shared = X.common_prefix_length(F.col("rendered_prompt"), F.col(other))
    return (
        F.when(F.col("rendered_prompt").isNull(), failed("rendered prompt not available"))
        .when(shared < F.col(min_shared), failed(F.concat(F.lit("requests diverge after "), shared.cast("string"), F.lit(" chars"))))
        .otherwise(passed(F.concat(shared.cast("string"), F.lit(" leading chars shared"))))
    )


@dataclass(frozen=True)
class Evaluator:
    key: str
    check: str
    params: dict[str, Any] = field(default_factory=dict)


def run_suite(cases: DataFrame, evaluators: Sequence[Evaluator], id_col: str = "case_id") -> DataFrame:
    """(case, evaluator, verdict, reason) rows; an unknown check or bad parameters give ERROR."""

    def build(e: Evaluator) -> Column:
        if e.check not in CHECKS:
            r = result("ERROR", f"unknown check {e.check!r}")
        else:
            try:
                r = CHECKS[e.check](**e.params)
            except (TypeError, ValueError) as exc:
                r = result("ERROR", f"bad parameters for {e.check}: {exc}")
        return F.struct(F.lit(e.key).alias("evaluator"), r.alias("result"))

    # The array is built first: Spark cannot run an Arrow finisher inside the explode itself. And it is
    # an outer explode: a plain one makes Catalyst add a size() filter that runs every check twice.
    built = cases.select(id_col, F.array(*[build(e) for e in evaluators]).alias("_rs"))
    return built.select(id_col, F.explode_outer("_rs").alias("r")).select(id_col, "r.evaluator", "r.result.verdict", "r.result.reason")


def suite_summary(results: DataFrame) -> DataFrame:
    n = lambda v: F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}")
    return results.groupBy("evaluator").agg(*[n(v) for v in ("PASS", "FAIL", "ERROR", "SKIP")])


def conclusion(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """failure if anything failed, neutral if anything warned or errored, else success."""
    severity = F.max(F.when(F.lower("verdict") == "fail", 2).when(F.lower("verdict").isin("warn", "error"), 1).otherwise(0))
    return results.groupBy(*keys).agg(severity.alias("_s")).select(
        *keys, F.when(F.col("_s") == 2, "failure").when(F.col("_s") == 1, "neutral").otherwise("success").alias("conclusion")
    )
