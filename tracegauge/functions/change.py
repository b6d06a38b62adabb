"""Column builders for keys, files, events and identities of a change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path patterns of the file classes, event rules.
DEPENDENCY_FILE = r"(^|/)(requirements[^/]*\.txt|pyproject\.toml|setup\.cfg|setup\.py|package\.json|poetry\.lock|uv\.lock|package-lock\.json|pnpm-lock\.yaml)$"
INERT_FILE = (
    r"(?i)((^|/)(\.gitignore|\.gitattributes|\.dockerignore|\.editorconfig|LICENSE[^/]*|CHANGELOG[^/]*|CONTRIBUTING[^/]*|CODE_OF_CONDUCT[^/]*)$"
    r"|^\.github/|\.(png|jpe?g|gif|svg|ico|webp|woff2?|ttf|eot)$)"
)
OTHER_SOURCE = r"\.(tsx?|jsx?|mjs|cjs|go|rs|java|kt|rb|php|cs|swift|c|cc|cpp|h|hpp|scala|sh|ipynb)$"
DOC_FILE = r"(?i)\.(md|rst|txt)$"
NON_APP = r"^(tests/|test/|scripts/|docs/|\.github/)"
REPO = r"^[A-Za-z0-9_.-]{1,100}/[A-Za-z0-9_.-]{1,100}$"
SHA = r"^[0-9a-f]{40}$"
GUARD_ACTIONS = ("opened", "synchronize", "reopened", "ready_for_review")


def node_key(kind: str | Column, *parts: Column) -> Column:
    """``kind:a::b``"""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(k, F.lit(":"), F.concat_ws("::", *parts))


def key_body(key: Column) -> Column:
    """Key without its ``kind:`` prefix; a colon after the first ``::`` is no prefix."""
    head = F.split_part(key, F.lit("::"), F.lit(1))
    return F.when(F.instr(head, ":") > 0, F.regexp_replace(key, r"^[^:]*:", "")).otherwise(key)


def key_file(key: Column) -> Column:
    return F.split_part(key_body(key), F.lit("::"), F.lit(1))


def key_symbol(key: Column) -> Column:
    """First segment of the symbol: up to ``#`` or ``.``"""
    return F.regexp_extract(key_body(key), r"::([^#.]*)", 1)


def qualname(key: Column) -> Column:
    """Whole qualified name: up to ``#``"""
    return F.regexp_extract(key_body(key), r"::([^#]*)", 1)


def categorize_change(kind: Column, key: Column) -> Column:
    """Change category of a touched node."""
    by_key = (
        F.when(F.contains(key, F.lit(".--")), "serving_config")
        .when(key.rlike(r"(?i)retriev|top_k|context|chunk|rerank"), "retrieval_config")
        .when(key.rlike(r"(?i)generation|max_tokens|temperature|top_p"), "generation_config")
        .otherwise("config")
    )
    return (
        F.when(kind == "prompt", "prompt")
        .when(kind == "config_key", by_key)
        .when(kind == "serving_config", "serving_config")
        .when(kind.isin("tool", "security_boundary"), "tool")
        .when(kind == "model", "model")
        .when(kind == "retriever", "retrieval")
        .when(kind == "endpoint", "endpoint")
        .when(kind == "route", "route")
        .when(kind == "component", F.when(F.contains(key, F.lit("#llm")), "llm_call").otherwise("code"))
    )


def classify_file(path: Column) -> Column:
    """dependency, tests, repo_meta, app, docs, other_source or unknown."""
    return (
        F.when(path.rlike(DEPENDENCY_FILE), "dependency")
        .when(path.rlike(r"^tests?/"), "tests")
        .when(path.rlike(INERT_FILE), "repo_meta")
        .when(path.endswith(".py"), F.when(path.rlike(NON_APP), "support").otherwise("app"))
        .when(path.rlike(OTHER_SOURCE), "other_source")
        .when(path.rlike(DOC_FILE) | path.rlike(NON_APP), "docs")
        .otherwise("unknown")
    )


def content_identity(fields: Sequence[tuple[str, Column]]) -> Column:
    """sha256 of the JSON object with its keys in sorted order; equal inputs give equal identities."""
    s = F.struct(*[c.alias(n) for n, c in sorted(fields, key=lambda nc: nc[0])])
    return F.sha2(F.to_json(s, {"ignoreNullFields": "false"}), 256)


def validate_event(payload: Column) -> Column:
    """Reason a delivery payload is rejected, NULL when it is well formed (payload is a variant)."""
    get = lambda p, t: F.try_variant_get(payload, p, t)
    kind = lambda p: F.schema_of_variant(F.try_variant_get(payload, p, "variant"))
    missing = lambda p: F.try_variant_get(payload, p, "variant").isNull()
    return (
        F.when(payload.isNull(), "not JSON")
        .when(missing("$.repository.full_name") | missing("$.pull_request.number") | missing("$.pull_request.head.sha"), "pull_request event incomplete")
        .when(~get("$.repository.full_name", "string").rlike(REPO), "repository.full_name is not owner/name")
        .when((kind("$.pull_request.number") != "BIGINT") | ~F.coalesce(get("$.pull_request.number", "bigint") > 0, F.lit(False)), "pull_request.number is not a positive integer")
        .when((kind("$.pull_request.head.sha") != "STRING") | ~get("$.pull_request.head.sha", "string").rlike(SHA), "head.sha is not a 40-hex commit id")
        .when(kind("$.installation.id").isNotNull() & ~kind("$.installation.id").isin("BIGINT", "VOID"), "installation.id is not an integer")
    )


def event_decision(event: Column, action: Column, repo: Column, head_repo: Column, draft: Column, allowed: Sequence[str] | None) -> Column:
    """Why an event is ignored, or 'accept'."""
    not_allowed = ~F.lower(repo).isin(*allowed) if allowed is not None else F.lit(False)
    return (
        F.when(event == "ping", "ping")
        .when((event != "pull_request") | repo.isNull() | ~F.coalesce(action.isin(*GUARD_ACTIONS), F.lit(False)), F.concat(F.lit("ignored "), event, F.lit("/"), F.coalesce(action, F.lit("none"))))
        .when(not_allowed, "repository not allowed")
        .when(~head_repo.eqNullSafe(repo), "fork")
        .when(draft & (action != "ready_for_review"), "draft")
        .otherwise("accept")
    )


def finite_evidence(baseline: Column, value: Column, change: Column, lo: Column, hi: Column, runs: Column, min_runs: int = 3) -> Column:
    """First reason why a stored comparison cannot count as evidence, NULL when it can."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return (
        F.when(bad(change) | bad(lo) | bad(hi), "non-finite interval")
        .when(~((lo <= change) & (change <= hi)), "interval excludes the change")
        .when(bad(baseline) | bad(value) | (baseline <= 0) | (value <= 0), "non-positive value")
        .when(runs < min_runs, "too few runs")
    )
