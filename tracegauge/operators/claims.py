"""Reconcile candidate values from several sources into claims with confidence and contradictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegauge.functions.text import normalize_value
from tracegauge.operators.ordered import order_bucket, position

# Prior trust per evidence source, and the method each source belongs to.
PRIORS = {
    "ast": 0.95, "ast_heuristic": 0.7, "config": 0.9, "trace": 0.9, "dependency": 0.6,
    "readme": 0.5, "vlm": 0.45, "llm": 0.4, "absence": 0.6,
}
METHODS = {
    "ast": "deterministic", "ast_heuristic": "deterministic", "config": "deterministic", "dependency": "deterministic",
    "absence": "deterministic", "readme": "deterministic", "trace": "trace", "vlm": "vlm", "llm": "llm",
}
CONTRADICTION_WEIGHT = 0.5
CODE_SOURCES = ("ast", "config", "trace")


def _lookup(table: dict[str, object], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def noisy_or(p: Column) -> Column:
    """1 - prod(1 - p) as an aggregate; every prior is below one."""
    return 1.0 - F.exp(F.sum(F.log1p(-p)))


def reconcile(
    candidates: DataFrame,
    keys: Sequence[str] = ("subject", "predicate"),
    *,
    normalize: Callable[[Column], Column] = normalize_value,
) -> DataFrame:
    """One claim per distinct normalized value.

    ``candidates``: keys, value, source, fact_id, direct and optionally ``n``, how many equal
    candidates the row stands for. Candidates are combined per value before anything is compared,
    so a subject with very many facts costs one row per distinct value. Evidence ids stay as rows;
    see :func:`members`.
    """
    keys = list(keys)
    weight = F.col("n") if "n" in candidates.columns else F.lit(1)
    c = candidates.withColumn("_norm", normalize(F.col("value"))).withColumn("_prior", _lookup(PRIORS, F.col("source")))
    per = c.groupBy(*keys, "_norm").agg(
        F.sum(F.log1p(-F.col("_prior")) * weight).alias("_ls"),
        F.max_by("value", F.struct(F.col("_prior"), -F.col("fact_id"))).alias("value"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.bool_or(F.col("direct") & F.col("source").isin(*CODE_SOURCES)).alias("_direct"),
        F.sum(weight).cast("long").alias("n_support"),
    )
    # The rivals' joint support is 1 - prod(1 - s), and 1 - s = exp(sum of logs): the log sums add up.
    total = per.groupBy(*keys).agg(F.sum("_ls").alias("_all"), F.count("*").alias("_n"))
    support = 1.0 - F.exp("_ls")
    oppose = F.when(F.col("_n") > 1, 1.0 - F.exp(F.col("_all") - F.col("_ls"))).otherwise(0.0)
    methods = F.array_distinct(F.transform("sources", lambda s: _lookup(METHODS, s)))
    conflict = F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 12)
    return per.join(total, keys).select(
        *keys, "value", F.col("_norm").alias("normalized"),
        # the first rounding removes the noise of the logarithms, so exact halves round alike
        F.round(F.round(support * (1.0 - CONTRADICTION_WEIGHT * oppose), 9), 3).alias("confidence"),
        F.when(F.size(methods) == 1, F.get(methods, F.lit(0))).otherwise("reconciled").alias("method"),
        F.when(F.col("_direct"), "direct_observation").otherwise("inference").alias("observation"),
        F.when(F.col("_n") > 1, "contested").otherwise("supported").alias("status"),
        F.when(F.col("_n") > 1, conflict).alias("conflict_group"),
        "sources", "n_support",
    )


def members(candidates: DataFrame, keys: Sequence[str] = ("subject", "predicate"),
            *, normalize: Callable[[Column], Column] = normalize_value) -> DataFrame:
    """The stored evidence: keys, fact_id, normalized, one row per fact and value it states.

    A claim is a class of equal values, and a fact's stance on it follows from the class the fact belongs to. So this
    table, which grows with the facts, says all that the bridge of facts and claims says, which grows with their product.
    """
    return candidates.select(*keys, "fact_id", normalize(F.col("value")).alias("normalized")).distinct()


def evidence(members: DataFrame, claims: DataFrame, keys: Sequence[str] = ("subject", "predicate")) -> DataFrame:
    """Bridge rows claim x fact with stance supports/contradicts, derived for the claims asked for.

    A fact that also supports a claim never contradicts it.
    """
    keys = list(keys)
    asked = claims.select(*keys, "normalized").distinct()
    own = asked.join(members, [*keys, "normalized"]).select(*keys, "normalized", "fact_id", F.lit("supports").alias("stance"))
    facts = members.select(*keys, "fact_id").distinct()
    rest = asked.join(facts, keys).join(members, [*keys, "normalized", "fact_id"], "left_anti")
    return own.unionByName(rest.select(*keys, "normalized", "fact_id", F.lit("contradicts").alias("stance")))


def evidence_counts(members: DataFrame, keys: Sequence[str] = ("subject", "predicate")) -> DataFrame:
    """Facts for and against every claim, without the bridge: those of its class, and the subject's other ones."""
    keys = list(keys)
    facts = members.select(*keys, "fact_id").distinct().groupBy(*keys).agg(F.count("*").alias("_all"))
    own = members.groupBy(*keys, "normalized").agg(F.count("*").alias("n_supports"))
    return own.join(facts, keys).select(*keys, "normalized", "n_supports", (F.col("_all") - F.col("n_supports")).alias("n_contradicts"))


def contradictions(claims: DataFrame, keys: Sequence[str] = ("subject", "predicate")) -> DataFrame:
    """Every value of every conflict group, marking the strongest (rows, so a group may be long).

    Groups are told apart by the keys; ``conflict_group`` is their short name.
    """
    keys = list(keys)
    c = claims.where("conflict_group IS NOT NULL")
    top = c.groupBy(*keys).agg(
        F.count("*").alias("n_values"), F.min_by("normalized", F.struct(-F.col("confidence"), F.col("normalized"))).alias("_top")
    )
    return c.join(top, keys).select(
        *keys, "conflict_group", "n_values", "value", "confidence", (F.col("normalized") == F.col("_top")).alias("strongest")
    )


def top_claim(claims: DataFrame, keys: Sequence[str] = ("subject", "predicate")) -> DataFrame:
    """Top-confidence value per subject as one combined aggregate, without the alternatives."""
    best = F.min_by(F.struct("value", "confidence"), F.struct((-F.col("confidence")).alias("o"), "normalized"))
    return claims.groupBy(*keys).agg(best.alias("_t")).select(*keys, "_t.value", "_t.confidence")


def primary(claims: DataFrame, keys: Sequence[str] = ("subject", "predicate")) -> DataFrame:
    """Every claim of a subject with its place: 1 is the primary claim, the others are its alternatives, strongest first.

    Rows, not arrays: a subject may have any number of claims. The place is a running count that is cut like any order.
    """
    keys = list(keys)
    placed = claims.select(*keys, "value", "confidence", (-F.col("confidence")).alias("_weak"), "normalized")
    order = ["_weak", "normalized"]
    return position(placed, keys, [F.col(c) for c in order], order_bucket(placed, keys, order), "place").drop(*order)
