"""Registered queries: name -> Spark plan, and the same question in SQL for the cross-check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def sql_view(name: str, body: str, *needs: str) -> None:
    """Declare a derived table for the SQL side; ``needs`` are other derived tables."""
    SQL_VIEWS[name] = (needs, body)


def with_views(views: tuple[str, ...], body: str) -> str:
    """Prefix ``body`` with the CTEs of ``views`` and of everything they need."""
    order: list[str] = []

    def add(v: str) -> None:
        for d in SQL_VIEWS[v][0]:
            add(d)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    ctes = [f"{v} AS ({SQL_VIEWS[v][1]})" for v in order]
    text = body.strip()
    own = ""
    for head in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(head):
            own = text[len(head):]
            break
    if own:
        return "WITH RECURSIVE " + ",\n".join([*ctes, own])
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + text


def t_quantile_ctes(source: str, name: str = "tq", p: float = 0.95) -> str:
    """SQL for the Student-t quantile of every df in ``source``: halve the angle, Simpson's rule.

    Yields ``name``(df9, q) with df rounded to 9 digits as the join key.
    """
    return f"""
    {name}_step AS (SELECT df9, 0.0::DOUBLE AS lo, pi() / 2 AS hi, 0 AS i
        FROM (SELECT DISTINCT round(df, 9) AS df9 FROM {source} WHERE df IS NOT NULL)
      UNION ALL SELECT df9, CASE WHEN below THEN a ELSE lo END, CASE WHEN below THEN hi ELSE a END, i + 1 FROM (
        SELECT *, 0.5 + exp(lgamma((df9 + 1) / 2) - lgamma(df9 / 2)) / sqrt(pi()) * a / 1200.0 * list_sum(list_transform(
          range(0, 401), lambda j: (CASE WHEN j = 0 OR j = 400 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(a * j / 400.0), df9 - 1))) < {p} AS below
        FROM (SELECT *, (lo + hi) / 2 AS a FROM {name}_step WHERE i < 50))),
    {name} AS (SELECT df9, sqrt(df9) * tan((lo + hi) / 2) AS q FROM {name}_step WHERE i = 50)"""


def query(name: str, *views: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return register


def shared_view(name: str, text: str, *needs: str, spark: str | None = None) -> None:
    """A derived table whose SQL reads the same in Spark and in the check; ``{x}`` names a source.

    ``spark``: the same rows written for Spark, where its optimizer needs the order of the steps spelled out.
    """
    names = {n: n for n in (*_TABLES, *needs)}
    sql_view(name, text.format(**names), *needs)
    SHARED[name] = (spark or text, needs)


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
           "embeddings", "pages", "benchmark", "labels", "conversations")
SHARED: dict[str, tuple[str, tuple[str, ...]]] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark side of a shared view."""
    text, needs = SHARED[name]
    frames = {n: view(spark, sf_dir, n) for n in needs}
    from tracegauge.plans.views import table

    frames |= {t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in text}
    return spark.sql(text, **frames)
