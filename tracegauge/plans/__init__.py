"""Query plans over the given tables, grouped by subject."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "views",
    "serving",
    "telemetry",
    "gate",
    "evals",
    "optimizer",
    "prefix",
    "scan_views",
    "claims_joins",
    "graph",
    "findings",
    "sources",
    "misc",
    "streams",
)


def load_all() -> None:
    for m in MODULES:
        import_module(f"{__name__}.{m}")
