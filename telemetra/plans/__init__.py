"""Named queries over the shared tables, one module per family of operators."""

from __future__ import annotations

import importlib

MODULES = ["scans", "cleaning", "splits", "windows", "eda", "scores", "graph", "online", "drift", "balance", "runs", "checks", "streams", "models"]


def load() -> tuple[dict, dict]:
    """Import every plan module and return (queries, oracle texts)."""
    from telemetra.plans import registry
    for m in MODULES:
        importlib.import_module(f"telemetra.plans.{m}")
    return registry.QUERIES, registry.ORACLE
