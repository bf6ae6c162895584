"""All registered queries."""

from __future__ import annotations

import importlib

from tessera.plans.registry import ORACLE, QUERIES

MODULES = ["vectors", "tpch", "clickbench", "relational", "quality", "index", "approx", "storage", "profiling", "graphs"]

for _m in MODULES:
    importlib.import_module(f"tessera.plans.{_m}")

__all__ = ["ORACLE", "QUERIES"]
